"""Means of frames after each effect in one pass, against the same in three."""

import numpy as np

from tidemark.operators import frames

EFFECTS = {"fade": {"mode": "in_out", "frames": 3}, "mirror_flip": {}, "resize": {"width": 12, "height": 4}}


def test_one_pass_is_three(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(v, i, 6, 4, rng.integers(0, 256, 72, np.uint8).tobytes()) for v in range(3) for i in range(7)]
    source = spark.createDataFrame([(v, i, w, h, bytearray(p)) for v, i, w, h, p in rows], frames.FRAMES)
    wanted = frames.means(frames.apply_each(source, EFFECTS, 7, 1, 6))
    found = frames.means_of_each(source, EFFECTS, 7, 1, 6)
    assert found.columns == wanted.columns and sorted(found.collect()) == sorted(wanted.collect())
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_slices_hold_every_row():
    import pyarrow as pa

    sizes = [0, 10, frames.SLICE_BYTES - 10, 1, 2 * frames.SLICE_BYTES, 5, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([b"x" * n for n in sizes])], ["k", "pixels"])
    cut = [b.column("k").to_pylist() for b in frames._slices(batch)]
    assert cut == [[0, 1, 2], [3], [4], [5, 6]]
    assert list(frames._slices(batch.slice(0, 0))) == []
