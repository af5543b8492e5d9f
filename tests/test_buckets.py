"""Merging by time buckets gives what one bucket gives; effects in one pass give what each gives alone."""

import random

import numpy as np
import pytest

from tidemark.operators import frames, intervals


def merged(rows, gap, furthest):
    """A plain reading of the rule, key by key."""
    out = []
    for key in {r[0] for r in rows}:
        run, reach = None, None
        for _, start, end, ident in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            if run is None or start - reach > gap:
                run = [key, start, end, 0]
                out.append(run)
            run[2] = max(run[2], end) if furthest else end
            reach = max(reach, end) if furthest and reach is not None else end
            run[3] += 1
    return sorted(map(repr, ((r[0], r[1], r[2], r[3]) for r in out)))


@pytest.mark.parametrize("bucket", [1.0, 7.0, 1e6])
def test_merging_by_buckets(spark, bucket):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), float(rng.randrange(400)), 0.0, k) for k in range(300)]
    # some spans reach over many buckets, some keys and starts repeat
    rows = [(key, start, start + rng.choice([0.0, 0.5, 1.0, 30.0]), k) for key, start, _, k in rows]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "key string, start double, end double, event_id long, confidence double")
    found = intervals.merge_events(df, ["key"], 1.0, bucket=bucket).select("key", "start", "end", "n").collect()
    assert sorted(repr(tuple(r)) for r in found) == merged(rows, 1.0, False)
    found = intervals._joined(df, ["key"], ["start", "event_id"], 1.0, bucket).select("key", "start", "end").collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr(tuple(eval(r)[:3])) for r in merged(rows, 1.0, True))


def test_merging_nothing(spark):
    df = spark.createDataFrame([], "key string, start double, end double, event_id long, confidence double")
    assert intervals.merge_events(df, ["key"]).count() == 0


def test_each_effect_in_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, 4, 4, rng.integers(0, 256, 48, np.uint8).tobytes()) for i in range(6)]
    df = spark.createDataFrame(rows, frames.FRAMES)
    effects = {"pixelate": {"size": 2}, "resize": {"width": 2, "height": 6}}
    every = frames.apply_each(df, effects, 6, 1, 5)
    for name, params in effects.items():
        alone = frames.apply(df, name, 6, start=1, stop=5, **params).collect()
        assert sorted(every.filter(every.effect == name).drop("effect").collect()) == sorted(alone)
    assert set(frames.means(every).columns) == {"video_id", "frame_idx", "red", "green", "blue", "effect"}
