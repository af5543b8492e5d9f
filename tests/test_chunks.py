"""Chunked audio gives what the one-array forms give, for any size of chunk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks, signal

RNG = np.random.default_rng(8)
CLIPS = [(k, RNG.uniform(-1, 1, n).tolist()) for k, n in ((1, 1), (2, 7), (3, 64), (4, 150), (5, 0))]
SCHEMA = "clip int, samples array<double>"


def arrays(df):
    return {r.clip: [round(x, 9) for x in r.samples] for r in df.collect()}


def same(got, wanted):
    got, wanted = arrays(got), {k: v for k, v in arrays(wanted).items() if v}
    assert got.keys() == wanted.keys()
    for k in got:
        assert len(got[k]) == len(wanted[k]) and np.allclose(got[k], wanted[k], atol=1e-8), k


@pytest.mark.parametrize("size", [1, 5, 64])
def test_equal_to_one_array(spark, size):
    clips = spark.createDataFrame(CLIPS, SCHEMA).cache()
    rows, keys, s = chunks.chunked(clips, ["clip"], "samples", size).cache(), ["clip"], F.col("samples")
    same(chunks.whole(rows, keys), clips)
    same(chunks.whole(chunks.normalised(rows, keys), keys), clips.select("clip", signal.normalised(s).alias("samples")))
    same(chunks.whole(chunks.normalised(rows, keys, -9.0, "rms"), keys), clips.select("clip", signal.normalised(s, -9.0, "rms").alias("samples")))
    same(chunks.whole(chunks.cut(rows, keys, size, 10, 0.32, 4.96), keys), clips.select("clip", F.slice(s, 4, 46).alias("samples")))
    long = clips.filter("clip >= 2")
    parts = rows.filter("clip >= 2")
    same(chunks.whole(chunks.joined(parts, parts, keys, size, 6), keys), long.filter("clip < 5").select("clip", signal.joined(s, s, 6).alias("samples")))
    same(chunks.whole(chunks.joined(rows, rows, keys, size), keys), clips.select("clip", signal.joined(s, s).alias("samples")))
    same(chunks.whole(chunks.overlaid(rows, rows, keys, size, 70), keys), clips.filter("clip < 5").select("clip", signal.overlaid(s, s, 70).alias("samples")))
    got = {(r.clip, r.window): (round(r.rms, 9), round(r.peak, 9)) for r in chunks.windows(rows, keys, size, 20, 7).collect()}
    assert got == {(r.clip, r.window): (round(r.rms, 9), round(r.peak, 9)) for r in signal.windows(clips, keys, "samples", 20, 7).collect()}
    levels = {r.clip: (r.length, round(r.rms, 9), round(r.peak, 9)) for r in chunks.levels(rows, keys).collect()}
    assert levels == {k: (len(x), round(math.sqrt(np.mean(np.square(x))), 9), round(max(map(abs, x)), 9)) for k, x in CLIPS if x}


def test_a_side_without_the_clip(spark):
    a = chunks.chunked(spark.createDataFrame([(1, [0.5] * 5), (2, [0.25] * 3)], SCHEMA), ["clip"], "samples", 4)
    b = chunks.chunked(spark.createDataFrame([(2, [0.5] * 3), (3, [1.0] * 2)], SCHEMA), ["clip"], "samples", 4)
    assert arrays(chunks.whole(chunks.joined(a, b, ["clip"], 4, 2), ["clip"])) == {1: [0.5] * 5, 2: [0.25, 0.25, 0.125 + 0.25, 0.5], 3: [1.0] * 2}


def loop(t, terms):
    for start, end, low, high, shape in terms:
        if start <= t <= end:
            share = (t - start) / (end - start) if end > start else 0.0
            share = math.sqrt(share) if shape == "rise" else 1 - math.sqrt(max(0.0, 1 - share)) if shape == "fall" else share
            return low + (high - low) * share
    return 1.0


@pytest.mark.parametrize("size", [3, 50])
def test_envelope_by_a_plain_loop(spark, size):
    """Windows shorter than the attack, overlapping ones and ramps longer than half the change included."""
    speech, rate = [(0.0, 0.1), (0.15, 0.4), (1.0, 1.05), (2.0, 3.0)], 20
    terms = [t for s, e in speech for t in ((s, s + 0.2, 1, 0.2, "line"), (s + 0.2, e, 0.2, 0.2, "line"), (e, e + 0.5, 0.2, 1, "line"))]
    terms += [(2.5, 2.5 + 1, 1, 2, "rise"), (3.5, 3.5, 2, 2, "line"), (3.5, 4.5, 2, 1, "fall")]
    x = [1.0] * 150
    clips = spark.createDataFrame([(1, x), (2, x)], SCHEMA)
    duck = [F.array(chunks.duck_terms(F.lit(s), F.lit(e), 0.8, 0.2, 0.5)) for s, e in speech]
    flat = F.flatten(F.concat(*duck, F.array(chunks.volume_terms(F.lit(2.5), F.lit(4.5), F.lit(2.0), 9.0))))
    rows = spark.range(1, 2).select(F.col("id").cast("int").alias("clip"), F.posexplode(flat).alias("ord", "term"))
    got = arrays(chunks.whole(chunks.enveloped(chunks.chunked(clips, ["clip"], "samples", size), rows, ["clip"], size, rate), ["clip"]))
    assert np.allclose(got[1], [loop(i / rate, terms) for i in range(150)], atol=1e-9) and got[2] == x
