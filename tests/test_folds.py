"""Folds over keys of any size, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, transcript


def numbered(weights, budget):
    t, k, out = None, -1, []
    for w in weights:
        t, k = (t + w, k) if k >= 0 and t + w <= budget else (w, k + 1)
        out.append(k)
    return out


@pytest.mark.parametrize("choices", [[0, 1, 3, 7, 12, 50], [0.1, 0.2, 0.7], [0], [40, 41]])
def test_budget_groups_of_a_key_over_many_ranges(spark, choices):
    draw = random.Random(3)
    rows = [(None if k == 2 else k, i, float(draw.choice(choices))) for k, n in ((0, 3000), (1, 1), (2, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, w double").repartition(7)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): r.group for r in folds.budget_groups(df, ["k"], ["i"], "w", 20.0).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = {}
    for k in (0, 1, None):
        mine = sorted((i, w) for key, i, w in rows if key == k)
        want.update({(k, i): g for (i, _), g in zip(mine, numbered([w for _, w in mine], 20.0))})
    assert got == want


def test_a_fold_of_one_large_key_holds_its_state_alone(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 2).cast("double").alias("v"))
    out = folds.smoothed(df, ["k"], ["i"], "v", 0.5)
    last = out.filter(F.col("i") == n - 1).first()
    assert out.count() == n and abs(last.smoothed - 2 / 3) < 1e-9


def test_short_scenes(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 6.0), (1, 6.0, 9.0), (1, 9.0, 9.5), (2, 0.0, 0.5)], "k long, start double, end double")
    got = sorted(tuple(r) for r in folds.merge_short(df, ["k"], 2.0).collect())
    assert got == [(1, 0, 0.0, 5.0), (1, 1, 5.0, 9.5), (2, 0, 0.0, 0.5)]


def test_followed_and_distinct(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, None), (1, 3, 3.0)], "k long, i long, v double")
    assert [r.position for r in folds.followed(df, ["k"], ["i"], "v", 2.0).orderBy("i").collect()] == [0.0, 2.0, 2.0, 3.0]
    codes = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, -1), (1, 3, None), (1, 4, -2)], "k long, i long, c long")
    assert sorted(r.i for r in folds.distinct_hashes(codes, ["k"], "i", "c", 1).collect()) == [0, 2, 3]


def test_vocabulary_within_a_budget(spark):
    df = spark.createDataFrame([("aa", 1), ("AA", 2), ("bbb", 3), ("c", 4)], "t string, p long")
    assert sorted(r.term for r in transcript.vocabulary(df, "t", "p", 8).collect()) == ["aa", "bbb"]


def test_crop_track_moves_in_a_straight_line_and_stays_inside(spark):
    rows = [(1, n, 100, 50, *face) for n, face in enumerate([(None, None), (None, None), (0.9, 0.5), (None, None), (0.9, 0.9), (0.1, 0.5)])]
    df = spark.createDataFrame(rows, "k int, n int, frame_w int, frame_h int, cx double, cy double")
    track = folds.crop_track(df, ["k"], "n", (1, 2), 0.0, 1, 0.5, "center", 0.0).orderBy("n").collect()
    assert {(r.crop_width, r.crop_height) for r in track} == {(24, 50)}
    # 24 x 50 of 100 x 50: centred until a face is seen, then half a frame a step at most, along the line, and inside
    assert [(r.crop_x, r.crop_y) for r in track] == [(38, 0), (38, 0), (76, 0), (76, 0), (76, 0), (33, 0)]
    centre = folds.crop_track(df, ["k"], "n", (1, 2), 0.0, 1, 0.5, "center", 0.0, "center").orderBy("n").collect()
    assert centre[3].crop_x == 38
    held = folds.crop_track(df, ["k"], "n", (1, 2), 0.0, 2, None, "center", 0.0).orderBy("n").collect()
    assert [r.crop_x for r in held] == [38, 38, 76, 76, 76, 76]
    assert folds.crop_track(df, ["k"], "n", (16, 9)).first().crop_height == 50


def test_tracks_of_pieces_equal_tracks_of_whole_shots(spark):
    import random

    rng, rows, looked = random.Random(3), [], []
    for frame in range(120):
        looked.append((1, frame))
        if frame % 30 < 20 and rng.random() < 0.6:
            rows += [(1, frame, d, 0.15 * d + rng.random() * 0.15, rng.random() * 0.1, 0.3, 0.3) for d in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "shot int, frame_idx long, det_idx long, x double, y double, width double, height double")
    frames = spark.createDataFrame(looked, "shot int, frame_idx long")
    got = {(r.frame_idx, r.det_idx): r.track_id for r in folds.tracks(df, ["shot"], 0.3, 2, frames).collect()}
    whole = frames.join(df, ["shot", "frame_idx"], "left").toPandas()
    wanted = folds._tracks(0.3, 2, ["shot"])(whole)
    assert got == {(r.frame_idx, r.det_idx): r.track_id for r in wanted.itertuples()}
