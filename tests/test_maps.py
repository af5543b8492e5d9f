"""Which source frame each frame shows: speed ramps, freezes and timelines with fades, against plain loops; and values that were wrong."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators import folds, transcript
from tidemark.plans import planning


def media(spark, frames=20, fps=10.0):
    return spark.createDataFrame([(1, fps, 64, 36, frames, frames / fps)], "video_id int, fps double, width int, height int, frame_count long, total_seconds double")


def shown(df):
    return [r.src_idx for r in df.orderBy("frame_idx").collect()]


@pytest.mark.parametrize("first,last", [(1.0, 1.0), (2.0, 2.0), (1.7, 1.7), (0.5, 0.5), (0.5, 2.0), (3.0, 1.5)])
def test_speed(spark, first, last):
    n = 20
    size = int(n / ((first + last) / 2))

    def due(i):
        if first == last:
            return i / first + max(0.0, (first - 1) / (2 * first))
        return size * math.log(1 + (last - first) * i / (first * n)) / math.log(last / first)

    wanted = [max([i for i in range(n) if due(i) < j + 0.5 - 1e-9] or [0]) for j in range(size)]
    args = {"speed": first} | ({"end_speed": last} if first != last else {})
    got = planning.index_map(media(spark), "speed_change", **args)
    assert shown(got) == wanted and planning.predicted(media(spark), "speed_change", **args).first().frame_count == size


@pytest.mark.parametrize("position", ["before", "after", "replace"])
@pytest.mark.parametrize("at,seconds", [(0.0, 0.3), (0.84, 0.5), (1.95, 1.0), (1.2, 0.04)])
def test_freeze(spark, position, at, seconds):
    frames, first, held = list(range(20)), min(round(at * 10), 19), round(seconds * 10)
    rest = frames[first + held :] if position == "replace" else frames[first:]
    wanted = frames[:first] + [first] * held + rest
    args = {"timestamp": at, "duration": seconds, "position": position}
    assert shown(planning.index_map(media(spark), "freeze_frame", **args)) == wanted
    assert planning.predicted(media(spark), "freeze_frame", **args).first().frame_count == len(wanted)


def test_timeline(spark):
    seg = spark.createDataFrame([(1, 0, 4, 9), (1, 1, 5, 2), (1, 2, 3, 0), (1, 3, 6, 1), (2, 0, 2, 0)], "plan int, seq int, frames long, overlap long")
    got = planning.timeline_map(seg, ["plan"], "seq").orderBy("plan", "frame_idx").collect()
    wanted = [[(0, k, None, None, None) for k in range(4)]]
    for seq, frames, lap in ((1, 5, 2), (2, 3, 0), (3, 6, 1)):
        ends = wanted[-1][len(wanted[-1]) - lap :] if lap else []
        wanted[-1] = wanted[-1][: len(wanted[-1]) - lap]
        wanted.append([(a, i, seq, k, k / lap) for k, (a, i, *_) in enumerate(ends)] + [(seq, k, None, None, None) for k in range(lap, frames)])
    flat = [x for part in wanted for x in part]
    assert [tuple(r)[3:] for r in got if r.plan == 1] == flat and [r.frame_idx for r in got if r.plan == 1] == list(range(15))
    assert [r.group for r in got if r.plan == 1] == [0] * 2 + [1] * 7 + [2] * 6


def test_smoothing_of_one_key_over_many_ranges(spark):
    import random

    rng = random.Random(1)
    rows = [(k % 2, n, None if rng.random() < 0.4 or n < 30 and k % 2 else rng.random()) for k in range(2) for n in range(400)]
    out = folds.smoothed(spark.createDataFrame(rows, "k int, n int, v double").repartition(7), ["k"], ["n"], "v", 0.7).collect()
    got, last = {(r.k, r.n): r.smoothed for r in out}, {}
    assert len(got) == len(rows)
    for k, n, v in sorted(rows, key=lambda r: r[:2]):
        x = last.get(k)
        last[k] = x if v is None else v if x is None else 0.7 * x + 0.3 * v
        assert (got[k, n] is None) == (last[k] is None) and (last[k] is None or abs(got[k, n] - last[k]) < 1e-9)


def test_duck_under_a_window_shorter_than_the_attack(spark):
    windows = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.1).alias("end")))
    at = lambda t: spark.range(1).select(numeric.duck_gain(F.lit(t), windows, 0.8, 0.2, 0.5).alias("g")).first().g
    assert [round(at(t), 9) for t in (0.05, 0.15, 0.2, 0.35, 0.6, 0.7)] == [0.8, 0.4, 0.2, 0.6, 1.0, 1.0]


def test_aspect_crop_of_odd_sizes(spark):
    odd = spark.createDataFrame([(1, 30.0, 1921, 1081, 30, 1.0)], "video_id int, fps double, width int, height int, frame_count long, total_seconds double")
    a, b = (planning.predicted(odd, "aspect_crop", ratio=r).first() for r in ((9, 16), (21, 9)))
    assert (a.width, a.height, b.width, b.height) == (606, 1080, 1920, 822)


def test_srt_without_spaces_without_arrow_and_of_many_lines(spark):
    many = "\n".join(f"line {i}" for i in range(100_005))
    text = f"1\n00:00:00,000-->00:00:01,500\nHello\n\n2\nno time here\nlost\n\n3\n00:00:02,000 --> 00:00:03,000\n{many}\n"
    got = transcript.parse_srt(spark.createDataFrame([("k", text)], "k string, srt string"), ["k"]).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 1.5), (2.0, 3.0)] and got[0].text == "Hello" and got[1].text == many


def test_repair_of_segments(spark):
    rows = [("p", 1, -1.0, 5.0, 10.0, -2.0, 9.0), ("p", 2, 20.0, 30.0, 10.0, 0.0, 99.0), ("p", 3, 2.0, 10.0005, 10.0, 1.0, 8.001)]
    seg = spark.createDataFrame(rows, "plan_id string, seq int, start double, end double, total_seconds double, window_start double, window_stop double")
    fixed, log = planning.repaired(seg)
    assert [tuple(r)[2:] for r in fixed.orderBy("seq").collect()] == [(0.0, 5.0, 10.0, 0.0, 5.0), (20.0, 30.0, 10.0, 0.0, 99.0), (2.0, 10.0005, 10.0, 1.0, 8.001)]
    assert [tuple(r)[2:] for r in log.collect()] == [
        ("segments[0]", "start", -1.0, 0.0, "segment_negative"), ("segments[0].operations[0]", "window.start", -2.0, 0.0, "window_negative"),
        ("segments[0].operations[0]", "window.stop", 9.0, 5.0, "effect_window_exceeds_duration"),
    ]
    fixed, log = planning.repaired(seg.filter("seq = 2"), clamp_end=True)
    assert [tuple(r)[2:4] for r in fixed.collect()] == [(20.0, 10.0)] and [r.code for r in log.collect()] == ["segment_end_exceeds_source"]


def test_few_videos_are_dealt_over_all_tasks(spark):
    # a file of videos is one task's, though each makes thousands of frames
    few = media(spark).coalesce(1)
    for op, args in (("cut", {"start": 0.2, "end": 1.0}), ("resample_fps", {"fps": 5.0}), ("speed_change", {"speed": 0.5}), ("speed_change", {"speed": 0.5, "end_speed": 2.0}), ("freeze_frame", {"timestamp": 0.5})):
        assert planning.index_map(few, op, **args).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
