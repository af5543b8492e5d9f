"""Hand-checked cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric, text
from tidemark.operators import folds, frames, intervals, signal, summaries, transcript
from tidemark.plans import planning
from tidemark.sources import audio, documents


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def spans(spark, items, keys="k"):
    return spark.createDataFrame([(1, i, float(s), float(e)) for i, (s, e) in enumerate(items)], f"{keys} int, ord int, start double, end double")


@pytest.mark.parametrize(
    ("items", "duration", "pad", "gap", "want"),
    [
        ([(2, 4)], 10, 0.5, 1, [(1.5, 4.5)]), ([(0.1, 9.8)], 10, 0.5, 1, [(0, 10)]), ([(0, 3), (2, 5)], 10, 0, 1, [(0, 5)]), ([(0, 2), (2.8, 5)], 10, 0, 1, [(0, 5)]),
        ([(0, 2), (8, 10)], 10, 0, 1, [(0, 2), (8, 10)]), ([(8, 9), (1, 2)], 10, 0, 1, [(1, 2), (8, 9)]), ([(2, 2), (3, 4)], 10, 0, 1, [(3, 4)]),
    ],
)
def test_merge_regions(spark, items, duration, pad, gap, want):
    found = intervals.merge_regions(spans(spark, items), ["k"], F.lit(float(duration)), pad, gap)
    assert rows(found, "start", "end") == [tuple(map(float, w)) for w in want]


def test_speech_windows_and_gaps(spark):
    words = spans(spark, [(0.5, 1), (1.1, 1.5), (5, 5.5)])
    speech = intervals.speech_windows(words, ["k"], 0.2, F.lit(8.0), ["ord"])
    assert np.allclose(rows(speech, "start", "end"), [(0.3, 1.7), (4.8, 5.7)])
    assert np.allclose(rows(intervals.complement(speech, ["k"], F.lit(8.0), 1.0), "start", "end"), [(1.7, 4.8), (5.7, 8.0)])


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([("Music", 0, 0.5, 0.8), ("Music", 0.5, 1, 0.9), ("Music", 1, 1.5, 0.7)], [("Music", 0.0, 1.5, 0.9)]),
        ([("Music", 0, 0.5, 0.8), ("Speech", 0.5, 1, 0.9)], [("Music", 0.0, 0.5, 0.8), ("Speech", 0.5, 1.0, 0.9)]),
        ([("Music", 0, 0.5, 0.8), ("Music", 2, 2.5, 0.9)], [("Music", 0.0, 0.5, 0.8), ("Music", 2.0, 2.5, 0.9)]),
    ],
)
def test_merge_events(spark, items, want):
    df = spark.createDataFrame([(i, la, float(s), float(e), c) for i, (la, s, e, c) in enumerate(items)], "event_id int, label string, start double, end double, confidence double")
    assert rows(intervals.merge_events(df, ["label"], 0.5), "label", "start", "end", "confidence") == want


def test_tiles(spark):
    cue = spark.createDataFrame([(1, 0.4, 3.5, i, s, e) for i, (s, e) in enumerate([(0.5, 1.2), (1.5, 2.4), (2.8, 3.5)])], "k int, cue_start double, cue_end double, ord int, start double, end double")
    got = sorted(intervals.tiles(cue, ["k"], "ord").collect(), key=lambda r: r.start_cs)
    assert [(r.start_cs, r.end_cs, r.highlight) for r in got] == [(40, 50, None), (50, 120, 0), (120, 150, None), (150, 240, 1), (240, 280, None), (280, 350, 2)]
    clash = spark.createDataFrame([(1, 0.0, 1.0, 0, 0.0, 0.6), (1, 0.0, 1.0, 1, 0.5, 1.0)], cue.schema)
    assert rows(intervals.tiles(clash, ["k"], "ord"), "start_cs", "end_cs", "highlight") == [(0, 60, 0), (60, 100, 1)]


def test_slice_keeps_whole_words(spark):
    words = spans(spark, [(0, 2), (2, 4)])
    assert rows(intervals.sliced(words, 1.0, 3.0), "start", "end") == [(-1.0, 1.0), (1.0, 3.0)]
    assert intervals.sliced(words, 3.0, 3.0).count() == 0


def test_attach_by_overlap(spark):
    t = spark.createDataFrame([(1, 1, 3.0, 8.0), (1, 2, 20.0, 25.0)], "k int, id int, start double, end double")
    s = spark.createDataFrame([(1, 1, 0.0, 4.0, -0.3), (1, 2, 4.0, 10.0, -1.5)], "k int, id int, start double, end double, logprob double")
    found = {r.id: r.logprob for r in intervals.attach_by_overlap(t, s, ["k"], "id", "id", ["logprob"], 2.0).collect()}
    assert found == {1: -1.5, 2: None}


def words(spark):
    items = [("Hello", 0, 0.5), ("world", 0.5, 1), ("this", 1, 1.2), ("is", 1.2, 1.4), ("test", 1.4, 1.8), ("Second", 2, 2.3), ("segment", 2.3, 2.8), ("of", 2.8, 3), ("transcription", 3, 3.5), ("Final", 5, 5.4), ("words", 5.4, 5.8), ("in", 5.8, 6.2), ("video", 6.2, 6.8)]
    return spark.createDataFrame([(1, i, w, float(s), float(e), None) for i, (w, s, e) in enumerate(items)], "k int, ord int, word string, start double, end double, speaker string")


def test_standardise(spark):
    by = sorted(transcript.by_count(words(spark), ["k"], ["ord"], 2).collect(), key=lambda r: r.start)
    assert len(by) == 7 and (by[0].text, by[0].start, by[0].end) == ("Hello world", 0.0, 1.0) and by[-1].text == "video"
    timed = transcript.by_time(words(spark), ["k"], "ord", 1.5)
    assert timed.filter("group = 0").count() == 4


def test_speaker_shares(spark):
    df = spark.createDataFrame([(1, "S0", 0.0, 1.0), (1, "S0", 1.0, 2.0), (1, "S1", 2.0, 3.0), (1, None, 3.0, 9.0)], "k int, speaker string, start double, end double")
    assert {r.speaker: round(r.share, 6) for r in transcript.speaker_shares(df, ["k"]).collect()} == {"S0": 0.666667, "S1": 0.333333}


@pytest.mark.parametrize(
    ("items", "duration", "verdict"),
    [
        ([("one fine day", 0, 15, -0.3), ("two", 15, 30, -0.3), ("three men", 30, 45, -0.3), ("four", 45, 60, -0.2)], 60, "ok"),
        ([("Thank you for watching!", i * 10, i * 10 + 5, -0.3) for i in range(11)], 110, "warn"),
        ([("Thank you for watching!", i * 10, i * 10 + 5, -2.0) for i in range(8)], 80, "reject"),
        ([("Thank you.", i * 60, i * 60 + 0.5, -0.3) for i in range(5)], 300, "reject"),
    ],
)
def test_assess(spark, items, duration, verdict):
    df = spark.createDataFrame([(1, i, t, float(s), float(e), p) for i, (t, s, e, p) in enumerate(items)], "k int, ord int, text string, start double, end double, avg_logprob double")
    assert transcript.assess(df, ["k"], F.lit(float(duration)), "ord").first().recommendation == verdict


def test_times_and_colours(spark):
    one = spark.range(1)
    got = one.select(
        text.ass_time(F.lit(3661.456)).alias("a"), text.ass_time(F.lit(59.999)).alias("b"), text.ass_time(F.lit(-1.0)).alias("c"), text.srt_time(F.lit(1.9996)).alias("d"),
        text.ass_color(F.lit(255), F.lit(235), F.lit(59), F.lit(255)).alias("e"), text.ass_color_tag(F.lit(76), F.lit(175), F.lit(80)).alias("f"), text.filter_escape(F.lit("/tmp/a:b'c.ass")).alias("g"),
        text.parse_srt_time(F.lit("01:02:03,500")).alias("h"),
    ).first()
    assert tuple(got) == ("1:01:01.46", "0:01:00.00", "0:00:00.00", "00:00:02,000", "&H003BEBFF", "&H50AF4C&", r"'/tmp/a\:b\'c.ass'", 3723.5)


def test_srt_document(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.8, "Hello world this is test"), (1, 1, 2.0, 3.5, "Second")], "k int, ord int, start double, end double, text string")
    doc = transcript.srt_documents(transcript.srt_blocks(seg, ["k"], ["ord"]), ["k"])
    assert doc.first().srt.startswith("1\n00:00:00,000 --> 00:00:01,800\nHello world this is test\n\n2\n")
    assert rows(transcript.parse_srt(doc, ["k"]), "start", "end", "text") == [(0.0, 1.8, "Hello world this is test"), (2.0, 3.5, "Second")]


def test_tracks(spark):
    def run(items, **options):
        df = spark.createDataFrame([(1, f, d, *map(float, b)) for f, d, b in items], "shot int, frame_idx long, det_idx long, x double, y double, width double, height double")
        return rows(folds.tracks(df, ["shot"], **options), "frame_idx", "det_idx", "track_id")

    assert run([(0, 0, (0.10, 0.20, 0.1, 0.1)), (1, 0, (0.11, 0.21, 0.1, 0.1))]) == [(0, 0, 1), (1, 0, 1)]
    assert run([(0, 0, (0.1, 0.1, 0.1, 0.1)), (1, 0, (0.8, 0.8, 0.1, 0.1))], least=0.5) == [(0, 0, 1), (1, 0, 2)]
    apart = [(0, 0, (0.1, 0.1, 0.1, 0.1)), (3, 0, (0.1, 0.1, 0.1, 0.1))]
    frames = spark.createDataFrame([(1, f) for f in range(4)], "shot int, frame_idx long")
    assert run(apart, missed=1, sampled=frames) == [(0, 0, 1), (3, 0, 2)]
    assert run(apart, missed=2, sampled=frames) == [(0, 0, 1), (3, 0, 1)] == run(apart, missed=0)


def test_tracks_by_brute_force(spark):
    """Against a plain reading of the rule over random boxes, several to a frame."""
    rng = np.random.default_rng(7)
    rows_ = [(s, f, d, *rng.uniform(0, 0.6, 2), *rng.uniform(0.2, 0.4, 2)) for s in range(3) for f in range(25) for d in range(rng.integers(0, 4))]
    df = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows_], "shot int, frame_idx long, det_idx long, x double, y double, width double, height double")
    frames = spark.range(25).withColumnRenamed("id", "frame_idx").crossJoin(spark.createDataFrame([(s,) for s in range(3)], "shot int"))
    got = {(r.shot, r.frame_idx, r.det_idx): r.track_id for r in folds.tracks(df, ["shot"], 0.3, 1, frames).collect()}

    def iou(a, b):
        w, h = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    want = {}
    for s in range(3):
        open_, n = {}, 0
        for f in range(25):
            free = {r[2]: r[3:] for r in rows_ if r[:2] == (s, f)}
            for t in list(open_):
                best = max(free, key=lambda d: (iou(open_[t][0], free[d]), -d), default=None)
                if best is not None and iou(open_[t][0], free[best]) > 0.3:
                    want[s, f, best], open_[t] = t, (free.pop(best), 0)
                elif open_[t][1] == 1:
                    del open_[t]
                else:
                    open_[t] = (open_[t][0], open_[t][1] + 1)
            for d, box in free.items():
                n += 1
                want[s, f, d], open_[n] = n, (box, 0)
    assert got == want


def test_timing_summary(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, 1.0, False), (1, 2.0, 1.9, 1.05, False), (1, 2.0, 2.3, 0.85, False), (1, 2.0, 1.5, 1.3, False), (1, 4.0, 2.0, 1.0, True)], "k int, original_duration double, actual_duration double, speed_factor double, was_truncated boolean")
    r = summaries.timing_summary(df, ["k"]).first()
    assert (r.total, r.clean, r.stretched, r.truncated, r.max_truncation) == (5, 1, 3, 1, 2.0)


def test_predicted(spark):
    meta = spark.createDataFrame([(1, 24.0, 800, 500, 288, 12.0)], "video_id int, fps double, width int, height int, frame_count long, total_seconds double")
    count = lambda op, **a: planning.predicted(meta, op, **a).first().frame_count
    assert (count("speed_change", speed=2.0), count("speed_change", speed=0.5), count("speed_change", speed=1.0, end_speed=2.0)) == (144, 576, 192)
    tall = meta.withColumns({"width": F.lit(302), "height": F.lit(540)})
    r = planning.predicted(tall, "resize", width=1080).first()
    assert (r.width, r.height) == (1080, 1932)
    wide = meta.withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    assert planning.predicted(wide, "aspect_crop", ratio=(9, 16)).first().width == 606
    still = meta.withColumns({"fps": F.lit(30.0), "frame_count": F.lit(30).cast("long"), "total_seconds": F.lit(1.0)})
    assert planning.predicted(still, "freeze_frame", timestamp=0.5, duration=1.0).first().frame_count == 60


def test_plan_parsing(spark):
    plan = '{"segments": [{"source": "a.mp4", "start": 0, "end": 5, "operations": [{"op": "blur_effect", "sigma": 2}, {"op": "resize", "width": 320}, {"op": "nope"}]}]}'
    segments, ops = planning.parse(spark.createDataFrame([("p", plan)], "plan_id string, plan string"))
    assert rows(segments, "plan_id", "seq", "source", "start", "end") == [("p", 0, "a.mp4", 0.0, 5.0)]
    assert rows(planning.streamability(ops), "pos", "op", "kind") == [(0, "blur_effect", "frame_effect"), (1, "resize", "filter"), (2, "nope", "unstreamable")]
    late = spark.createDataFrame([(1, 1, k, op) for k, op in enumerate(("speed_change", "add_subtitles", "volume_adjust", "fade", "volume_adjust", "glitch", "text_overlay", "crop", "shake", "face_crop", "cut"))], "plan_id int, seq int, pos int, op string")
    kinds = [r.kind for r in planning.streamability(late).orderBy("pos").collect()]
    assert kinds == ["filter", "unstreamable", "filter", "frame_effect", "filter", "frame_effect", "filter", "filter", "unstreamable", "unstreamable", "unstreamable"]


def test_iou_and_even(spark):
    box = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.2).alias("width"), F.lit(0.2).alias("height"))
    r = spark.range(1).select(numeric.iou(box(0.0), box(0.0)).alias("a"), numeric.iou(box(0.0), box(0.5)).alias("b"), numeric.to_even(F.lit(301.0)).alias("c"), numeric.tempo_stages(F.lit(3.0)).alias("d"), numeric.class_hue(F.lit("cat")).alias("e")).first()
    import hashlib

    assert (r.a, r.b, r.c, r.d, r.e) == (1.0, 0.0, 300, [2.0, 1.5], int(hashlib.md5(b"cat").hexdigest(), 16) % 360)


def test_audio_round_trip(spark, tmp_path):
    tone = np.sin(np.arange(800) / 5) * 0.5
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(tone, 8000, 1))
    r = audio.read_audio(spark, str(tmp_path)).first()
    assert (r.sample_rate, r.channels, r.frame_count, r.seconds) == (8000, 1, 800, 0.1) and np.allclose(r.samples, tone, atol=1e-4)


def test_audio_columns(spark):
    df = spark.createDataFrame([([0.5, -0.25, 0.5, 0.25],)], "s array<double>")
    s = F.col("s")
    r = df.select(signal.to_mono(s, 2).alias("m"), signal.peak(signal.normalised(s, -6.0)).alias("p"), signal.overlaid(s, F.array(F.lit(1.0)), 5).alias("o"), signal.joined(s, s, 2).alias("j"), signal.is_silent(F.array(F.lit(0.0))).alias("q")).first()
    assert r.m == [0.125, 0.375] and abs(r.p - 10 ** (-6 / 20)) < 1e-12 and r.o == [0.5, -0.25, 0.5, 0.25, 0.0, 1.0] and len(r.j) == 6 and r.q


def test_kernels():
    frame = np.random.default_rng(0).integers(0, 256, (6, 8, 3)).astype(np.uint8)
    run = lambda name, i=0, n=10, **p: frames.KERNELS[name](**p)(frame, i, n)
    assert (run("mirror_flip") == frame[:, ::-1]).all() and (run("fade", 0) == 0).all() and (run("pixelate", size=1) == frame).all()
    assert (run("zoom_effect", 0, factor=2.0) == frame).all() and run("resize", width=3, height=2).shape == (2, 3, 3)
    for name in set(frames.KERNELS) - {"overlay", "draw_boxes", "crop", "resize"}:
        assert run(name, 3).shape == frame.shape, name


def test_records(spark):
    r = spark.range(1).select(documents.record(F.lit('{"label": "cat"}'), "detection").alias("d")).select("d.label", "d.confidence", "d.box").first()
    assert tuple(r) == ("cat", 1.0, None)
    assert pd.notna(documents.SCHEMAS["media"])
