"""Backends as fakes: batches, failures, timing and the mixed track."""

from pyspark.sql import functions as F

from tidemark.operators import backends


def shout():
    return lambda row: {"texts": [t.upper() for t in row["texts"]]}


def beep():
    def speak(row):
        if "bad" in row["text"].lower():
            raise ValueError("no voice")
        return {"samples": [0.5] * (10 * len(row["text"]))}

    return speak


def test_translate_and_dub(spark):
    rows = [(1, 0, 0.0, 1.0, "hello", "a"), (1, 1, 1.0, 2.0, "?", None), (1, 2, 2.0, 4.0, "bad one", "b"), (1, 3, 4.0, 4.05, "short", "b"), (1, 4, 5.0, 6.0, "fine", None)]
    segments = spark.createDataFrame(rows, "k int, ord int, start double, end double, text string, speaker string")
    done = backends.translate(segments, ["k"], "ord", shout, budget=60.0)
    assert {r.ord: r.translated for r in done.collect()} == {0: "HELLO", 1: "", 2: "BAD ONE", 3: "SHORT", 4: "FINE"}
    timing, track = backends.dub(done, ["k"], "ord", beep, 50)
    assert {r.ord: (r.original_duration, r.speed_factor, r.was_truncated) for r in timing.collect()} == {0: (1.0, 1.0, False), 4: (0.8, 0.8, False)}
    assert track.count() == 50 + 40 and track.agg(F.min("idx")).first()[0] == 0


def test_failures_are_results(spark):
    rows = spark.createDataFrame([(1, "bad"), (2, "ok")], "k int, text string")
    got = {r.k: (r.samples is None, r.error) for r in backends.run(rows, beep, ["text"], "samples array<double>", ["k"]).collect()}
    assert got == {1: (True, "ValueError: no voice"), 2: (False, None)}


def test_regions_and_vocabulary(spark):
    words = spark.createDataFrame([(1, 10.0, 0.1, 9.8), (2, 100.0, 2.0, 4.0)], "k int, d double, start double, end double")
    assert sorted(tuple(r) for r in backends.speech_regions(words, ["k"], "d").collect()) == [(1, 0.0, 10.0), (2, 1.5, 4.5)]
    terms = spark.createDataFrame([("alpha", 1), ("beta", 2), ("gamma", 3)], "term string, pos int")
    assert backends.vocabulary_prompt(terms, 13) == "alpha, beta"
