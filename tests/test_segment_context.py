"""Segments of hours are dealt to few time buckets."""

import math

from tidemark.operators import intervals, records


def test_half_a_day_is_few_rows(spark, monkeypatch):
    seen = []
    whole = intervals.touching
    monkeypatch.setattr(intervals, "touching", lambda *args: seen.append(args[3]) or whole(*args))
    words = spark.createDataFrame([(1, 7, 10.0, 11.0), (2, 7, 43199.5, 43300.0), (3, 7, 43200.0, 43201.0), (4, 8, 10.0, 11.0), (5, 7, -5.0, 0.0), (6, 7, -5.0, 0.5)], "event_id int, source int, start double, end double")
    segments = spark.createDataFrame([(1, 1, 7, 0.0, 43200.0)], "plan_id int, seq int, source int, first double, last double")
    found = records.segment_context(words, segments).select("event_id", "start").collect()
    assert sorted(map(tuple, found)) == [(1, 10.0), (2, 43199.5), (6, -5.0)]
    assert all(math.floor(43200.0 / b) < 2 for b in seen)
