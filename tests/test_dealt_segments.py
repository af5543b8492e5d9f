"""Segments are dealt by their number, so that a task's sorts don't grow with the table, and meet once."""

from pyspark.sql import functions as F

from tidemark.plans import planning
from tidemark.queries import plans

FOLDER = "/root/testdata/sf0.01"


def test_no_task_sorts_more_segments_in_a_larger_table(spark, monkeypatch):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    for per in (1_000, 10_000):
        monkeypatch.setattr(planning, "TASK_ROWS", per)
        sizes = [r["count"] for r in plans._segments(spark, FOLDER).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == rows and max(sizes) <= 1.5 * per


def test_segments_meet_once(spark, monkeypatch):
    monkeypatch.setattr(planning, "TASK_ROWS", 5_000)
    query = plans.timeline_frames(spark, FOLDER)
    assert query._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    few = sorted(map(tuple, query.collect()))
    monkeypatch.setattr(planning, "TASK_ROWS", 10**9)
    assert sorted(map(tuple, plans.timeline_frames(spark, FOLDER).collect())) == few


def test_no_segments(spark):
    empty = spark.createDataFrame([], "plan_id long, seq int")
    assert planning.dealt_by_rows(empty, "plan_id").count() == 0
