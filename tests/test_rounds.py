"""Rounds of planning with a planner that learns from what it is told."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import rounds


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("a", 640, 360, 24.0, 480, 20.0)], "source string, width long, height long, fps double, frame_count long, total_seconds double")


def one(start, end, ops="[]"):
    return f'{{"segments":[{{"source":"a","start":{start},"end":{end},"operations":{ops}}}]}}'


def planner(asked):
    """The brief names the behaviour; `slow` and `never` order the bounds wrongly until, for `slow`, the fault is named."""
    plan = (
        F.when(F.col("brief") == "good", one(1, 5)).when(F.col("brief") == "late", one(-1, 90, '[{"op":"shake","window":{"stop":99}}]'))
        .when((F.col("brief") == "slow") & F.col("feedback").contains("SEGMENT_RANGE at segments[0]: end=2, limit 8"), one(2, 8)).when(F.col("brief") == "json", "{")
        .otherwise(one(8, 2))
    )
    return asked.filter("brief <> 'silent'").select("plan_id", plan.alias("plan"))


def test_rounds(spark, sources):
    briefs = ["good", "late", "slow", "never", "json", "silent"]
    requests = spark.createDataFrame(list(enumerate(briefs)), "plan_id int, brief string")
    done, left = rounds.planned(requests, planner, sources, rounds=2)
    assert {(r.plan_id, r.round) for r in done.collect()} == {(0, 1), (1, 1), (2, 2)}
    assert [(s.start, s.end) for r in done.filter("plan_id = 1").collect() for s in r.plan.segments] == [(0.0, 20.0)]
    assert {(r.brief, r.feedback) for r in left.collect()} == {("never", "SEGMENT_RANGE at segments[0]: end=2, limit 8"), ("json", "MALFORMED_PLAN"), ("silent", "MALFORMED_PLAN")}
    done, left = rounds.planned(requests.filter("brief = 'slow'"), planner, sources, rounds=1)
    assert done.count() == 0 and left.count() == 1
    done, left = rounds.planned(requests.filter("brief = 'good'"), planner, sources)
    assert done.count() == 1 and left.count() == 0
