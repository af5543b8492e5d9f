"""All checks of plans are asked in one pass: segments meet once, and dependent checks of a plan that can't be cut are left out."""

import random

from pyspark.sql import functions as F

from tidemark.plans import planning

SEGMENTS = "plan_id long, seq int, start double, end double, total_seconds double, window_start double, window_stop double, fps double, width int, height int, frames long, transition double"


def rows(plan, n, rng):
    pick = lambda *xs: rng.choice(xs)
    return [(plan, k, pick(0.0, 0.0, 0.0, 0.0, -1.0), pick(4.0, 5.0, 5.0, None), pick(5.0, 5.0, 4.5), pick(0.0, -1.0, 9.0, None), pick(1.0, 0.5, 9.0), pick(24.0, 25.0), pick(2, 4), 2, pick(3, 30), pick(None, 0.5, 0.1)) for k in range(1, n + 1)]


def test_one_shuffle_and_the_single_checks(spark):
    rng = random.Random(8)
    data = [r for p in range(60) for r in rows(p, rng.randrange(1, 5), rng)]
    segments = spark.createDataFrame(data, SEGMENTS)
    found = planning.checked(segments, F.lit(24.0))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    every = found.collect()
    got = sorted(repr(r) for r in found.drop("ord").collect())
    bounds = planning.bounds_errors(segments)
    cut = {r.plan_id for r in bounds.filter("code like 'segment%'").collect()}
    assert 0 < len(cut) < 60
    single = [r for df in (bounds, planning.concat_errors(segments), planning.transition_errors(segments, F.lit(24.0))) for r in df.drop("seq").collect()]
    dependent = lambda r: r.code == "concat_mismatch" or r.field == "transition_in.duration"
    assert got == sorted(repr(r) for r in single if not (dependent(r) and r.plan_id in cut))
    assert any(dependent(r) for r in single if r.plan_id not in cut) and any(dependent(r) for r in single if r.plan_id in cut)
    stage = lambda r: 3 if r.code == "concat_mismatch" else 4 if r.field == "transition_in.duration" else 0 if r.field == "transition_in" else 1 if r.code.startswith("segment") else 2
    for plan in {r[0] for r in data}:
        mine = sorted((r for r in every if r.plan_id == plan), key=lambda r: r.ord)
        assert [r.ord for r in mine] == list(range(1, len(mine) + 1)) and list(map(stage, mine)) == sorted(map(stage, mine))


def test_checks_without_windows(spark):
    segments = spark.createDataFrame([(1, 1, -1.0, 1.0, 5.0, 24.0, 2, 2, 9, 0.5), (None, 1, 0.0, 9.0, 5.0, 24.0, 2, 2, 9, None), (None, 2, 0.0, 1.0, 5.0, 25.0, 2, 2, 9, 5.0)], "plan_id long, seq int, start double, end double, total_seconds double, fps double, width int, height int, frames long, transition double")
    found = planning.checked(segments, F.lit(24.0)).select("plan_id", "ord", "code").collect()
    # rows without a plan_id are a plan as others are: its second segment's rate and transition wait for the first one
    assert sorted(map(tuple, found), key=str) == [(1, 1, "transition_too_long"), (1, 2, "segment_negative"), (None, 1, "segment_end_exceeds_source")]
