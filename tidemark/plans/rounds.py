"""Rounds of planning: a planner proposes plans, what has one obvious repair is repaired, and faults go back to it as text.

The planner is any function of DataFrames, from requests (plan_id, brief, feedback) to
proposals (plan_id, plan as JSON): an expression, a join with plans written elsewhere, or
a model that `backends.run` applies to batches. Only requests whose plan is still at fault
go into the next round, so a round costs what is left of the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import kept
from . import chains
from .planning import prompt_line


def feedback(faults: DataFrame) -> DataFrame:
    """plan_id, feedback: the faults of a plan in order, a line each."""
    line = prompt_line(*[F.col(c) for c in ("code", "location", "op", "field", "value", "limit", "detail")])
    held = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return faults.groupBy("plan_id").agg(F.array_join(held["line"], "\n").alias("feedback"))


def planned(
    requests: DataFrame, planner: Callable[[DataFrame], DataFrame], sources: DataFrame, words: DataFrame | None = None, audio: DataFrame | None = None, rounds: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Good plans (plan_id, plan, round) and what no round made good (plan_id, brief, feedback).

    requests: plan_id, brief. A request that gets no plan back is told so and asked again;
    of several plans for one request any one counts. An end past its source is clamped.
    """
    if rounds < 1:
        raise ValueError("at least one round is needed")
    left = kept(requests.select("plan_id", "brief").withColumn("feedback", F.lit(None).cast("string")))
    done = None
    for number in range(1, rounds + 1):
        proposals = left.select("plan_id").join(planner(left).groupBy("plan_id").agg(F.any_value("plan").alias("plan")), "plan_id", "left")
        good, unread = chains.parsed(kept(proposals))
        fixed, _ = chains.repaired(good, sources, words, clamp_segment_end=True)
        told = kept(feedback(chains.checked(fixed, sources, words, audio).unionByName(unread)))
        now = fixed.join(told.select("plan_id"), "plan_id", "left_anti").withColumn("round", F.lit(number))
        done = now if done is None else done.unionByName(now)
        left = kept(left.select("plan_id", "brief").join(told, "plan_id"))
        if left.isEmpty():
            break
    return done, left
