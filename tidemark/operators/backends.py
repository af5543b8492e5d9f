"""Models behind DataFrames: a backend is built once per task and run on Arrow batches; a row that fails keeps its error.

Transcription, translation, speech, detection, captions and separation differ only
in what goes in and out, so each is a call of `run` with a factory and a schema.
Factories are pickled to the tasks; models are loaded there, not on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from . import folds, intervals, signal


def run(rows: DataFrame, factory: Callable[[], Callable[[dict], dict]], inputs: Sequence[str], outputs: str, keep: Sequence[str]) -> DataFrame:
    """keep, the outputs (DDL) and an error column: the backend maps a row's inputs to its outputs."""
    names = [c.split()[0] for c in outputs.split(", ")]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for batch in batches:
            out: list[dict[str, Any]] = []
            for row in batch.to_dict("records"):
                try:
                    found = backend({c: row[c] for c in inputs}) | {"error": None}
                except Exception as e:  # noqa: BLE001  the failure is the row's result
                    found = dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}
                out.append({k: row[k] for k in keep} | found)
            yield pd.DataFrame(out, columns=[*keep, *names, "error"])

    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(go, f"{kinds}, {outputs}, error string")


def translate(segments: DataFrame, keys: Sequence[str], order: str, factory: Callable[[], Callable[[dict], dict]], budget: float = 2000.0) -> DataFrame:
    """segments with `translated`: texts worth it go to the backend in batches of at most `budget` characters ({"texts": [...]} to {"texts": [...]}), the rest and what failed is ''."""
    worth = segments.filter(text.translatable(F.col("text"))).withColumn("__w", F.length("text") + 40)
    grouped = folds.budget_groups(worth, keys, [order], "__w", budget, "__g").drop("__w").join(segments.select(*keys, order, "text"), [*keys, order])
    batches = grouped.groupBy(*keys, "__g").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("xs")).withColumns({"ids": F.col(f"xs.{order}"), "texts": F.col("xs.text")})
    done = run(batches, factory, ["texts"], "texts array<string>", [*keys, "ids"])
    pairs = done.filter("error is null").select(*keys, F.explode(F.arrays_zip("ids", "texts")).alias("x")).select(*keys, F.col("x.ids").alias(order), F.col("x.texts").alias("translated"))
    return segments.join(pairs, [*keys, order], "left").withColumn("translated", F.coalesce("translated", F.lit("")))


def dub(segments: DataFrame, keys: Sequence[str], order: str, speech: Callable[[], Callable[[dict], dict]], rate: int) -> tuple[DataFrame, DataFrame]:
    """Timing (one row per spoken segment) and mixed samples (keys, idx, value) of translated segments.

    speech maps {"text", "speaker"} to {"samples": [...]} at `rate`. Segments under 0.1 s or without text are skipped, a clip is cut to its adjusted length.
    """
    spoken = segments.filter((F.col("end") - F.col("start") >= 0.1) & (F.trim("translated") != "")).withColumn("speaker", F.coalesce("speaker", F.lit("speaker_0"))).drop("text").withColumnRenamed("translated", "text")
    clips = run(spoken, speech, ["text", "speaker"], "samples array<double>", [*keys, order, "start", "end"]).filter("error is null")
    timed = clips.withColumn("t", numeric.synchronised(F.size("samples") / F.lit(float(rate)), F.col("end") - F.col("start")))
    cut = timed.withColumn("samples", F.slice("samples", F.lit(1), F.greatest(F.lit(1), F.rint(F.col("t.actual_duration") * F.col("t.speed_factor") * rate).cast("int"))))
    return timed.select(*keys, order, "t.*"), signal.assembled(cut, list(keys), rate)


def speech_regions(words: DataFrame, keys: Sequence[str], duration: str, pad: float = 0.5, gap: float = 1.0, whole: float = 0.9) -> DataFrame:
    """The regions to separate; where they cover `whole` of the recording, the recording."""
    merged = intervals.merge_regions(words, [*keys, duration], F.col(duration), pad, gap)
    covered = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(*keys)) / F.col(duration)
    marked = merged.withColumn("__whole", covered >= whole)
    return marked.select(*keys, F.when(F.col("__whole"), F.lit(0.0)).otherwise(F.col("start")).alias("start"), F.when(F.col("__whole"), F.col(duration)).otherwise(F.col("end")).alias("end")).distinct()


def vocabulary_prompt(terms: DataFrame, budget: int) -> str:
    """A transcriber's prompt from the first terms (term, pos) that fit `budget` characters."""
    spent = F.sum(F.length("term") + 2).over(Window.orderBy("pos"))
    fit = terms.filter("term <> ''").orderBy("pos").limit(budget // 3 + 1)  # a term takes three characters at least, so no more can fit
    kept = fit.withColumn("__n", spent).filter(F.col("__n") <= budget).orderBy("pos").select("term").collect()  # bounded by the budget
    return ", ".join(r["term"] for r in kept)
