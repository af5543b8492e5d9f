"""Aggregations and top-k selection over timing, predictions, segments and catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timing_summary(adjustments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of clean, stretched and truncated clips, mean speed, and the longest cut."""
    cut, speed = F.col("was_truncated"), F.col("speed_factor")
    clean = ~cut & (F.abs(speed - 1) <= 0.01)
    return adjustments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("clean"), F.count_if(F.abs(speed - 1) > 0.01).alias("stretched"), F.count_if(cut).alias("truncated"),
        F.coalesce(F.avg("speed_factor"), F.lit(1.0)).alias("mean_speed_factor"),
        F.coalesce(F.max(F.when(cut, F.greatest(F.lit(0.0), F.col("original_duration") - F.col("actual_duration")))), F.lit(0.0)).alias("max_truncation"),
    )


def clip_predictions(chunks: DataFrame, keys: Sequence[str], top: int = 10, least: float = 0.3) -> DataFrame:
    """The labels of the highest mean probability over a clip's chunks, `top` at most, `least` at least. chunks: keys, label, prob."""
    mean = chunks.groupBy(*keys, "label").agg(F.avg("prob").alias("prob"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("prob").desc(), "label"))
    return mean.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("prob") >= least))


def conform_target(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lowest fps, width and height of a plan's segments, each by itself; null with fewer than two."""
    some = F.count(F.lit(1)) > 1
    return segments.groupBy(*keys).agg(*[F.when(some, F.min(c)).alias(c) for c in ("fps", "width", "height")])


def assembled(segments: DataFrame, keys: Sequence[str], order: str, fps: Column) -> DataFrame:
    """Frames and seconds of a timeline: the sum of its segments' frames less the overlaps of all but the first."""
    rows = segments.withColumns({"__first": F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1, "__fps": fps})
    frames = F.sum("frames") - F.sum(F.when(F.col("__first"), F.lit(0)).otherwise(F.col("overlap")))
    return rows.groupBy(*keys).agg(frames.cast("long").alias("frames"), F.round(frames / F.max("__fps"), 4).alias("seconds"))


def dimension_target(segments: DataFrame, keys: Sequence[str], order: str, rule: str = "largest") -> DataFrame:
    """The size that a plan's segments are brought to: of the first, or the largest by area, the first of equal ones."""
    by = F.col(order) if rule == "first" else F.struct((-F.col("width") * F.col("height")).alias("a"), order)
    return segments.groupBy(*keys).agg(F.min_by(F.struct("width", "height"), by).alias("x")).select(*keys, "x.width", "x.height")


def voice_samples(segments: DataFrame, keys: Sequence[str], order: str, best: float = 6.0, longest: float = 10.0) -> DataFrame:
    """The segment to sample each speaker's voice from: highest score, where a score is, else the longest; cut to `longest` seconds.

    segments: keys, start, end, rms, background_rms, peak.
    """
    duration = F.col("end") - F.col("start")
    usable = (duration > 0) & (F.col("peak") < 0.99) & ((F.col("background_rms") <= 0) | (F.col("rms") / F.col("background_rms") >= 1.5))
    scored = segments.withColumns({"duration": duration, "score": F.when(usable, F.col("rms") - 0.05 * F.abs(duration - best))})
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col("duration").desc(), order)
    return scored.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*keys, order, "score", "start", F.least("end", F.col("start") + longest).alias("end"))


def select_face(faces: DataFrame, keys: Sequence[str], strategy: str = "largest") -> DataFrame:
    """One face per key: the largest, or the one nearest the middle. faces: keys, det_idx, x, y, width, height."""
    cx, cy = F.col("x") + F.col("width") / 2 - 0.5, F.col("y") + F.col("height") / 2 - 0.5
    by = (-F.col("width") * F.col("height")) if strategy == "largest" else cx * cx + cy * cy
    return faces.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(by, "det_idx"))).filter("__n = 1").drop("__n")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def resolve(plan: DataFrame, catalog: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """A plan's rows with their catalog entry (the last of equal ids), and the distinct ids that the catalog lacks."""
    one = catalog.groupBy(ident).agg(F.max_by(F.struct(*[c for c in catalog.columns if c not in (ident, "ord")]), "ord").alias("__c"))
    found = plan.join(one, ident, "left")
    return found.filter("__c is not null").select(*plan.columns, "__c.*"), found.filter("__c is null").select(ident).distinct()
