"""Views of the driver's tables as media data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200.0  #: the first second of the events
TOTAL = 2592000.0  #: and their 30 days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str, widen: float = 1.0) -> DataFrame:
    """Events as labelled intervals of seconds: [t, t + value * widen)."""
    ev = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH
    return ev.select("event_id", "user_id", F.col("event_type").alias("label"), start.alias("start"), F.coalesce("value", F.lit(0.0)).alias("confidence")).withColumn(
        "end", F.col("start") + F.col("confidence") * widen
    )


def spans_sql(widen: float = 1.0, name: str = "ev") -> str:
    return f"""{name} AS (SELECT event_id, user_id, event_type AS label, epoch_us(ts) / 1e6::DOUBLE - {EPOCH} AS start, coalesce(value, 0)::DOUBLE AS confidence,
                   epoch_us(ts) / 1e6::DOUBLE - {EPOCH} + coalesce(value, 0)::DOUBLE * {widen} AS "end" FROM events)"""


BOX = 4  #: numbers of a box


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as detections: a shot is ten vectors, each a frame with a box for every four of its numbers."""
    k = F.col("det_idx").cast("int") * BOX
    unit = lambda i: F.abs(F.get("embedding", k + i).cast("double")) - F.floor(F.abs(F.get("embedding", k + i).cast("double")))
    count = F.floor(F.size("embedding") / BOX)
    rows = table(spark, sf_dir, "embeddings").filter(count > 0).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("det_idx"))
    return rows.select(
        F.floor(F.col("vec_id") / 10).alias("shot"), F.col("vec_id").alias("frame_idx"), "det_idx", (unit(0) * 0.5).alias("x"), (unit(1) * 0.5).alias("y"), (unit(2) * 0.3 + 0.2).alias("width"), (unit(3) * 0.3 + 0.2).alias("height")
    )


_UNIT = lambda i: f"(abs(embedding[4 * k + {i}]::DOUBLE) - floor(abs(embedding[4 * k + {i}]::DOUBLE)))"
BOXES_SQL = f"""boxes AS (SELECT vec_id // 10 AS shot, vec_id AS frame_idx, k AS det_idx, {_UNIT(1)} * 0.5 AS x, {_UNIT(2)} * 0.5 AS y,
    {_UNIT(3)} * 0.3 + 0.2 AS width, {_UNIT(4)} * 0.3 + 0.2 AS height FROM embeddings, unnest(range(0, len(embedding) // 4)) AS u(k))"""
