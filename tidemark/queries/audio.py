"""Queries of chunked audio: forty vectors in a row are a clip, each vector a chunk of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunks
from .base import table

SIZE, RATE, KEYS = 64, 100, ["clip"]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))))
    clip = F.floor(F.col("vec_id") / 40)
    rows = table(spark, sf_dir, "embeddings").select(clip.alias("clip"), "vec_id", x.alias("samples"))
    number = F.row_number().over(Window.partitionBy("clip").orderBy("vec_id")) - 1
    return rows.select("clip", number.cast("long").alias("chunk"), "samples")


def _summary(rows: DataFrame) -> DataFrame:
    """Of each chunk: its samples' number, sum, and sum weighted by their place."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weighted = F.transform("samples", lambda x, i: x * (i + 1))
    return rows.select("clip", "chunk", F.size("samples").alias("n"), F.round(total(F.col("samples")), 6).alias("total"), F.round(total(weighted), 6).alias("weighted"))


def chunk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of whole clips, as they are and brought to -20 dB."""
    rows = _chunks(spark, sf_dir)
    loud = chunks.levels(chunks.normalised(rows, KEYS, -20.0, "rms"), KEYS).select("clip", F.round("peak", 8).alias("new_peak"))
    return chunks.levels(rows, KEYS).select("clip", "length", F.round("rms", 8).alias("rms"), F.round("peak", 8).alias("peak")).join(loud, "clip")


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 samples every 40, across chunks of 64."""
    found = chunks.windows(_chunks(spark, sf_dir), KEYS, SIZE, 100, 40)
    return found.select("clip", F.col("window").alias("win"), F.round("rms", 8).alias("rms"), F.round("peak", 8).alias("peak"))


def chunk_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies from 1.23 s to 9.87 s of each clip, in chunks of its own."""
    return _summary(chunks.cut(_chunks(spark, sf_dir), KEYS, SIZE, RATE, 1.23, 9.87))


def chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip faded into itself over 50 samples, with its own start laid over it from sample 333 on."""
    rows = _chunks(spark, sf_dir)
    twice = chunks.joined(rows, rows, KEYS, SIZE, 50)
    return _summary(chunks.overlaid(twice, rows.filter("chunk < 3"), KEYS, SIZE, 333))


def chunk_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ducked under two windows, one of them shorter than the attack, then halved with ramps from 5 s to 8 s: the first term that holds counts."""
    rows = _chunks(spark, sf_dir)
    windows = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.lit(1.0).alias("a"), F.lit(1.1).alias("b")), F.struct(F.lit(1).alias("w"), F.lit(3.0).alias("a"), F.lit(4.5).alias("b"))))
    clips = rows.select("clip").distinct()
    duck = clips.select("clip", windows.alias("x")).select("clip", F.col("x.w").alias("w"), F.posexplode(chunks.duck_terms(F.col("x.a"), F.col("x.b"), 0.8, 0.2, 0.5)).alias("k", "term"))
    half = clips.select("clip", F.lit(2).alias("w"), F.posexplode(chunks.volume_terms(F.lit(4.8), F.lit(8.0), F.lit(0.5), 0.4)).alias("k", "term"))
    terms = duck.unionByName(half).select("clip", F.struct("w", "k").alias("ord"), "term")
    return _summary(chunks.enveloped(rows, terms, KEYS, SIZE, RATE))


QUERIES = {f.__name__: f for f in (chunk_levels, chunk_windows, chunk_cut, chunk_join, chunk_envelope)}

_S = """v AS (SELECT floor(vec_id / 40)::BIGINT AS clip, row_number() OVER (PARTITION BY floor(vec_id / 40) ORDER BY vec_id) - 1 AS c, embedding FROM embeddings),
        s AS (SELECT clip, c * 64 + i - 1 AS i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, embedding[i]::DOUBLE)) AS x FROM v, unnest(range(1, len(embedding) + 1)) AS u(i)),
        n AS (SELECT clip, count(*) AS n, sqrt(sum(x * x) / count(*)) AS rms, max(abs(x)) AS peak FROM s GROUP BY clip)"""
_SUM = lambda rows: f"""SELECT clip, i // 64 AS chunk, count(*)::INT AS n, round(sum(x), 6) AS total, round(sum(x * (i % 64 + 1)), 6) AS weighted FROM {rows} GROUP BY clip, i // 64"""

ORACLE_SQL = {
    "chunk_levels": f"""WITH {_S} SELECT clip, n AS length, round(rms, 8) AS rms, round(peak, 8) AS peak, round(least(1, peak * (0.1::DOUBLE / rms)), 8) AS new_peak FROM n""",
    "chunk_windows": f"""WITH {_S}, w AS (SELECT clip, k FROM n, unnest(range(0, (n - 100) // 40 + 1)) AS u(k) WHERE n >= 100)
        SELECT clip, k AS win, round(sqrt(sum(x * x) / 100), 8) AS rms, round(max(abs(x)), 8) AS peak FROM w JOIN s USING (clip) WHERE i >= k * 40 AND i < k * 40 + 100 GROUP BY clip, k""",
    "chunk_cut": f"""WITH {_S}, p AS (SELECT clip, i - 123 AS i, x FROM s WHERE i >= 123 AND i < trunc(9.87::DOUBLE * 100)) {_SUM("p")}""",
    "chunk_join": f"""WITH {_S},
        t AS (SELECT clip, i, CASE WHEN i >= n - 50 THEN x * (1 - (i - (n - 50)) / 50.0::DOUBLE) ELSE x END AS x FROM s JOIN n USING (clip)
          UNION ALL SELECT clip, i + n - 50, CASE WHEN i < 50 THEN x * (i / 50.0::DOUBLE) ELSE x END FROM s JOIN n USING (clip)
          UNION ALL SELECT clip, i + 333, x FROM s WHERE i < 192),
        m AS (SELECT clip, i, sum(x) AS x FROM t GROUP BY clip, i), top AS (SELECT clip, greatest(1, max(abs(x))) AS top FROM m GROUP BY clip),
        o AS (SELECT clip, i, x / top AS x FROM m JOIN top USING (clip)) {_SUM("o")}""",
    "chunk_envelope": f"""WITH {_S}, g AS (SELECT clip, i, x, i / 100.0::DOUBLE AS t FROM s),
        o AS (SELECT clip, i, x * CASE WHEN t BETWEEN 1 AND 1.2::DOUBLE THEN 1 - 0.8::DOUBLE * (t - 1) / 0.2::DOUBLE WHEN t BETWEEN 1.1::DOUBLE AND 1.6::DOUBLE THEN 0.2::DOUBLE + 0.8::DOUBLE * (t - 1.1::DOUBLE) / 0.5::DOUBLE
          WHEN t BETWEEN 3 AND 3.2::DOUBLE THEN 1 - 0.8::DOUBLE * (t - 3) / 0.2::DOUBLE WHEN t BETWEEN 3.2::DOUBLE AND 4.5::DOUBLE THEN 0.2 WHEN t BETWEEN 4.5::DOUBLE AND 5 THEN 0.2::DOUBLE + 0.8::DOUBLE * (t - 4.5::DOUBLE) / 0.5::DOUBLE
          WHEN t BETWEEN 4.8::DOUBLE AND 5.2::DOUBLE THEN 1 - 0.5::DOUBLE * sqrt((t - 4.8::DOUBLE) / 0.4::DOUBLE) WHEN t BETWEEN 5.2::DOUBLE AND 7.6::DOUBLE THEN 0.5
          WHEN t BETWEEN 7.6::DOUBLE AND 8 THEN 1 - 0.5::DOUBLE * sqrt(greatest(0, (8 - t) / 0.4::DOUBLE)) ELSE 1 END AS x FROM g) {_SUM("o")}""",
}
