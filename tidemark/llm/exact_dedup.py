"""Exact duplicates by skew-safe combining of digest groups, in DataFrame operations only.

A text's key is the SHA-256 of its normalised form (A-Z lower-cased), but each
stage also groups by the whole normalised text, so two texts that only share a
digest never merge:

1. locally, Spark's map-side aggregation folds the copies within a task;
2. the salted groups (digest, text, salt of doc_id) merge on many tasks, so that
   a text which a third of all rows hold is spread;
3. the winners of the salts combine globally, a few rows per digest.

Documents then look their group up by (digest, salt) without moving their texts.
Were a digest ever shared by different texts, the documents of those digests
alone are matched by text as well.

Defined results: null text counts as empty and equals empty; a null doc_id loses
to any other; repeated rows with the same doc_id are one document and get the
same answer (deduplicate() returns one of them); an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, only, salts_for, staged


def _sha256(column) -> F.Column:
    return F.sha2(column, 256)


def duplicate_groups(docs: DataFrame, digest=_sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text). digest: another key, for tests."""
    salts = salts_for(docs.count())
    keyed = only(docs, "doc_id", "text").select("doc_id", ascii_lower(F.col("text")).alias("norm")).select(
        "doc_id", "norm", digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = keyed.groupBy("digest", "norm", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("held")
    )
    # the same digest twice here means different texts; the text is kept for those alone
    texts = merged.groupBy("digest").agg(
        F.collect_list(F.struct("keep_id", "group_size", "held")).alias("groups"), F.count(F.lit(1)).alias("texts")
    )
    table = staged(
        texts.select("digest", "texts", F.explode("groups").alias("g"))
        .select("digest", "texts", "g.keep_id", "g.group_size", F.explode("g.held").alias("salt")),
        "exact-groups",
    )
    clashes = table.filter("texts > 1").select("digest").distinct()
    found = keyed.select("doc_id", "digest", "salt").join(table.filter("texts = 1").drop("texts"), ["digest", "salt"])
    out = found.select("doc_id", "keep_id", "group_size", "digest")
    if not clashes.isEmpty():
        rest = keyed.join(clashes, "digest", "left_semi")
        groups = rest.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(rest.join(groups, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one."""
    groups = duplicate_groups(docs).filter("kept").select("doc_id", "text_sha256")
    kept = staged(groups.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times")), "exact-kept")
    digest = fresh(docs, "digest")
    rows = docs.withColumn(digest, _sha256(ascii_lower(F.col("text"))))
    names = [fresh(rows, "winner"), fresh(rows, "winner_digest")]
    winners = kept.select(F.col("doc_id").alias(names[0]), F.col("text_sha256").alias(names[1]))
    rows = rows.join(winners, rows["doc_id"].eqNullSafe(winners[names[0]]) & (rows[digest] == winners[names[1]]), "left_semi")
    if not kept.filter("times > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", digest])
    return rows.drop(digest)
