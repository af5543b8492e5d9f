"""Near duplicates from bottom-k sketches of one hash function, verified by exact Jaccard.

A document's set is its distinct w-word shingles, each a 64-bit hash; its sketch
the k smallest of them. Steps:

1. Documents with the same set become one class, of which the smallest doc_id
   stands for the rest.
2. Inverted lists of retained values. Two sets as similar as asked share at least
   `needed` sketch values: the number that a binomial of k draws falls below with
   probability RISK, which bounds the risk of missing a pair here (for small sets
   the bound is exact). So under one order of all values, rarest first, their
   first size - needed + 1 values meet. Only those are listed: a passage that half
   the documents hold enters no list of a document that has enough values of its
   own.
3. Each list compares its members with two pivots, those whose values are the
   most widely held: a copy group costs as many comparisons as it has members.
   Pairs whose union sketch can't reach the threshold (by the same bound) are
   dropped; the others are verified on their full sets and give links and components.
4. Members of lists that still lie in different components meet by prefixes of their
   full sets: of two similar sets, the larger one's first n - ceil(t n) + 1 values and
   the smaller one's first n - ceil(2 t n / (1 + t)) + 1, rarest first, have a value in
   common. Lists of one component are left out. Lists with the same largest component
   and the same first member outside it, such as those of one passage, become one
   group, in which each member counts once. A group compares those outside its largest
   component with all of it, in chunks of CHUNK on full sets, by counting shared values
   in the task: rows grow with the members that are still apart, not with pairs. No
   list is cut.

Defined results: null, empty or blank text has an empty set and links with
nothing; fewer words than a shingle count as one shingle; null doc_ids are left
out of classes and stand alone; repeated rows of one doc_id are one document; an
empty table gives none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, U64, by_batch, fresh, mix, only, runs, salts_for, staged, tokens, word_hashes
from .components import components

RISK = 1e-9  #: of missing a pair that is just similar enough by its sketches
CHUNK = 512  #: members of a group on either side of a comparison in one task
WIDTH = 6  #: bytes kept of each shingle's hash in stored sets


def shingles(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    ends, codes, dictionary = tokens(column, LOWER_TABLE)
    base = word_hashes(dictionary)[codes] if len(codes) else np.zeros(0, U64)
    rolled = np.zeros(len(base), U64)
    for k in range(words):
        rolled[: len(base) - k] = mix(rolled[: len(base) - k] + base[k:] + U64(k + 1))
    out = []
    for s, e in zip(ends[:-1], ends[1:]):
        if e - s >= words:
            out.append(np.unique(rolled[s : e - words + 1]))
        elif e > s:
            short = np.array([0x5851F42D4C957F2D], U64)
            for k in range(s, e):
                short = mix(short + base[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out


def pack(values: np.ndarray) -> bytes:
    return np.sort(values >> U64(64 - 8 * WIDTH)).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // WIDTH, 8), np.uint8)
    raw[:, :WIDTH] = np.frombuffer(blob, np.uint8).reshape(-1, WIDTH)
    return raw.view(U64).ravel()


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = unpack(a), unpack(b)
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=False))
    return 100 * both >= percent * (len(x) + len(y) - both)


@functools.cache
def least_shared(size: int, percent: int) -> int:
    """The largest count that a binomial of `size` draws at `percent` falls below with probability RISK at most."""
    p, total, count = percent / 100, 0.0, 0
    while (total := total + math.comb(size, count) * p**count * (1 - p) ** (size - count)) <= RISK:
        count += 1
    return count


def needed_values(n: F.Column, size: int, percent: int) -> F.Column:
    """How many sketch values a set of n shares at least with a similar one."""
    exact = F.ceil(n * F.lit(percent) / F.lit(100.0)).cast("int")
    return F.when(n <= math.floor(size * percent / 100), exact).otherwise(F.lit(max(1, least_shared(size, percent))))


def _features(words: int, size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        sets = shingles(batch.column("text"), words)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "print": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "sketch": pa.array([s[:size].view(np.int64) for s in sets], pa.list_(pa.int64())),
            }
        )

    return by_batch(run)


def _sets(words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": batch.column("doc_id"), "set": pa.array([pack(s) for s in shingles(batch.column("text"), words)], pa.binary())})

    return by_batch(run)


def _union_sketch(size: int, percent: int):
    """Keeps pairs whose union sketch leaves the threshold possible: exact where a sketch is the whole set."""
    p, floor = percent / 100, least_shared(size, percent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()):
            a, b = np.array(a, np.int64).view(U64), np.array(b, np.int64).view(U64)
            union = np.unique(np.concatenate([a, b]))[: size if max(len(a), len(b)) >= size else None]
            both = len(np.intersect1d(np.intersect1d(a, b), union))
            keep.append(both >= (floor if len(union) == size else p * len(union)))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return by_batch(run)


def _exact(percent: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar(a.as_py(), b.as_py(), percent) for a, b in zip(batch.column("set_a"), batch.column("set_b"))]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return by_batch(run)


def _exploded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each value of each set."""
    sets = [unpack(s) for s in batch.column("set").to_pylist()]
    size = [len(s) for s in sets]
    spread = lambda c: pa.array(np.repeat(np.asarray(batch.column(c)), size))
    values = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([spread("rep"), spread("component"), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(values)], ["rep", "component", "n", "v"])


def _cell_links(percent: int):
    """The links of one chunk of a group: those that ask against the others, of other components only."""

    def run(table: pa.Table) -> pa.Table:
        asks, reps, comps = (table.column(c).to_numpy() for c in ("asks", "rep", "component"))
        asks = asks.astype(bool)
        sets = [unpack(x.as_py()) for x in table.column("set")]
        right = np.flatnonzero(~asks)
        sizes = np.array([len(sets[k]) for k in right], np.int64)
        values, codes = np.unique(np.concatenate([sets[k] for k in right] or [np.zeros(0, U64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(codes, kind="stable")
        starts, owner = np.searchsorted(codes[order], np.arange(len(values) + 1)), owner[order]
        links = [np.zeros((0, 2), np.int64)]
        for k in np.flatnonzero(asks) if len(right) else ():
            at = np.searchsorted(values, sets[k])
            at = at[values[np.minimum(at, len(values) - 1)] == sets[k]]
            held = starts[at + 1] - starts[at]
            both = np.bincount(owner[np.repeat(starts[at], held) + runs(held)], minlength=len(right))
            hit = right[(100 * both >= percent * (len(sets[k]) + sizes - both)) & (comps[right] != comps[k])]
            links.append(np.stack([np.maximum(reps[hit], reps[k]), np.minimum(reps[hit], reps[k])], axis=1))
        found = np.concatenate(links)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return run


def prefix_links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: the links between members (rep, component, set) of different components that share a value of their full sets' prefixes."""
    values = staged(members.mapInArrow(by_batch(_exploded), "rep long, component long, n int, v long"), "near-values")
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = values.join(counts, "v").groupBy("rep").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
    # values of one set alone come first; only shared ones can meet
    alone = F.col("n") - F.size("shared")
    long = (F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1).cast("int")
    short = (F.col("n") - F.ceil(F.col("n") * F.lit(2 * percent) / F.lit(100 + percent)) + 1).cast("int")
    entries = held.filter(long > alone).select("rep", "component", short.alias("short"), alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), long - alone)).alias("k", "x"))
    entries = staged(entries.select("x.v", "rep", "component", (F.col("alone") + F.col("k") < F.col("short")).alias("first")), "near-prefixes")
    parts = entries.groupBy("v", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = parts.groupBy("v").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("v", "main")
    entries = staged(entries.join(mixed, "v").withColumn("minor", F.col("component") != F.col("main")), "near-mixed")
    lead = entries.groupBy("v").agg(F.min(F.when(F.col("minor"), F.col("rep"))).alias("lead"), F.max("first").alias("any")).filter("any").select("v", "lead")
    found = entries.join(lead, "v").groupBy("main", "lead", "rep").agg(F.first("component").alias("component"), F.first("minor").alias("minor"))
    found = staged(found, "near-groups")
    sizes = found.groupBy("main", "lead").agg(F.count(F.lit(1)).alias("size"), F.count_if("minor").alias("minors"))
    sized = found.join(sizes, ["main", "lead"]).withColumn("across", F.ceil(F.col("minors") / CHUNK).cast("int")).withColumn("down", F.ceil(F.col("size") / CHUNK).cast("int"))
    spot = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    left = sized.filter("minor").select("main", "lead", "rep", "component", F.lit(True).alias("asks"), spot("across").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"))
    right = sized.select("main", "lead", "rep", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), spot("down").alias("j"))
    cells = left.unionByName(right).join(members.select("rep", "set"), "rep")
    return cells.groupBy("main", "lead", "i", "j").applyInArrow(_cell_links(percent), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_exact(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, sketch: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = only(docs, "doc_id", "text")
    features = staged(docs.mapInArrow(_features(words, sketch), "doc_id long, n_shingles long, print binary, sketch array<long>"), "near-features")
    usable = features.filter("n_shingles > 0 and doc_id is not null")
    # 1. classes of equal sets, looked up by salt so that a class with a third of all rows is spread
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts_for(features.count()))).cast("int")
    salted = usable.groupBy("print", salt.alias("salt")).agg(F.min("doc_id").alias("low"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = salted.groupBy("print").agg(F.min("low").alias("rep"), F.collect_list("salt").alias("salts"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    classes = staged(classes, "near-classes")
    reps = classes.select("rep", "n", "sketch")
    # 2. inverted lists of the rarest retained values
    held = reps.select("rep", F.explode("sketch").alias("v"))
    counts = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = held.join(counts, "v").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"), F.sum(F.log("df")).alias("popular")
    )
    size, alone = F.size("sketch"), F.size("sketch") - F.size("shared")
    first = F.greatest(F.lit(0), size - needed_values(F.col("n"), sketch, percent) + 1 - alone)
    lists = staged(ranked.join(reps, "rep").select("rep", "popular", F.explode(F.slice("shared", F.lit(1), first)).alias("x")).select("rep", "popular", "x.v"), "near-lists")
    # 3. members against the two pivots of each list
    best = F.struct("popular", (-F.col("rep")).alias("low"), "rep")
    other = F.struct(F.round("popular", 0).alias("r"), F.xxhash64("rep").alias("h"), "rep")
    pivots = lists.groupBy("v").agg(F.max(best)["rep"].alias("p"), F.max(other)["rep"].alias("q"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pivots = staged(pivots, "near-pivots")
    joined = lists.select("v", "rep").join(pivots, "v").select("rep", F.explode(F.array("p", "q")).alias("pivot")).filter("rep <> pivot")
    pairs = joined.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    likely = staged(both.mapInArrow(_union_sketch(sketch, percent), "a long, b long"), "near-likely")
    listed = lists.join(pivots.filter("size > 2").select("v"), "v")
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(listed.select("rep")).distinct()
    sets = staged(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(words), "rep long, set binary"), "near-sets")
    links = staged(_verified(likely, sets, percent), "near-links")
    found = components(links)
    # 4. lists that the pivots left in several components
    member = listed.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", F.coalesce("component", "rep").alias("component"))
    split = member.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    apart = staged(member.join(split.select("v"), "v", "left_semi").select("rep", "component").distinct(), "near-apart")
    if not apart.isEmpty():
        more = staged(prefix_links(sets.join(apart, "rep"), percent), "near-more")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    # classes and components back to the documents
    named = classes.join(found, classes["rep"] == found["node"], "left").select("print", F.coalesce("component", "rep").alias("component"), F.explode("salts").alias("salt"))
    named = usable.withColumn("salt", salt).select("doc_id", "n_shingles", "print", "salt").join(named, ["print", "salt"])
    alone_rows = features.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = named.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(alone_rows)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all columns; rows that repeat a doc_id stay or go together."""
    name = fresh(docs)
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[name]), "left_semi")
