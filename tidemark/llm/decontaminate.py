"""Benchmark decontamination over a positional inverted index of the corpus.

The index is a table with a row per block of documents: the block's distinct
terms and, for each, the sorted positions at which it stands. Documents are
dealt over blocks, so no term's postings, however common, meet in one task, and
the index is written once to the shared folder and searched as often as needed.

A search takes phrases (windows of test words) in bounded chunks, as arrays. Within
a block each phrase starts from the postings of its rarest term in the corpus, shifts
them by the term's offset and intersects them with the other terms' postings, rarest
first; the phrases of a chunk go together. near() finds phrases whose
terms all stand within some words of the rarest one, in any order.

Defined results: null or empty text has no words and no hits; an item without
words has no windows; items without an id count for hits but are not listed;
repeated documents each get their own row; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, fresh, give_back, only, runs, staged, tokens

INDEX = "block string, doc_ids array<long>, ends array<int>, terms array<string>, starts array<int>, positions array<int>"
FOUND = "block string, slot int, doc_id long, n_words long, begins array<int>, ends array<int>, items array<string>"
NEAR = "doc_id long, item string, position int"
BLOCK_BYTES = 8 << 20  #: text of a block of documents
CHUNK_BYTES = 4 << 20  #: text of test items that one pass over the index carries to the tasks
CANDIDATES = 1 << 19  #: postings of rarest terms that a task intersects at a time
ROW_ITEMS = 1 << 20  #: items found that a task hands on at a time


def _index(batch: pa.RecordBatch) -> pa.RecordBatch:
    ends, codes, terms = tokens(batch.column("text"), WORD_TABLE)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))]).astype(np.int32)
    one = {
        "block": [uuid.uuid4().hex],
        "doc_ids": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id").cast(pa.int64())),
        "ends": pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends.astype(np.int32))),
        "terms": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
        "starts": pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), pa.array(starts)),
        "positions": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.array(order)),
    }
    return pa.RecordBatch.from_pydict(one)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block for each BLOCK_BYTES of text, a longer document alone, so that a task's memory grows with neither batches nor texts of many rows."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))
        s = 0
        while s < batch.num_rows:
            full = int(np.searchsorted(size, BLOCK_BYTES + (size[s - 1] if s else 0), "right"))
            e = max(s + 1, full)
            yield _index(batch.slice(s, e - s))
            s = e


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of docs (doc_id, text), as a written table. Each block is a file, since readers take up all rows of a file at once."""
    return staged(only(docs, "doc_id", "text").mapInArrow(_indexed, INDEX), "positions", maxRecordsPerFile=1)


class Phrases:
    """Distinct windows of a chunk of test items as rows of terms, short ones filled up with -1, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        ends, codes, self.terms = tokens(pa.array([text for _, text in items], pa.string()), WORD_TABLE)
        ids = {i for i, _ in items}
        self.names = [*sorted(ids - {None}), None]  #: the items' ids, None last
        number = {i: k for k, i in enumerate(self.names)}
        n = np.diff(ends)
        many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        item = np.repeat(np.arange(len(n)), many)
        at = (ends[item] + runs(many))[:, None] + np.arange(size)
        every = np.append(codes, -1).astype(np.int32)[np.where(at < ends[item + 1][:, None], at, -1)]
        found, first, window = np.unique(every.view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)
        self.words = every[first]
        owner = np.array([number[i] for i, _ in items], np.int64)[item]
        window, owner = np.divmod(np.unique(window * len(self.names) + owner), len(self.names))
        edges, groups = np.searchsorted(window, np.arange(len(found) + 1)).tolist(), {}
        #: windows with the same items are of one group
        self.group = np.array([groups.setdefault(owner[s:e].tobytes(), len(groups)) for s, e in zip(edges, edges[1:])], np.int64)
        self.owners = [np.frombuffer(g, np.int64) for g in groups]

    def rank(self, counts: np.ndarray) -> None:
        """Orders the offsets of each window's terms by the terms' counts in the corpus."""
        self.order = np.lexsort((self.words, np.append(counts, np.iinfo(np.int64).max)[self.words]), axis=-1).astype(np.int16)

    def ordered(self, window: int) -> list[tuple[int, int]]:
        """(term, offset) pairs of one window, the rarest term first."""
        return [(t, k) for k in self.order[window].tolist() if (t := int(self.words[window, k])) >= 0]


def chunks(benchmark: DataFrame, size: int) -> Iterator[Phrases]:
    """The test items in bounded chunks, so that a large benchmark never reaches a task whole."""
    held, total = [], 0
    for row in only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((row[0], row[1] or ""))
        total += len(held[-1][1])
        if total >= CHUNK_BYTES:
            yield Phrases(held, size)
            held, total = [], 0
    if held:
        yield Phrases(held, size)


class Block:
    """One row of the index, and where the terms of some phrases stand in it."""

    def __init__(self, batch: pa.RecordBatch, row: int, terms: pa.Array):
        part = {c: batch.column(c)[row].values for c in ("doc_ids", "ends", "terms", "starts", "positions")}
        self.block, self.doc_ids = batch.column("block")[row].as_py(), part["doc_ids"].to_pylist()
        self.ends, self.starts, self.positions = (np.asarray(part[c]) for c in ("ends", "starts", "positions"))
        at = pc.index_in(terms, part["terms"]) if len(terms) else pa.array([], pa.int32())
        self.at = np.asarray(pc.fill_null(at, -1))

    def postings(self, term: int) -> np.ndarray:
        at = self.at[term]
        return self.positions[self.starts[at] : self.starts[at + 1]] if at >= 0 else self.positions[:0]

    def slot(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right") - 1

    def standing(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, where they begin and how long they are: postings of each one's rarest term, less its offset, intersected with those of its other terms, within one document.

        Many windows go together: the postings of all terms are one sorted array of (term, position).
        """
        total = int(self.ends[-1])
        local = np.append(self.at, -2).astype(np.int32)[phrases.words]  # -2 where a short window has no word
        live = np.flatnonzero((local != -1).all(axis=1))
        if not len(live) or not total:
            return
        local, order = local[live], phrases.order[live]
        size, rows = (local != -2).sum(axis=1), np.arange(len(live))
        keys = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) * total + self.positions
        rare = local[rows, order[:, 0]]
        many = (self.starts[rare + 1] - self.starts[rare]).astype(np.int64)
        upto, s = np.cumsum(many), 0
        while s < len(live):
            e = max(s + 1, int(np.searchsorted(upto, CANDIDATES + (upto[s - 1] if s else 0), "right")))
            at = np.repeat(rows[s:e], many[s:e])
            begins = self.positions[np.repeat(self.starts[rare[s:e]], many[s:e]) + runs(many[s:e])] - order[at, 0].astype(np.int64)
            keep = (begins >= 0) & (begins + size[at] <= total)
            at, begins = at[keep], begins[keep]
            for k in range(1, order.shape[1]):
                offset = order[at, k]
                term = local[at, offset].astype(np.int64)
                want = term * total + begins + offset
                keep = (term == -2) | (keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want)
                at, begins = at[keep], begins[keep]
            keep = self.slot(begins) == self.slot(begins + size[at] - 1)
            yield live[at[keep]], begins[keep], size[at[keep]]
            s = e

    def near(self, order: list[tuple[int, int]], slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most slop words away in the same document."""
        spots = self.postings(order[0][0])
        low, high = self.ends[self.slot(spots)], self.ends[self.slot(spots) + 1] if len(spots) else spots
        for term in {t for t, _ in order[1:]} - {order[0][0]}:
            held = self.postings(term)
            from_, to = np.maximum(spots - slop, low), np.minimum(spots + slop, high - 1)
            keep = np.searchsorted(held, from_, side="left") < np.searchsorted(held, to, side="right")
            spots, low, high = spots[keep], low[keep], high[keep]
        return spots


def _blocks(phrases: Phrases, run):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from run(Block(batch, row, phrases.terms), phrases)
        give_back()

    return go


def _counts(block: Block, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    there = np.flatnonzero(block.at >= 0)
    n = block.starts[block.at[there] + 1] - block.starts[block.at[there]]
    yield pa.RecordBatch.from_pydict({"term": pa.array(there, pa.int32()), "n": pa.array(n, pa.int64())})


def _hits(block: Block, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    total, n = int(block.ends[-1]), len(block.doc_ids)
    edge, found = np.zeros(total + 1, np.int64), [np.zeros(0, np.int64)]
    for window, begins, size in block.standing(phrases):
        edge += np.bincount(begins, minlength=total + 1) - np.bincount(begins + size, minlength=total + 1)
        found.append(np.unique(block.slot(begins) * len(phrases.owners) + phrases.group[window]))
    hit = np.concatenate([[False], np.cumsum(edge) > 0])  # the word before the first, then all words and one more
    bound = np.zeros(total + 1, bool)
    bound[block.ends] = True
    first = np.flatnonzero(hit[1:] & (~hit[:-1] | bound))
    last = np.flatnonzero(hit[1:-1] & (~hit[2:] | bound[1:])) + 1
    slot = block.slot(first)
    runs_of, start = np.searchsorted(slot, np.arange(n + 1)), block.ends[slot]
    slots, groups = np.divmod(np.unique(np.concatenate(found)), max(1, len(phrases.owners)))
    groups_of, names = np.searchsorted(slots, np.arange(n + 1)), pa.array(phrases.names, pa.string())
    listed = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)

    def rows(s: int, e: int, items: list[np.ndarray]) -> pa.RecordBatch:
        a, b = runs_of[s], runs_of[e]
        spans = [listed(pa.array((x[a:b] - start[a:b]).astype(np.int32)), runs_of[s : e + 1] - a) for x in (first, last)]
        own = listed(names.take(pa.array(np.concatenate([*items, np.zeros(0, np.int64)]))), np.cumsum([0, *map(len, items)]))
        columns = [[block.block] * (e - s), np.arange(s, e, dtype=np.int32), pa.array(block.doc_ids[s:e], pa.int64()), np.diff(block.ends[s : e + 1]).astype(np.int64), *spans, own]
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, (list, np.ndarray)) else x for x in columns], [f.split()[0] for f in FOUND.split(", ")])

    s, items, held = 0, [], 0
    for k in range(n):
        mine = groups[groups_of[k] : groups_of[k + 1]]
        own = np.unique(np.concatenate([phrases.owners[g] for g in mine])) if len(mine) else mine
        items.append(own[own < len(phrases.names) - 1])
        held += len(items[-1])
        if held > ROW_ITEMS:
            yield rows(s, k + 1, items)
            s, items, held = k + 1, [], 0
    if s < n:
        yield rows(s, n, items)


def _ranked(index: DataFrame, benchmark: DataFrame, size: int) -> Iterator[Phrases]:
    for phrases in chunks(benchmark, size):
        seen = index.mapInArrow(_blocks(phrases, _counts), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per test term of the chunk
        counts = np.zeros(len(phrases.terms), np.int64)
        counts[np.asarray(seen.column("term"))] = np.asarray(seen.column("n"))
        phrases.rank(counts)
        yield phrases


def _searched(index: DataFrame, benchmark: DataFrame, size: int, run, schema: str) -> list[DataFrame]:
    """The search for each chunk. Each is written once the next one comes, so neither the driver nor the plan holds more than two chunks."""
    found, last = [], None
    for phrases in _ranked(index, benchmark, size):
        if last is not None:
            found.append(staged(last, "hits"))
        last = index.mapInArrow(_blocks(phrases, run), schema)
    return [*found, index.mapInArrow(_blocks(_nothing(), run), schema) if last is None else last]


def find(index: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row per indexed document: doc_id, n_words, the runs of hit words (begins, ends) and the ids of the items found."""
    every, *others = _searched(index, benchmark, size, _hits, FOUND)
    if not others:
        return every.drop("block", "slot")
    for more in others:
        every = every.unionByName(more.filter("size(begins) > 0"))
    runs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))))
    merged = every.groupBy("block", "slot").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    fold = F.expr(
        """aggregate(runs, cast(array() as array<struct<begins:int,ends:int>>), (a, x) ->
           case when size(a) > 0 and x.begins <= element_at(a, -1).ends
                then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).begins as begins, greatest(element_at(a, -1).ends, x.ends) as ends)))
                else concat(a, array(x)) end)"""
    )
    return merged.withColumn("runs", fold).select("doc_id", "n_words", F.col("runs.begins").alias("begins"), F.col("runs.ends").alias("ends"), "items")


def _nothing() -> Phrases:
    none = Phrases([], 1)
    none.rank(np.zeros(0, np.int64))
    return none


def near(index: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 20) -> DataFrame:
    """doc_id, item, position for each place where all terms of one of the item's windows stand within slop words of its rarest term."""

    def run(block: Block, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        out = set()
        for window in np.flatnonzero((np.append(block.at, 0)[phrases.words] >= 0).all(axis=1)).tolist():
            spots = block.near(phrases.ordered(window), slop)
            for p, s in zip(spots.tolist(), block.slot(spots).tolist()):
                out |= {(block.doc_ids[s], phrases.names[k], p - int(block.ends[s])) for k in phrases.owners[phrases.group[window]].tolist()}
        rows = sorted(out, key=str)
        schema = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("position", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.types[k]) for k in range(3)], schema=schema)

    out, *others = _searched(index, benchmark, size, run, NEAR)
    for more in others:
        out = out.unionByName(more)
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    found = find(build_index(docs), benchmark, size)
    hit = F.expr("aggregate(zip_with(ends, begins, (e, b) -> e - b), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit word, with all columns."""
    name = fresh(docs)
    dirty = contamination(docs, benchmark, size).filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty[name]), "left_anti")


def digest(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
