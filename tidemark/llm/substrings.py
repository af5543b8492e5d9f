"""Removal of long repeated byte strings by ranks of sampled positions and halving of offsets (in place of prefix doubling).

A byte goes if a string of `length` bytes that covers it also starts anywhere
else. Prefix doubling would rank every byte's suffix and sort as many rows as there are
bytes, so only sampled positions that no repeat can miss are ranked: in each window of
`length` bytes the position whose SEED-byte string has the smallest hash is its
anchor, a choice that depends on the window's bytes alone, so equal windows have
anchors at equal places. Successive windows share anchors; a run is all windows
of one anchor, about 85 of them.

1. Spark ranks anchors by their SEED-byte string; anchors with a rank of their
   own are unique, and so are all their windows.
2. The others are reranked by the pair of that rank and the rank of the whole
   run, which lies past the threshold: runs that share a rank are repeated whole.
3. Runs that are alone at that length, but not at the seed, are compared at the
   offsets in between with the runs of the same seed, byte by byte; where a seed
   has more than BIG different runs, ranges of their offsets are ranked by Spark
   and halved until each is settled or alone.

Only positions still tied move on to the next length. Strings are judged on the
input, never across documents.

Defined results: null text counts as empty; texts shorter than `length` lose
nothing; repeated rows repeat each other; a null doc_id gets its row like any
other; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_batch, mix, only, staged, text_bytes

SEED = 32
BIG = 8  #: runs of one seed that are compared with each other in one task
SEGMENT = 2 << 20

_OF_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []

RUNS = "seed long, whole long, id long, print long, span long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, U64(b % 2**64))])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def pack(low, windows, anchor):
    """A run in one number: its first byte, its windows after the first, its anchor after the first byte."""
    return (low << 17) | (windows << 9) | anchor


def unpack(span):
    return span >> 17, (span >> 9) & 255, span & 511


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """document number, seed rank, run rank and span of each run of windows of texts that lie one after the other."""
    n, wide = len(raw), length - SEED + 1
    power, inverse = _powers(n + 1)
    sums = np.concatenate([[U64(0)], np.cumsum(_OF_BYTE[raw] * power[:n])])
    seeds = mix((sums[SEED:] - sums[:-SEED]) * inverse[: n - SEED + 1])
    bits = U64(max(1, n.bit_length()))
    low = ((seeds >> bits) << bits) | np.arange(len(seeds), dtype=U64)
    step = 1
    while 2 * step <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < wide:
        low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :])
    edge = np.zeros(n + 1, np.int32)
    enough = np.diff(offsets) >= length
    edge[offsets[:-1][enough]] += 1
    edge[offsets[1:][enough] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(edge[:-1]))
    a = (low[p] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]) if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    begin, end, anchor = p[at], p[np.concatenate([at[1:], [len(p)]])[: len(at)] - 1], a[at]
    whole = mix((sums[end + length] - sums[begin]) * inverse[begin] + (end - begin).astype(U64))
    doc = np.searchsorted(offsets, begin, side="right") - 1
    return doc, seeds[anchor], whole, pack(begin - offsets[doc], end - begin, anchor - begin)


def _runs(length: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            raw = np.frombuffer(data, np.uint8)
            ids, prints = (np.asarray(batch.column(c)) for c in ("id", "print"))
            s = 0
            while s < len(ids):
                e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + SEGMENT, side="right")) - 1)
                if offsets[e] - offsets[s] >= length:
                    doc, seed, whole, span = runs(raw[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], length)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed.view(np.int64), whole.view(np.int64), ids[s + doc], prints[s + doc], span)], ["seed", "whole", "id", "print", "span"])
                s = e

    return go


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    offsets, data = text_bytes(batch.column("text"))
    packed = [pa.compress(data[s:e], codec="zstd", asbytes=True) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], ["id", "print", "n_bytes", "packed"])


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(z, n, codec="zstd", asbytes=True) if n else b"" for z, n in zip(batch.column("packed").to_pylist(), batch.column("n_bytes").to_pylist())]


def _contents(length: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {c: [] for c in ("seed", "alone", "id", "print", "span", "big", "bytes")}
        for i, p, raw, held in zip(batch.column("id").to_pylist(), batch.column("print").to_pylist(), _unpacked(batch), batch.column("held").to_pylist()):
            for x in held:
                begin, windows, _ = unpack(x["span"])
                for c, v in (("seed", x["seed"]), ("alone", x["alone"]), ("id", i), ("print", p), ("span", x["span"]), ("big", x["big"]), ("bytes", raw[begin : begin + windows + length])):
                    rows[c].append(v)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))

    return by_batch(run)


def same(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


SPANS = "id long, print long, low long, high long"


def _compared(length: int):
    """What runs that stand alone share with the other runs of their seed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = set()
        for members in batch.column("members").to_pylist():
            parts = []
            for m in members:
                begin, windows, anchor = unpack(m["span"])
                parts.append((m, begin + anchor, anchor, anchor - windows, m["bytes"][:anchor][::-1], m["bytes"][anchor:]))
            for k, (m, at, most, least, before, after) in enumerate(parts):
                if m["alone"]:
                    for j, other in enumerate(parts):
                        if j != k:
                            o_low, o_high = max(length - same(after, other[5]), least), min(same(before, other[4]), most)
                            if o_low <= o_high:
                                found.add((m["id"], m["print"], at - o_high, at - o_low + length))
        rows = list(found)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["id", "print", "low", "high"])

    return by_batch(run)


def _halves(length: int, size: int):
    """For the active ranges of `size` window offsets of each run: the digest of the bytes that all its windows share, and of those that any covers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {c: [] for c in ("id", "print", "span", "part", "shared", "whole")}
        for i, p, span, raw, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "print", "span", "bytes", "parts"))):
            _, windows, anchor = unpack(span)
            least = anchor - windows
            for k in range(least // size, anchor // size + 1) if parts is None else (c for q in parts for c in (2 * q, 2 * q + 1)):
                low, high = k * size, min(k * size + size - 1, length - SEED)
                if low > anchor or high < least or low > high:
                    continue
                mark = f"{size}:{k}:".encode()
                inside = least <= low and high <= anchor
                for c, v in (
                    ("id", i), ("print", p), ("span", span), ("part", k), ("shared", hashlib.blake2b(mark + raw[anchor - low : anchor + length - high], digest_size=16).digest()),
                    ("whole", hashlib.blake2b(mark + raw[anchor - high : anchor + length - low], digest_size=16).digest() if inside else None),
                ):
                    rows[c].append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))

    return by_batch(run)


def _halved(big: DataFrame, length: int) -> DataFrame:
    """What the runs of crowded seeds share. big: id, print, span, bytes.

    A range of window offsets is settled where the bytes that its windows cover stand twice, and given up where
    the bytes that they all share stand once; else it is halved, together with the ranges that it shares bytes with.
    """
    key, size = ["id", "print", "span"], 64
    active = big.withColumn("parts", F.lit(None).cast("array<int>"))
    out = None
    while size:
        asked = staged(active.mapInArrow(_halves(length, size), "id long, print long, span long, part int, shared binary, whole binary"), "halves")
        twice = asked.filter("whole is not null").groupBy("whole").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("whole", F.lit(True).alias("settled"))
        told = asked.join(twice, "whole", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
        met = told.groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.min("settled").alias("over")).filter("n > 1")
        told = staged(told.join(met, "shared").select(*key, "part", "settled", "over"), "halves-told")
        at = F.expr("(span >> 17) + (span & 511)")
        high = F.least(F.col("part") * size + size - 1, F.lit(length - SEED))
        spans = told.filter("settled").select("id", "print", (at - high).alias("low"), (at - F.col("part") * size + length).alias("high"))
        out = spans if out is None else out.unionByName(spans)
        left = told.filter("not over").groupBy(*key).agg(F.collect_list("part").alias("parts"))
        size //= 2
        if not size or left.isEmpty():
            return out
        active = big.join(left, key)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _cut(texts: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "kept")}
        for raw, spans in zip(_unpacked(batch), batch.column("spans").to_pylist()):
            gone = merged([(x["low"], x["high"]) for x in spans or []])
            edges = [0, *[v for s in gone for v in s], len(raw)]
            kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))
            for c, v in (("n_removed", len(raw) - len(kept)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if texts else None)):
                out[c].append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, t) for v, t in zip(out.values(), types)]], ["doc_id", "n_bytes", *out])

    return by_batch(run)


def repeated_spans(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """The documents (id, print, n_bytes, packed) and the spans (id, print, low, high) of bytes that repeats cover."""
    rows = only(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64("text").alias("print"), "text")
    every = staged(rows.mapInArrow(_runs(length), RUNS), "runs")
    ties = every.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    tied = staged(every.join(ties, "seed", "left_semi"), "runs-tied")
    ranks = staged(tied.groupBy("seed", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "print", "span")).alias("x")), "runs-ranked")
    twice = tied.join(ranks.filter("n > 1").select("seed", "whole"), ["seed", "whole"], "left_semi")
    low, high = F.expr("span >> 17"), F.expr("(span >> 17) + ((span >> 9) & 255)") + length
    spans = twice.select("id", "print", low.alias("low"), high.alias("high"))
    kinds = ranks.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    undecided = ranks.join(kinds, "seed").select("x.id", "x.print", F.struct("seed", (F.col("n") == 1).alias("alone"), "x.span", (F.col("kinds") > BIG).alias("big")).alias("run"))
    packed = rows.mapInArrow(by_batch(_packed), "id long, print long, n_bytes long, packed binary")
    held = undecided.groupBy("id", "print").agg(F.collect_list("run").alias("held"))
    contents = packed.dropDuplicates(["id", "print"]).join(held, ["id", "print"]).mapInArrow(_contents(length), "seed long, alone boolean, id long, print long, span long, big boolean, bytes binary")
    contents = staged(contents, "runs-bytes")
    members = contents.filter("not big").groupBy("seed").agg(F.collect_list(F.struct("alone", "id", "print", "span", "bytes")).alias("members"))
    spans = spans.unionByName(members.mapInArrow(_compared(length), SPANS))
    big = contents.filter("big").select("id", "print", "span", "bytes")
    if not big.isEmpty():
        spans = spans.unionByName(_halved(big, length))
    return packed, spans


def remove_repeats(docs: DataFrame, length: int = 200, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) for each row of docs (doc_id, text)."""
    packed, spans = repeated_spans(docs, length)
    by_doc = spans.groupBy("id", "print").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    joined = packed.join(by_doc, ["id", "print"], "left").withColumn("doc_id", F.when(F.col("id") != -(1 << 63), F.col("id")))
    out = joined.select("doc_id", "n_bytes", "packed", "spans").mapInArrow(_cut(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")
