"""Document fingerprints by one-permutation MinHash.

Each shingle (five words) is hashed once; the high bits of the hash choose one of
BINS bins and a bin keeps the least hash that falls into it. An empty bin takes the
value of a full one found by a hash of (bin, attempt), the same for every document:
optimal densification, by which two documents fill the bin alike as often as their
sets agree. A bin's value is then mixed with the bin's number, so that bins filled
from one donor give independent bits, and its low BITS bits are stored, packed.

Unequal values share their low bits by chance in one of 2**BITS bins, so the share P
of equal codes is corrected to (P - C) / (1 - C) with C = 2**-BITS, cut at 0. With
512 bins of 4 bits a fingerprint is 256 bytes and the error of a likeness at most
0.024 (one standard deviation).

Words: A-Z lower-cased, separated by ASCII white space. Defined results: a text of
one to four words has one shingle, the whole sequence; null, empty and blank texts
have none, their fingerprint is all zeros, their likeness to each other 1 and to any
other text 0. Equal texts have equal fingerprints; repeated rows each get a row; an
empty table gives none; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, U64, fresh, mix, only, staged, tokens, word_hashes

WORDS = 5
BINS = 512
BITS = 4
BLOCK_BYTES = 2 << 20  #: text that is hashed at a time, or one longer text
BLOCK_ROWS = 512  #: texts that are hashed at a time
LOOKUPS = 1 << 20  #: donors of empty bins that are looked up at a time

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_STEP = U64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The text's index and the 64-bit hash of every shingle of every text."""
    ends, codes, known = tokens(texts, LOWER_TABLE)
    hashes, lengths = word_hashes(known)[codes], np.diff(ends)
    count = np.where(lengths > 0, np.maximum(lengths - words + 1, 1), 0)
    of = np.repeat(np.arange(len(lengths)), count)
    first = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + ends[:-1][of]
    width = np.minimum(lengths, words)[of]
    out = np.zeros(len(of), U64)
    for k in range(words):
        in_it = k < width
        out[in_it] = mix(out[in_it] * _STEP + hashes[first[in_it] + k] + U64(k + 1))
    return of, out


def minima(texts: pa.Array, words: int = WORDS, bins: int = BINS) -> np.ndarray:
    """The least hash of each bin (texts x bins), empty bins as all ones."""
    of, hashes = shingle_hashes(texts, words)
    out = np.full(len(texts) * bins, _EMPTY)
    shift = U64(64 - int(bins).bit_length() + 1)
    np.minimum.at(out, of * bins + (hashes >> shift).astype(np.int64), hashes)
    return out.reshape(len(texts), bins)


def densified(values: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first full bin in the order that the hash of (bin, attempt) gives."""
    values, bins = values.copy(), values.shape[1]
    full = values != _EMPTY
    doc, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(doc):
        tries = np.arange(attempt, attempt + max(1, min(256, LOOKUPS // len(doc))), dtype=np.int64).astype(U64)
        donors = (mix(bin_.astype(U64)[:, None] * _STEP + mix(tries + U64(1))[None, :]) % U64(bins)).astype(np.int64)
        good = full[doc[:, None], donors]
        found = good.any(axis=1)
        pick = donors[np.arange(len(doc)), good.argmax(axis=1)]
        values[doc[found], bin_[found]] = values[doc[found], pick[found]]
        doc, bin_, attempt = doc[~found], bin_[~found], attempt + len(tries)
    return values


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of each densified value, mixed with the number of its bin; bytes of a row (8 // bits codes a byte)."""
    codes = mix(values ^ (np.arange(values.shape[1], dtype=np.int64).astype(U64) * _STEP)[None, :]) & U64(2**bits - 1)
    parts = codes.astype(np.uint8).reshape(len(values), -1, 8 // bits)
    out = np.zeros(parts.shape[:2], np.uint8)
    for k in range(8 // bits):
        out |= parts[:, :, k] << np.uint8(k * bits)
    out[(values == _EMPTY).all(axis=1)] = 0
    return out


def fingerprint(texts: list[str], words: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints (a row a text), and whether the text has any word."""
    rows, has, start, size = [], [], 0, 0
    if not texts:
        return np.zeros((0, bins * bits // 8), np.uint8), np.zeros(0, bool)
    for k, text in enumerate([*texts, ""]):
        if k == len(texts) or k > start and (size + len(text) > BLOCK_BYTES or k - start >= BLOCK_ROWS):
            values = minima(pa.array(texts[start:k], pa.string()), words, bins)
            has.append((values != _EMPTY).any(axis=1))
            rows.append(packed(densified(values), bits))
            start, size = k, 0
        size += len(text)
    return np.concatenate(rows), np.concatenate(has)


def likeness(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets behind rows a and b: share of equal codes, corrected for chance."""
    differ, unequal = a ^ b, np.zeros(len(a), np.int64)
    for k in range(8 // bits):
        unequal += ((differ >> np.uint8(k * bits)) & np.uint8(2**bits - 1) != 0).sum(axis=1)
    chance = 2.0**-bits
    same = 1 - unequal / (a.shape[1] * (8 // bits))
    return np.where(a_has & b_has, np.maximum(0, (same - chance) / (1 - chance)), (a_has == b_has).astype(float))


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (binary) of each row of docs (doc_id, text). No shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, _ = fingerprint([t or "" for t in batch.column(1).to_pylist()], words, bins, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(go, f"doc_id {kind}, fingerprint binary")


# --- documents beside their successors


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(texts: list[str], after: list[str], known=None) -> tuple[dict[str, pa.Array], tuple]:
    """The columns of rows whose successors are given, and the fingerprints of `after`."""
    edited = [_edited(a, b) for a, b in zip(texts, after, strict=True)]
    # each text is the successor of the one before it, so only the first needs a fingerprint of its own
    own, own_has = known or fingerprint(texts[:1])
    nxt, nxt_has = fingerprint(after)
    own, own_has = np.concatenate([own, nxt[:-1]]), np.concatenate([own_has, nxt_has[:-1]])
    changed, changed_has = fingerprint(edited)
    columns = {
        "n_chars": pa.array(list(map(len, texts)), pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        "fingerprint": pa.array([x.tobytes() for x in own], pa.binary()),
        "edited_fingerprint": pa.array([x.tobytes() for x in changed], pa.binary()),
        "near_edited": pa.array(likeness(own, own_has, changed, changed_has)),
        "near_next": pa.array(likeness(own, own_has, nxt, nxt_has)),
    }
    return columns, (nxt[-1:], nxt_has[-1:])


_COLUMNS = (
    "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of rows in order, a bounded amount of text at a time."""
    for batch in batches:
        texts, start, size = [t or "" for t in batch.column("text").to_pylist()], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= BLOCK_BYTES or k + 1 == len(texts):
                yield batch.column("doc_id").slice(start, k + 1 - start), texts[start : k + 1]
                start, size = k + 1, 0


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The successor of a row is the next one by (doc_id, text), nulls first; of the last
    one, the first. In the edited text the last half of the characters is replaced by as
    many of the successor's first ones. Texts move once, into ranges of doc_id; a range
    compares its rows in passing and hands on its first and its last row, and the last row
    of each range then meets the first one of the next range that has any.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = fresh(docs, "_order")
    rows = only(docs, "doc_id", "text").withColumn(order, F.xxhash64(F.coalesce("text", F.lit(""))))
    ranged = rows.repartitionByRange("doc_id", order).sortWithinPartitions("doc_id", order, "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema, last = TaskContext.get().partitionId(), None, None

        def edge(kind: str, ids: pa.Array, text: str) -> pa.RecordBatch:
            row = {"kind": pa.array([kind]), "part": pa.array([part], pa.int32()), "text": pa.array([text]), "doc_id": ids}
            return pa.RecordBatch.from_arrays([row.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

        for ids, texts in _pieces(batches):
            if last is None:
                schema = pa.schema([
                    ("kind", pa.string()), ("part", pa.int32()), ("text", pa.string()), ("doc_id", ids.type), ("n_chars", pa.int64()),
                    ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64()),
                ])
                yield edge("head", ids.slice(0, 1), texts[0])
                held, known = ids.slice(0, 0), None
            else:
                held, texts, known = last[0], [last[1], *texts], last[2]
            ids = pa.concat_arrays([held, ids])
            if len(texts) > 1:
                found, known = _compared(texts[:-1], texts[1:], known)
                n = len(texts) - 1
                found |= {"kind": pa.array(["row"] * n), "part": pa.array([part] * n, pa.int32()), "text": pa.nulls(n, pa.string()), "doc_id": ids.slice(0, n)}
                yield pa.RecordBatch.from_arrays([found[f.name] for f in schema], schema=schema)
            last = ids.slice(len(ids) - 1), texts[-1], known
        if last is not None:
            yield edge("tail", last[0], last[1])

    found = staged(ranged.mapInArrow(go, f"kind string, part int, text string, doc_id {kind}, {_COLUMNS}"), "fingerprints")
    heads, tails = (found.filter(F.col("kind") == k).select("part", "doc_id", "text") for k in ("head", "tail"))
    # one row a range, so no more rows than the shuffle has partitions
    around = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(around), F.first("part").over(around.rowsBetween(Window.unboundedPreceding, 0)))
    follow = heads.select("part").withColumn("after", after)
    met = tails.join(follow, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("next_text")), "after")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                columns, _ = _compared(row.column("text").to_pylist(), row.column("next_text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": row.column("doc_id"), **columns})

    ends = met.select("doc_id", "text", "next_text").mapInArrow(meet, f"doc_id {kind}, {_COLUMNS}")
    return found.filter("kind = 'row'").select(*ends.columns).unionByName(ends)
