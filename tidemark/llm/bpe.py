"""Byte-level BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last 16 bytes cuts texts into chunks where its low bits
are zero, so equal passages of different documents give equal chunks. Within a
task each distinct chunk is encoded once and kept in a bounded cache. A chunk's
tokens may be wrong near its ends, since a cut can fall within a word. So each
join is repaired: the stretch between the nearest safe points on either side is
encoded again, and moves on to the next safe points until both chunks have token
ends there. A safe point is a space between two printable ASCII characters; the
tokenizer always begins a new word there, so tokens on either side don't depend
on each other and the spliced ids are those of the whole text.

Defined results: null counts as empty and has no ids; a text without safe points
is encoded whole; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import U64, only, text_bytes

ROWS = 512  #: documents encoded at a time
AVERAGE = 1024  #: bytes between two cuts, on average
CACHE_BYTES = 8 << 20  #: text of the chunks whose ids a task keeps

_GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def load(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a byte-level tokenizer file, and the bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    names = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
    encoder = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return encoder, [names.get(i, b"") for i in range(max(names) + 1)]


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions of a batch's bytes where a chunk begins: zero low bits in the hash of the 16 bytes before, at a character's start."""
    if len(raw) < 17:
        return np.zeros(0, np.int64)
    h, step = _GEAR[raw], 1
    while step < 16:
        h = h[step:] + h[:-step] * U64(pow(0x9E3779B97F4A7C15, step, 1 << 64) | 1)
        step *= 2
    at = np.flatnonzero((h >> U64(40)) % U64(AVERAGE) == 0) + 16
    at = at[at < len(raw)]
    return at[(raw[at] & 0xC0) != 0x80]


def safe_points(raw: np.ndarray) -> np.ndarray:
    shown = (raw > 0x20) & (raw < 0x7F)
    return np.flatnonzero((raw[1:-1] == 0x20) & shown[:-2] & shown[2:]) + 1 if len(raw) > 2 else np.zeros(0, np.int64)


class ChunkEncoder:
    """Encodes texts of one task, sharing the ids of equal chunks."""

    def __init__(self, path: str):
        self.encoder, self.names = load(path)
        self.lengths = np.array([len(b) for b in self.names], np.int32)
        self.cache: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def ids(self, piece: bytes) -> np.ndarray:
        return np.asarray(self.encoder.encode_to_numpy(piece.decode("utf-8"), allowed_special="all"), np.uint32)

    def chunk(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's ids and the offsets of their ends."""
        if (found := self.cache.get(piece)) is None:
            if self.held > CACHE_BYTES:
                self.cache, self.held = {}, 0
            ids = self.ids(piece)
            found = self.cache[piece] = ids, np.concatenate([np.zeros(1, np.int32), np.cumsum(self.lengths[ids], dtype=np.int32)])
            self.held += len(piece)
        return found

    def text(self, raw: bytes, at: list[int], safe: list[int]) -> np.ndarray:
        """The ids of one text. at: where chunks begin, but for the first; safe: its safe points."""
        edges = [0, *at, len(raw)]
        parts = [self.chunk(raw[s:e]) for s, e in zip(edges[:-1], edges[1:])]
        if not at:
            return parts[0][0]

        def agrees(p: int) -> bool:
            k = bisect_right(edges, p, hi=len(parts)) - 1
            ends = parts[k][1]
            j = np.searchsorted(ends, p - edges[k])
            return j < len(ends) and ends[j] == p - edges[k]

        stretches: list[list[int]] = []
        for join in at:
            i = bisect_left(safe, join) - 1
            while i >= 0 and not agrees(safe[i]):
                i -= 1
            j = bisect_left(safe, join)
            while j < len(safe) and not agrees(safe[j]):
                j += 1
            left, right = safe[i] if i >= 0 else 0, safe[j] if j < len(safe) else len(raw)
            if stretches and left <= stretches[-1][1]:
                stretches[-1][1] = max(right, stretches[-1][1])
            else:
                stretches.append([left, right])
        out, done = [], 0
        for left, right in [*stretches, [len(raw), len(raw)]]:
            if done < left:  # lies within one chunk
                k = bisect_right(edges, done, hi=len(parts)) - 1
                ids, ends = parts[k]
                a, b = np.searchsorted(ends, [done - edges[k], left - edges[k]])
                out.append(ids[a:b])
            if left < right:
                out.append(self.ids(raw[left:right]))
            done = right
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        offsets, data = text_bytes(column)
        raw = np.frombuffer(data, np.uint8)
        at, safe = cuts(raw), safe_points(raw)
        out = []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            # the hash looks back 16 bytes, which must be the text's own
            own = at[np.searchsorted(at, s + 16) : np.searchsorted(at, e)] - s
            near = safe[np.searchsorted(safe, s + 1) : np.searchsorted(safe, e - 1)] - s
            out.append(self.text(data[s:e], own.tolist(), near.tolist()) if s < e else np.zeros(0, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.names.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            yield batch.slice(s, ROWS)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids for each row of docs (doc_id, text)."""
    path = tokenizer or default_tokenizer()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array([x.astype(np.int32) for x in encoder.batch(batch.column("text"))], pa.list_(pa.int32()))})

    return only(docs, "doc_id", "text").mapInArrow(go, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids); null ids decode to empty text."""
    path = tokenizer or default_tokenizer()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            texts = [encoder.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return only(encoded, "doc_id", "ids").mapInArrow(go, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes its ids, without moving the ids out of the task."""
    path = tokenizer or default_tokenizer()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in _slices(batches):
            found = encoder.batch(batch.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode("utf-8")).hexdigest() for x in found],
                }
            )

    return only(docs, "doc_id", "text").mapInArrow(go, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
