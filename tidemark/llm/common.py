"""Helpers shared by the corpus operators: shared scratch tables, vectorised tokenising, column hygiene."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Byte tables: lower-case A-Z only; the second also turns every byte that is no ASCII letter, digit or non-ASCII byte into a space.
LOWER_TABLE = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
WORD_TABLE = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).isalpha() else 0x20 for c in LOWER_TABLE
)

U64 = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset on one machine (tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that staged() wrote, once nothing reads it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, name: str = "_id") -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(column) -> F.Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of strings, nulls as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, bytes]:
    """Offsets (n+1) and the UTF-8 bytes of all texts of a batch, one after the other."""
    column = string_array(column)
    if not len(column):
        return np.zeros(1, np.int64), b""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""
    return offsets - offsets[0], raw


def tokens(column: pa.Array | pa.ChunkedArray, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Token offsets per text (n+1), each token's code, and the distinct tokens by code."""
    offsets, raw = text_bytes(column)
    n = len(offsets) - 1
    texts = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.translate(table)))
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
    return ends - ends[0], np.asarray(coded.indices).astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    rows, planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize), np.empty((x.dtype.itemsize, len(x)), np.uint8)
    for k, plane in enumerate(planes):  # much faster than a transposed copy
        plane[:] = rows[:, k]
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(blob, n * width, codec="zstd", asbytes=True) if n else b""
    rows = np.empty((n, width), np.uint8)
    for k, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(width, n)):
        rows[:, k] = plane
    return rows.view(kind).ravel()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker lives on after its task, and an executor has one a core."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def by_batch(run: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function of a function of one batch; at its end what it freed is given back."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := run(batch)) is not None:
                yield out
        give_back()

    return go


def salts_for(rows: int, per_salt: int = 50_000, least: int = 16) -> int:
    """Into how many salts a key is split so that even a key with all rows leaves at most per_salt or so of them together."""
    return max(least, -(-rows // per_salt))
