"""WAV files as rows of samples: a binary-file scan, decoded in Arrow batches; and back.

Other codecs and video need an external tool; a decoder for them is a function of
bytes that is passed to read_audio.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

AUDIO = "path string, sample_rate int, channels int, sample_width int, frame_count long, seconds double, samples array<float>"


def decode_wav(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """Rate, channels, bytes per sample and the samples in [-1, 1], channels interleaved."""
    with wave.open(io.BytesIO(raw)) as f:
        rate, channels, width, data = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 127
    elif width == 3:
        low = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((low[:, 0] << 8 | low[:, 1] << 16 | low[:, 2] << 24) >> 8).astype(np.float32) / (2**23 - 1)
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (2 ** (8 * width - 1) - 1)
    return rate, channels, width, np.clip(x, -1, 1)


def encode_wav(samples: np.ndarray, rate: int, channels: int) -> bytes:
    """16-bit WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[int, int, int, np.ndarray]] = decode_wav, pattern: str = "*.wav") -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rate, channels, width, x = decode(raw)
                n = len(x) // channels
                yield pa.RecordBatch.from_pylist(
                    [{"path": name, "sample_rate": rate, "channels": channels, "sample_width": width, "frame_count": n, "seconds": round(n / rate, 4), "samples": x}],
                    pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("sample_width", pa.int32()), ("frame_count", pa.int64()), ("seconds", pa.float64()), ("samples", pa.list_(pa.float32()))]),
                )

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(go, AUDIO)


def wav_bytes(rows: DataFrame, key: str, samples: str, rate: int, channels: int = 1) -> DataFrame:
    """key, content: each row's samples as a WAV file."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_wav(np.asarray(x or [], np.float64), rate, channels) for x in batch.column(1).to_pylist()], pa.binary())], [key, "content"])

    return rows.select(key, samples).mapInArrow(go, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")
