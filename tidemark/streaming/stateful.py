"""Structured Streaming versions of the stateful operators.

Event time is a timestamp with a watermark; sessions close when the watermark
passes their end, so a stream emits the sessions that are closed. Values that are
held or smoothed per key live in pandas state and survive restarts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import folds


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream with a timestamp."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str) -> DataFrame:
    """keys, start, end, n, confidence of sessions of events at most `gap` apart."""
    grouped = stream.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w"))
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("confidence"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "confidence")


def unclosed(events: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """The events after each key's last closed session, which belong to sessions still open. Sessions close in order, so none lies before."""
    last = closed.groupBy(*keys).agg(F.max("end").alias("__last"))
    return events.join(last, keys, "left").filter(F.col("__last").isNull() | (F.col("ts") >= F.col("__last"))).drop("__last")


def levels(stream: DataFrame, keys: list[str], size: str, hop: str, late: str, value: Column) -> DataFrame:
    """rms and peak of sliding windows."""
    grouped = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", size, hop).alias("w"))
    return grouped.agg(F.sqrt(F.avg(value * value)).alias("rms"), F.max(F.abs(value)).alias("peak")).select(*keys, F.col("w.start").alias("start"), "rms", "peak")


def smoothed(stream: DataFrame, key: str, factor: float) -> DataFrame:
    """key, event_id, smoothed: exponential smoothing of value in the order of time, the state one number per key.

    A missing value repeats the last smoothed one, and is null before the first value.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        out = []
        for x in rows["value"]:
            if not pd.isna(x):
                last = float(x) if last is None else factor * last + (1 - factor) * float(x)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: name[0], "event_id": rows["event_id"], "smoothed": pd.array(out, "Float64")})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, smoothed double", "last double", "append", GroupStateTimeout.NoTimeout)


def held(stream: DataFrame, key: str, every: int) -> DataFrame:
    """key, event_id, held: the value at the latest event looked at, every `every`-th of a key."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        out = []
        for x in rows["value"]:
            if n % every == 0:
                last = float(x)
            n += 1
            out.append(last)
        state.update((n, last))
        yield pd.DataFrame({key: name[0], "event_id": rows["event_id"], "held": out})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, held double", "n long, last double", "append", GroupStateTimeout.NoTimeout)


PENDING = "ts timestamp, frame_idx long, det_idx long, x double, y double, width double, height double"


class _Tracker(StatefulProcessor):
    """Open tracks of a shot and the detections that wait for the watermark; timers take them on in the order of time."""

    def __init__(self, keys: list[str], least: float, missed: int, idle_ms: int):
        self.keys, self.least, self.missed, self.idle = keys, least, missed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "number long, last long")
        self.open = handle.getListState("open", "id long, misses long, x double, y double, width double, height double")
        self.pending = handle.getListState("pending", PENDING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # numbers beside nulls come as floats, which a state of longs doesn't take
        kinds = {"timestamp": lambda v: v.to_pydatetime(), "long": int, "double": float}
        fields = [(n, kinds[k]) for n, k in (f.split() for f in PENDING.split(", "))]
        came = [tuple(None if pd.isna(v) else to(v) for v, (_, to) in zip(r, fields, strict=True)) for df in rows for r in df[[n for n, _ in fields]].itertuples(index=False)]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), came)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, now: int, came: Sequence[tuple] = ()) -> Iterator[pd.DataFrame]:
        waiting = [*(tuple(r) for r in self.pending.get()), *came] if self.pending.exists() else list(came)
        at = lambda r: int(pd.Timestamp(r[0]).timestamp() * 1000)
        ready = sorted((r for r in waiting if at(r) < now), key=lambda r: (r[1], r[2] is None, r[2]))
        rest = [r for r in waiting if at(r) >= now]
        number, last = self.number.get() if self.number.exists() else (0, -1)
        open_ = [(r[0], r[1], tuple(r[2:])) for r in self.open.get()] if self.open.exists() else []
        out = []
        for frame, group in itertools.groupby(ready, key=lambda r: r[1]):
            found = list(group)
            dets = [r for r in found if r[2] is not None]
            boxes = np.array([r[3:] for r in dets], float).reshape(-1, 4)
            open_, got, number = folds.next_frame(open_, boxes, number, self.least, self.missed)
            out += [(*key, frame, r[2], t) for r, t in zip(dets, got, strict=True)]
            last = max(last, at(found[0]))
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(min(map(at, rest)) + 1)
        elif waiting:
            self.pending.clear()
        if not rest and last + self.idle < now:  # nothing for long: the shot is over
            for state in (self.number, self.open, self.pending):
                state.clear()
        else:
            self.number.update((number, last))
            if open_:
                self.open.put([(i, m, *map(float, b)) for i, m, b in open_])
            else:
                self.open.clear()
            if not rest:
                self.handle.registerTimer(last + self.idle + 1)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "frame_idx", "det_idx", "track_id"])


def tracked(stream: DataFrame, keys: list[str], late: str, least: float = 0.3, missed: int = 3, idle: float = 60.0) -> DataFrame:
    """keys, frame_idx, det_idx, track_id of the detections of a stream, as `folds.tracks` numbers them.

    stream: keys of a shot, ts, frame_idx and the boxes, one row with a null det_idx for a
    frame that was looked at in vain. Rows may come in any order within `late`: a frame is
    taken on when the watermark has passed it. A shot's state goes `idle` seconds after its
    last frame. Needs RocksDB as state store (spark.sql.streaming.stateStore.providerClass).
    """
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.split()[0] for f in PENDING.split(", ")]
    rows = stream.select(*keys, *names).withWatermark("ts", late)
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Tracker(keys, least, missed, int(idle * 1000)), f"{kinds}, frame_idx long, det_idx long, track_id long", "Append", "EventTime"
    )


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now, into Parquet, and reads the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
