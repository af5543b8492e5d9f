"""Greedy, order-dependent operators: each key (one recording, shot or batch) is a fold over its rows in order.

A fold's rows are sorted by key and order, outside memory where they are many, and
pass through the task once; only the fold's state is held. budget_groups, whose
keys may hold any share of the rows, deals them by ranges of their order instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import kept


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names))


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], step: Callable, name: str, kind: str) -> DataFrame:
    """Adds `name`, the value of `step(state, *inputs) -> (state, value)` for each row in its key's order; each key starts with the state None."""
    keys, n = list(keys), len(keys)
    asked = rows.select(*dict.fromkeys([*keys, *order, *inputs]))
    schema = StructType([*asked.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        key, state, arrow = None, None, to_arrow_type(schema[name].dataType)
        for batch in batches:
            out = []
            for row in _columns(batch, [*keys, *inputs]):
                if row[:n] != key:
                    key, state = row[:n], None
                state, value = step(state, *row[n:])
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, name])

    return asked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)


def _range_ends(keys: Sequence[str], weight: str, budget: float):
    """For each key of each range: the weights that may still join the group that comes in, with the sum and the further groups at the range's end if a new group starts there."""

    def ended(key: tuple, part: int, head: list[float], runs: dict[int, list]) -> dict:
        ends = {c: (t, k) for t, members in runs.values() for c, k in members.items()}
        return {**dict(zip(keys, key)), "__range": part, "__head": [{"w": w, "t": ends[c][0], "k": ends[c][1]} for c, w in enumerate(head)]}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, schema = None, 0, None
        for batch in batches:
            out = []
            for row in _columns(batch, [*keys, "__range", weight]):
                *k, number, w = row
                if tuple(k) != key:
                    if key is not None:
                        out.append(ended(key, part, head, runs))
                    # runs: from the start of a group, its sum so far and the candidates whose groups fall together there
                    key, part, head, total, runs, at = tuple(k), number, [], 0.0, {}, 0
                fresh: dict[int, int] = {}
                for start, run in list(runs.items()):
                    if run[0] + w <= budget:
                        run[0] += w
                    else:
                        fresh.update({c: k_ + 1 for c, k_ in runs.pop(start)[1].items()})
                if total <= budget and (w > 0 or not head):
                    fresh[len(head)] = 0
                    head.append(w)
                    total += w
                if fresh:
                    runs[at] = [w, fresh]
                at += 1
            schema = pa.schema([*[batch.schema.field(k) for k in keys], ("__range", pa.int32()), ("__head", pa.list_(pa.struct([("w", pa.float64()), ("t", pa.float64()), ("k", pa.int64())])))])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([ended(key, part, head, runs)], schema)

    return go


def _came(budget: float):
    def step(state: tuple | None, head: list[dict]) -> tuple[tuple, dict]:
        t, k = came = state or (float("inf"), -1)
        for x in head:
            if t + x["w"] > budget:
                return (x["t"], k + 1 + x["k"]), {"t": came[0], "k": came[1]}
            t += x["w"]
        return (t, k), {"t": came[0], "k": came[1]}

    return step


def budget_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, budget: float, name: str = "group") -> DataFrame:
    """Adds the number of a greedy group: a new one where the sum would pass the budget, so that an item over the budget stands alone.

    Rows are dealt by ranges of their order, so a key may span any number of tasks. A
    range tells, for each place at which the group that comes in may end, how it
    would end itself; a pass over these tells each range what comes in, and the ranges
    number their rows. Weights are not negative; null counts as 0.
    """
    keys, order = list(keys), list(order)
    items = rows.select(*keys, *order, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias(weight))
    dealt = kept(items.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__range", F.spark_partition_id()))
    ends_schema = StructType([*[dealt.schema[k] for k in keys], *StructType.fromDDL("__range int, __head array<struct<w:double,t:double,k:bigint>>").fields])
    ends = kept(dealt.mapInArrow(_range_ends(keys, weight, float(budget)), ends_schema))
    came = fold(ends, keys, ["__range"], ["__head"], _came(float(budget)), "__came", "struct<t:double,k:bigint>").drop("__head")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__range"]]
    told = dealt.alias("a").join(came.alias("b"), same).select("a.*", "b.__came")

    def step(state: tuple | None, w: float, first: dict) -> tuple[tuple, int]:
        t, k = state or (first["t"], first["k"])
        t, k = (t + w, k) if t + w <= budget else (w, k + 1)
        return (t, k), k

    return fold(told, [*keys, "__range"], order, [weight, "__came"], step, name, "int").drop("__range", "__came")


def merge_short(scenes: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Scenes in order, the last one extended while it is shorter than `least`; a short tail joins the one before."""
    keys, n = list(keys), len(keys)
    rows = scenes.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    schema = StructType([*[rows.schema[k] for k in keys], StructField("scene", LongType()), rows.schema["start"], rows.schema["end"]])

    def closed(key: tuple, scene: int, held: list[list[float]]) -> list[tuple]:
        if len(held) > 1 and held[-1][1] - held[-1][0] < least:
            held = [[held[0][0], held[1][1]]]
        return [(*key, scene + i, *x) for i, x in enumerate(held)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scene, held, names = None, 0, [], None
        for batch in batches:
            out, names = [], pa.schema([*[batch.schema.field(k) for k in keys], ("scene", pa.int64()), ("start", pa.float64()), ("end", pa.float64())])
            for *k, start, end in _columns(batch, [*keys, "start", "end"]):
                if tuple(k) != key:
                    if key is not None:
                        out += closed(key, scene, held)
                    key, scene, held = tuple(k), 0, []
                if held and held[-1][1] - held[-1][0] < least:
                    held[-1][1] = end
                else:
                    if len(held) > 1:  # only the last two may still change
                        out.append((*key, scene, *held.pop(0)))
                        scene += 1
                    held.append([start, end])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), names)], schema=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*closed(key, scene, held)), names)], schema=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "start", "end").mapInArrow(go, schema)


def smoothed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, factor: float, name: str = "smoothed") -> DataFrame:
    """Exponential smoothing: factor * last + (1 - factor) * value, the first value as it is; a missing value repeats the last.

    Rows are dealt by ranges of their order, so a key may span any number of tasks: what a
    range does to the value that comes in is factor ** n times it plus a constant, and a
    pass over these, one row a range and key, tells each range what comes in.
    """
    keys, order = list(keys), list(order)
    items = rows.select(*dict.fromkeys([*keys, *order]), F.col(value).cast("double").alias("__v"))
    dealt = kept(items.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__range", F.spark_partition_id()))

    def along(last: float | None, v: float | None) -> float | None:
        return v if last is None else last if v is None else factor * last + (1 - factor) * v

    def effect(state: tuple | None, v: float | None) -> tuple:
        # the result if nothing comes in, and the factor and constant if something does
        alone, times, plus = state or (None, 1.0, 0.0)
        alone = along(alone, v)
        if v is not None:
            times, plus = times * factor, plus * factor + (1 - factor) * v
        return (alone, times, plus), {"alone": alone, "times": times, "plus": plus}

    ends_schema = StructType([*[dealt.schema[k] for k in keys], *StructType.fromDDL("__range int, __effect struct<alone:double,times:double,plus:double>").fields])
    ends = kept(dealt.mapInArrow(_last_of_range(keys, "__v", effect), ends_schema))

    def came(last: float | None, x: dict) -> tuple:
        return x["alone"] if last is None else x["times"] * last + x["plus"], last

    told = fold(ends, keys, ["__range"], ["__effect"], came, "__came", "double").drop("__effect")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__range"]]
    begun = dealt.alias("a").join(told.alias("b"), same).select("a.*", "b.__came")

    def step(state: tuple | None, v: float | None, first: float | None) -> tuple:
        now = along(first if state is None else state[0], v)
        return (now,), now

    found = fold(begun, [*keys, "__range"], order, ["__v", "__came"], step, name, "double")
    return found.withColumnRenamed("__v", value).drop("__range", "__came")


def _last_of_range(keys: Sequence[str], value: str, effect: Callable):
    """The effect of all rows of each key of a range."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, state, last, schema = None, 0, None, None, None

        def row() -> pa.RecordBatch:
            one = pa.array([last], pa.struct([(c, pa.float64()) for c in ("alone", "times", "plus")]))
            return pa.RecordBatch.from_arrays([*[pa.array([v], schema.field(k).type) for k, v in zip(keys, key, strict=True)], pa.array([part], pa.int32()), one], [*keys, "__range", "__effect"])

        for batch in batches:
            schema = batch.schema
            for *k, number, v in _columns(batch, [*keys, "__range", value]):
                if tuple(k) != key:
                    if key is not None:
                        yield row()
                    key, part, state = tuple(k), number, None
                state, last = effect(state, v)
        if key is not None:
            yield row()

    return go


def followed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], target: str, most: float, name: str = "position") -> DataFrame:
    """A follower of `target` that moves at most `most` per row; it stays where a target is missing."""

    def step(last: float | None, v: float | None) -> tuple:
        now = v if last is None else last if v is None else last + max(-most, min(most, v - last))
        return now, now

    return fold(rows.withColumn(target, F.col(target).cast("double")), keys, order, [target], step, name, "double").drop(target)


#: What is taken off the vertical centre of a face by each rule of framing, from the rule's own argument.
FRAMINGS = {"offset": lambda x: x, "center": lambda x: 0.0, "headroom": lambda x: -x, "thirds": lambda x: 0.5 - 1 / 3, "dynamic": lambda x: -x}


def crop_track(
    frames: DataFrame, keys: Sequence[str], order: str, ratio: tuple[int, int] = (9, 16), smoothing: float = 0.8, every: int = 3, most: float | None = None,
    framing: str = "headroom", shift: float = 0.15, fallback: str = "last_position",
) -> DataFrame:
    """Adds crop_x, crop_y, crop_width, crop_height: a window of fixed size that follows the face of each frame.

    frames: keys, order (frames counted from 0), frame_w, frame_h and the chosen face's
    centre and size, cx, cy, fw, fh (shares of the frame, null without a face). Only every
    `every`-th frame is looked at; between, the last smoothed place holds. The place moves
    by the framing, at most `most` a frame along the straight line to its target, and the
    window stays inside the frame. A frame without a face seen so far shows the centre;
    one looked at in vain the last window (last_position) or the centre.
    """
    if framing not in FRAMINGS:
        raise ValueError(f"unknown framing {framing!r}")
    aspect, dy = ratio[0] / ratio[1], FRAMINGS[framing](shift)

    def even(v: float) -> int:
        return max(2, int(v) - int(v) % 2)

    def step(state: tuple | None, n: int, w: int, h: int, cx: float | None, cy: float | None) -> tuple:
        wide = aspect < w / h
        out_h = even(h) if wide else even(int(even(w) / aspect))
        out_w = even(int(even(h) * aspect)) if wide else even(w)
        middle = ((w - out_w) // 2, (h - out_h) // 2)
        smooth, place, last, found = state or (None, (0.5, 0.5), middle, False)
        if n % every == 0:
            found = cx is not None and cy is not None
            if found:
                smooth = (cx, cy) if smooth is None else tuple(smoothing * s + (1 - smoothing) * v for s, v in zip(smooth, (cx, cy), strict=True))
        if found:
            goal = smooth[0], smooth[1] + dy
            dx, dv = goal[0] - place[0], goal[1] - place[1]
            far = (dx * dx + dv * dv) ** 0.5
            place = goal if most is None or far <= most else (place[0] + dx * most / far, place[1] + dv * most / far)
            last = tuple(max(0, min(int(p * full - own / 2), full - own)) for p, full, own in zip(place, (w, h), (out_w, out_h), strict=True))
            shown = last
        else:
            shown = last if fallback == "last_position" else middle
        return (smooth, place, last, found), {"x": shown[0], "y": shown[1], "w": out_w, "h": out_h}

    counted = frames.withColumn("__n", F.col(order).cast("long"))
    found = fold(counted, keys, [order], ["__n", "frame_w", "frame_h", "cx", "cy"], step, "__crop", "struct<x:long,y:long,w:long,h:long>")
    return found.select(*[c for c in found.columns if c not in ("__crop", "__n")], *[F.col(f"__crop.{s}").alias(f"crop_{n}") for s, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))])


def distinct_hashes(rows: DataFrame, keys: Sequence[str], order: str, code: str, most: int) -> DataFrame:
    """Rows whose 64-bit code differs in more than `most` bits from every row kept before them; a row without a code stays."""

    def step(state: tuple | None, x: int | None) -> tuple:
        held, n = state or (np.empty(16, np.int64), 0)
        if x is None:
            return (held, n), True
        if n and int(np.bitwise_count((held[:n] ^ np.int64(x)).view(np.uint64)).min()) <= most:
            return (held, n), False
        if n == len(held):
            held = np.concatenate([held, np.empty(n, np.int64)])
        held[n] = x
        return (held, n + 1), True

    return fold(rows, keys, [order], [code], step, "__kept", "boolean").filter("__kept").drop("__kept")


def next_frame(open_: list[tuple], boxes: np.ndarray, number: int, least: float, missed: int) -> tuple[list[tuple], list[int], int]:
    """Open tracks (id, misses, box) after a frame, the track of each of its boxes (x, y, width, height), and the highest number.

    Tracks, oldest first, take the best free box that overlaps theirs by more than `least`;
    what is left opens tracks; a track that has missed more than `missed` frames is closed.
    """
    got, held = [0] * len(boxes), []
    free = np.ones(len(boxes), bool)
    for ident, misses, box in open_:
        best = -1
        if free.any():
            low, high = np.maximum(boxes[:, :2], box[:2]), np.minimum(boxes[:, :2] + boxes[:, 2:], np.add(box[:2], box[2:]))
            shared = np.prod(np.maximum(high - low, 0), axis=1)
            union = box[2] * box[3] + boxes[:, 2] * boxes[:, 3] - shared
            score = np.where(free & (union > 0), shared / np.where(union > 0, union, 1), -1.0)
            best = int(score.argmax()) if score.max() > least else -1
        if best >= 0:
            free[best], got[best] = False, ident
            held.append((ident, 0, tuple(boxes[best])))
        elif misses < missed:
            held.append((ident, misses + 1, box))
    for k in np.flatnonzero(free).tolist():
        number += 1
        got[k] = number
        held.append((number, 0, tuple(boxes[k])))
    return held, got, number


def _tracks(least: float, missed: int, keys: Sequence[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        open_, number, out = [], 0, []
        for frame, dets in rows.sort_values(["frame_idx", "det_idx"]).groupby("frame_idx", sort=True):
            dets = dets[dets["det_idx"].notna()]
            open_, got, number = next_frame(open_, dets[["x", "y", "width", "height"]].to_numpy(float), number, least, missed)
            out += [(frame, int(d), t) for d, t in zip(dets["det_idx"], got, strict=True)]
        found = pd.DataFrame(out, columns=["frame_idx", "det_idx", "track_id"])
        for k in keys:
            found[k] = rows[k].iloc[0]
        return found[[*keys, "frame_idx", "det_idx", "track_id"]]

    return run


def tracks(detections: DataFrame, keys: Sequence[str], least: float = 0.3, missed: int = 3, sampled: DataFrame | None = None) -> DataFrame:
    """Track of each detection (keys of a shot, frame_idx, det_idx, x, y, width, height): tracks, oldest first, take the best free box of the next frame.

    A track is closed once it has missed more than `missed` frames in a row. sampled: the
    frames that were looked at (keys, frame_idx), those without detections among
    them; without it, the frames with detections. A shot is cut where more than `missed`
    frames have no detections, since every track is closed there: its pieces are tracked
    by different tasks, and the numbers of a piece's tracks go on from the pieces before.
    """
    kinds = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keys)
    if sampled is None:
        return detections.groupBy(*keys).applyInPandas(_tracks(least, missed, keys), f"{kinds}, frame_idx long, det_idx long, track_id long")
    there = detections.select(*keys, "frame_idx").distinct().withColumn("__seen", F.lit(True))
    in_order = Window.partitionBy(*keys).orderBy("frame_idx")
    frames = sampled.select(*keys, "frame_idx").distinct().join(there, [*keys, "frame_idx"], "left").withColumn("__k", F.row_number().over(in_order))
    # frames with detections, and how many without lie before each
    seen = frames.filter("__seen").withColumn("__gap", F.col("__k") - F.lag("__k").over(in_order) - 1)
    pieces = seen.withColumn("__piece", F.sum(F.when(F.col("__gap") > missed, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    looked = pieces.select(*keys, "frame_idx", "__k", "__piece").join(detections, [*keys, "frame_idx"])
    # frames without detections count as misses, which a frame's place among those looked at tells
    found = looked.groupBy(*keys, "__piece").applyInPandas(_piece_tracks(least, missed, keys), f"{kinds}, __piece long, frame_idx long, det_idx long, track_id long")
    found = kept(found)
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy(*keys, "__piece").agg(F.max("track_id").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return found.join(base.drop("__n"), [*keys, "__piece"]).select(*keys, "frame_idx", "det_idx", (F.col("track_id") + F.col("__base")).alias("track_id"))


def _piece_tracks(least: float, missed: int, keys: Sequence[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        open_, number, out, last = [], 0, [], None
        for (place, frame), dets in rows.sort_values(["__k", "det_idx"]).groupby(["__k", "frame_idx"], sort=True):
            skipped = 0 if last is None else int(place) - last - 1
            open_ = [(i, n + skipped, b) for i, n, b in open_ if n + skipped <= missed]
            open_, got, number = next_frame(open_, dets[["x", "y", "width", "height"]].to_numpy(float), number, least, missed)
            out += [(frame, int(d), t) for d, t in zip(dets["det_idx"], got, strict=True)]
            last = int(place)
        found = pd.DataFrame(out, columns=["frame_idx", "det_idx", "track_id"])
        for k in [*keys, "__piece"]:
            found[k] = rows[k].iloc[0]
        return found[[*keys, "__piece", "frame_idx", "det_idx", "track_id"]]

    return run


def hard_cut_groups(segments: DataFrame, keys: Sequence[str], order: str, has_transition: str) -> DataFrame:
    """Adds the number of the run of segments joined without a cut between groups: a new one at each transition."""
    w = Window.partitionBy(*keys).orderBy(order)
    return segments.withColumn("group", F.sum(F.when(F.col(has_transition) & (F.row_number().over(w) > 1), 1).otherwise(0)).over(w))
