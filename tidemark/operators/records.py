"""Rules on records of media: which rows stay, what they are looked up in, which default they take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def segment_context(words: DataFrame, segments: DataFrame, source: str = "source", bucket: float = intervals.DAY) -> DataFrame:
    """Each segment's words in its own time: those of its source that overlap it, shifted by its start. Segments without any have no rows.

    words: source, start, end and others; segments: plan_id, seq, source, first, last. A
    segment is a row for each bucket that it touches, so buckets are about as long as
    segments or longer.
    """
    spans = segments.withColumnsRenamed({"first": "start", "last": "end"})
    pairs = intervals.touching(words, spans, [source], bucket)
    shifted = {c: (F.col(f"l.{c}") - F.col("r.start")).alias(c) for c in ("start", "end")}
    kept = [shifted.get(c, F.col(f"l.{c}")) for c in words.columns]
    return pairs.select(*kept, *[F.col(f"r.{c}") for c in segments.columns if c not in (source, "first", "last")])


def missing_context(segments: DataFrame, needs: DataFrame, context: DataFrame) -> DataFrame:
    """plan_id, seq, key, source of each need (plan_id, seq, key) of a segment whose source has no such context (source, key)."""
    asked = needs.join(segments.select("plan_id", "seq", "source"), ["plan_id", "seq"])
    return asked.join(context.select("source", "key").distinct(), ["source", "key"], "left_anti").select("plan_id", "seq", "key", "source")


def merged_context(found: DataFrame, given: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of both tables, what is given before what was found."""
    a, b = found.select(key, F.col(value).alias("__found")), given.select(key, F.col(value).alias("__given"))
    return a.join(b, key, "full").select(key, F.coalesce("__given", "__found").alias(value))


def requested(rows: DataFrame, wanted: DataFrame, key: str, by: str = "pos") -> DataFrame:
    """The rows whose key is asked for (key, pos), each once, numbered in the order of the first request."""
    first = wanted.groupBy(key).agg(F.min(by).alias(by))
    return rows.join(first, key)


def frames_at(frames: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each request (keys, pos, frame_idx), repeats included, with its frame: only the frames asked for are read."""
    some = frames.join(wanted.select(*keys, "frame_idx").distinct(), [*keys, "frame_idx"], "left_semi")
    return wanted.join(some, [*keys, "frame_idx"])


def frame_slice(frames: DataFrame, count: Column, start: int | None, stop: int | None) -> DataFrame:
    """Frames [start, stop) of each video of `count` frames, numbered from zero; negative bounds count from the end."""
    at = lambda v, default: F.lit(default) if v is None else F.lit(v) if v >= 0 else F.greatest(F.lit(0), count + v)
    first = at(start, 0)
    last = count if stop is None else F.least(at(stop, 0), count)
    return frames.filter((F.col("frame_idx") >= first) & (F.col("frame_idx") < last)).withColumn("frame_idx", F.col("frame_idx") - first)


def halves(frames: DataFrame, count: Column, at: int | None = None) -> DataFrame:
    """Adds the half (0 or 1) of each frame, split at a frame, the middle one without it, and numbers each half from zero."""
    split = F.lit(at) if at else F.floor(count / 2)
    half = (F.col("frame_idx") >= split).cast("int")
    return frames.withColumn("half", half).withColumn("frame_idx", F.col("frame_idx") - F.when(half == 1, split).otherwise(0))


def appended(first: DataFrame, second: DataFrame, keys: Sequence[str], counts: DataFrame) -> DataFrame:
    """The frames of one video after those of another; counts: keys and frame_count of the first."""
    later = second.join(counts.select(*keys, "frame_count"), keys).withColumn("frame_idx", F.col("frame_idx") + F.col("frame_count")).drop("frame_count")
    return first.unionByName(later)


def confident_objects(found: DataFrame, least: float, labels: Sequence[str] | None = None) -> DataFrame:
    """Detections (label, confidence, x, y, width, height) that are sure enough, of the labels asked for, boxes clamped to the frame."""
    kept = found.filter(F.col("confidence") >= least)
    kept = kept if labels is None else kept.filter(F.col("label").isin(list(labels)))
    x, y = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in ("x", "y"))
    right, low = F.least(F.lit(1.0), F.col("x") + F.col("width")), F.least(F.lit(1.0), F.col("y") + F.col("height"))
    return kept.withColumns({"x": x, "y": y, "width": F.greatest(F.lit(0.0), right - x), "height": F.greatest(F.lit(0.0), low - y)})


def ranked(rows: DataFrame, keys: Sequence[str], by: Column, tie: str, name: str = "rank") -> DataFrame:
    """Adds each row's place within its key by falling `by`, ties in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), tie)))


def inlined(rows: DataFrame, keys: Sequence[str], order: str, most: int = 12) -> DataFrame:
    """Per key, the first `most` ids in order, and how many are left over; left_over() has those as rows."""
    placed = _placed(rows, keys, order)
    shown = F.array_sort(F.collect_list(F.when(F.col("__place") <= most, F.col(order))))
    return placed.groupBy(*keys).agg(shown.alias("shown"), F.count_if(F.col("__place") > most).alias("rest"))


def left_over(rows: DataFrame, keys: Sequence[str], order: str, most: int = 12) -> DataFrame:
    """The rows behind the first `most` of each key."""
    return _placed(rows, keys, order).filter(F.col("__place") > most).drop("__place")


def _placed(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def default_scenes(scenes: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """The scenes (key, start, end), and one over the whole length for media (key, total_seconds) with length but without scenes."""
    none = media.filter("total_seconds > 0").join(scenes.select(key).distinct(), key, "left_anti")
    return scenes.select(key, "start", "end").unionByName(none.select(key, F.lit(0.0).alias("start"), F.col("total_seconds").alias("end")))


def kept_frames(frames: DataFrame, windows: DataFrame, keys: Sequence[str], bucket: int = 1024) -> DataFrame:
    """The frames inside a keep-window (keys, first, stop; disjoint), renumbered without gaps: keys, frame_idx, src_idx.

    A frame's new number is its own less what lies in the gaps before its window, so no frame meets another.
    """
    w = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    shifted = windows.withColumn("base", F.coalesce(F.sum(F.col("stop") - F.col("first")).over(w), F.lit(0)))
    points = frames.select(*keys, "frame_idx", F.col("frame_idx").alias("start"), (F.col("frame_idx") + 1).alias("end"))
    spans = shifted.select(*keys, "base", F.col("first").alias("start"), F.col("stop").alias("end"))
    inside = intervals.touching(points, spans, keys, bucket)
    number = F.col("r.base") + F.col("l.frame_idx") - F.col("r.start")
    return inside.select(*[F.col(f"l.{k}").alias(k) for k in keys], number.alias("frame_idx"), F.col("l.frame_idx").alias("src_idx"))


def sliding_chunks(rows: DataFrame, total: Column, size: int, hop: int) -> DataFrame:
    """Adds start, n (samples there) and padded (samples of zero) of each window, tails included; one window where the whole is no longer than it."""
    starts = F.when(total <= size, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, F.lit(hop).cast("long")))
    out = rows.withColumn("start", F.explode(starts)).withColumn("n", F.least(F.lit(size).cast("long"), total.cast("long") - F.col("start")))
    return out.withColumn("padded", F.when(total <= size, F.lit(0).cast("long")).otherwise(F.lit(size) - F.col("n")))


def voiced_prefix(spans: DataFrame, keys: Sequence[str], rate: int, most: int) -> DataFrame:
    """The voiced spans (keys, start, end) in samples, in order, up to `most` samples in all: keys, first, n."""
    first = (F.col("start") * rate).cast("long")
    size = (F.col("end") * rate).cast("long") - first
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.select(*keys, "start", "end", first.alias("first"), size.alias("size"))
    left = F.lit(most) - F.coalesce(F.sum("size").over(w), F.lit(0))
    return rows.withColumn("n", F.least("size", left)).filter("n > 0").select(*keys, "first", "n")


def scene_line(scene: Column) -> Column:
    """A catalog scene (id, duration, shot_type, caption, transcript) as a line of a prompt."""
    filled = lambda c: F.when(scene[c] != "", scene[c])
    head = F.concat(F.lit("["), scene["id"], F.lit("] "), F.format_string("%.1f", scene["duration"]), F.lit("s"))
    return F.concat(F.concat_ws(" | ", head, filled("shot_type"), filled("caption")), F.coalesce(F.concat(F.lit("\n  speech: "), filled("transcript")), F.lit("")))


def downsamples_to(a: Column, b: Column) -> Column:
    """Whether media a (height, width, fps, total_seconds) has at least the size, rounded rate and length of b."""
    return (a["height"] >= b["height"]) & (a["width"] >= b["width"]) & (F.rint(a["fps"]) >= F.rint(b["fps"])) & (a["total_seconds"] >= b["total_seconds"])


def inherited_times(start: Column, end: Column, speaker: Column, segment: Column) -> Column:
    """start, end and speaker of a translated segment: zero times and a missing speaker are those of its original."""
    unset = (start == 0) & (end == 0)
    return F.struct(F.when(unset, segment["start"]).otherwise(start).alias("start"), F.when(unset, segment["end"]).otherwise(end).alias("end"), F.coalesce(speaker, segment["speaker"]).alias("speaker"))


def given_only(fields: dict[str, Column]) -> Column:
    """A map of the fields that are not null."""
    pairs = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def resolved_sources(segments: DataFrame, metas: DataFrame) -> DataFrame:
    """Segments with the metadata (source, total_seconds) of their source; code says where there is none."""
    found = segments.join(metas.select("source", "total_seconds"), "source", "left")
    return found.withColumn("code", F.when(F.col("total_seconds").isNull(), F.lit("source_unreadable")))
