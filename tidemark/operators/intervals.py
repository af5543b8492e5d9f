"""Interval algebra over rows with a start and an end in seconds; intervals are half-open.

Each operator partitions by its keys, merging also by time buckets, and orders
within them; no rows leave the JVM. Joins on overlap are equi-joins on the
keys and a time bucket, so a long recording spreads over its buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
DAY = 86400.0  #: seconds of the time buckets that rows are dealt by


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], starts: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run of rows that each row belongs to; `starts` is true where a run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def _with(rows: DataFrame, facts: DataFrame, cells: Sequence[str]) -> DataFrame:
    """rows with the columns that facts hold for their cell; null keys are equal."""
    named = {c: f"__cell{k}" for k, c in enumerate(cells)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    return rows.join(facts.withColumnsRenamed(named), same).drop(*named.values())


def _bucketed(spans: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Callable[[Column], Column], furthest: bool, bucket: float) -> DataFrame:
    """Adds `__island`, the number of a row's run within its keys; `breaks` of the end before it tells whether a row begins one.

    That end is the one of the row before or, with `furthest`, the greatest of all
    rows before. `order` begins with the start. Rows are dealt by key and time bucket,
    so a key with a third of all rows spans many tasks; what buckets hand on to later
    ones is one row for each key and bucket.
    """
    cells, past = [*keys, "__bucket"], Window.partitionBy(*keys).orderBy("__bucket")
    spans = spans.withColumn("__bucket", F.floor(F.col("start") / bucket))
    w = Window.partitionBy(*cells).orderBy(*order)
    if furthest:
        ends = spans.groupBy(*cells).agg(F.max("end").alias("__end")).withColumn("__end", F.max("__end").over(past.rowsBetween(*BEFORE)))
        before = F.greatest(F.max("end").over(w.rowsBetween(*BEFORE)), "__end")
    else:
        ends = spans.groupBy(*cells).agg(F.max_by("end", F.struct(*order)).alias("__end")).withColumn("__end", F.lag("__end").over(past))
        before = F.when(F.row_number().over(w) == 1, F.col("__end")).otherwise(F.lag("end").over(w))
    marked = _with(spans, ends, cells).withColumn("__before", before)
    marked = marked.withColumn("__new", F.when(F.col("__before").isNull() | breaks(F.col("__before")), 1).otherwise(0)).drop("__before", "__end")
    counts = marked.groupBy(*cells).agg(F.sum("__new").alias("__offset")).withColumn("__offset", F.coalesce(F.sum("__offset").over(past.rowsBetween(*BEFORE)), F.lit(0)))
    inside = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _with(marked, counts, cells).withColumn("__island", F.col("__offset") + inside).drop("__bucket", "__new", "__offset")


def merge_events(events: DataFrame, keys: Sequence[str], gap: float = 0.5, order: str = "event_id", bucket: float = DAY) -> DataFrame:
    """Events of a key that follow each other by at most `gap` become one: it ends where its last event ends and has the highest confidence."""
    marked = _bucketed(events, keys, ["start", order], lambda last: F.col("start") - last > gap, False, bucket)
    return marked.groupBy(*keys, "__island").agg(
        F.min("start").alias("start"),
        F.max_by("end", F.struct("start", order)).alias("end"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n"),
    ).drop("__island")


def _joined(spans: DataFrame, keys: Sequence[str], order: Sequence[str], gap: float, bucket: float = DAY) -> DataFrame:
    """Spans merged where one begins at most `gap` after the furthest end before it, in the given order."""
    marked = _bucketed(spans, keys, order, lambda reach: F.col("start") > reach + gap, True, bucket)
    return marked.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def speech_windows(words: DataFrame, keys: Sequence[str], padding: float, total: Column, order: Sequence[str]) -> DataFrame:
    """Words padded, clamped to [0, total], and merged in the given order where they touch."""
    padded = words.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - padding), "end": F.least(total, F.col("end") + padding)})
    return _joined(padded.filter("end > start"), keys, order, 0.0)


def merge_regions(regions: DataFrame, keys: Sequence[str], duration: Column, pad: float = 0.5, gap: float = 1.0) -> DataFrame:
    """Regions within the recording, padded, clamped and merged across gaps of at most `gap`."""
    inside = regions.filter((F.col("end") > F.col("start")) & (F.col("end") > 0) & (F.col("start") < duration))
    padded = inside.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - pad), "end": F.least(duration, F.col("end") + pad)})
    return _joined(padded, keys, ["start", "end"], gap)


def complement(spans: DataFrame, keys: Sequence[str], total: Column, least: float = 0.0) -> DataFrame:
    """The gaps between sorted, disjoint spans of [0, total], head and tail included, of at least `least`."""
    w = Window.partitionBy(*keys).orderBy("start")
    before = spans.select(*keys, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("low"), F.col("start").alias("high"))
    tail = spans.groupBy(*keys).agg(F.max("end").alias("low"), F.max(total).alias("high"))
    gaps = before.unionByName(tail).filter((F.col("high") > F.col("low")) & (F.col("high") - F.col("low") >= least))
    return gaps.withColumnsRenamed({"low": "start", "high": "end"})


def frame_ranges(spans: DataFrame, fps: float) -> DataFrame:
    """Spans as frames [first, stop), both ends rounded half to even; empty ones go."""
    out = spans.withColumns({"first": F.rint(F.col("start") * fps).cast("long"), "stop": F.rint(F.col("end") * fps).cast("long")})
    return out.drop("start", "end").filter("stop > first")


def sliced(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows that touch [start, end), whole, shifted so that start is 0; none if start >= end."""
    touching = rows.filter((F.col("end") > start) & (F.col("start") < end) & F.lit(start < end))
    return touching.withColumns({"start": F.col("start") - start, "end": F.col("end") - start})


def touching(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """Pairs of rows of the same keys with l.end > r.start and l.start < r.end, l.* and r.* as structs. An empty interval touches what it lies within.

    Each interval goes to the buckets that it touches; a pair counts in the first bucket that both touch.
    """

    def spread(df: DataFrame, name: str) -> DataFrame:
        low, high = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
        return df.filter("end >= start").select(*keys, F.struct(*df.columns).alias(name), low.alias(f"{name}_low"), F.explode(F.sequence(low, high)).alias("__bucket"))

    pairs = spread(left, "l").join(spread(right, "r"), [*keys, "__bucket"]).filter(F.col("__bucket") == F.greatest("l_low", "r_low"))
    return pairs.filter((F.col("l.end") > F.col("r.start")) & (F.col("l.start") < F.col("r.end"))).select("l", "r")


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """Pairs of rows of the same keys whose intervals overlap: l.* and r.* as structs, and the overlap in seconds."""
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    pairs = touching(left.filter("end > start"), right.filter("end > start"), keys, bucket)
    return pairs.withColumn("overlap", shared).filter("overlap > 0")


def attach_by_overlap(targets: DataFrame, sources: DataFrame, keys: Sequence[str], ident: str, order: str, columns: Sequence[str], bucket: float = 3600.0) -> DataFrame:
    """Targets with `columns` of the source of the longest overlap, the first by `order` of equal ones; null without any."""
    best = overlaps(targets, sources, keys, bucket).groupBy(F.col(f"l.{ident}").alias(ident)).agg(F.max_by("r", F.struct("overlap", (-F.col(f"r.{order}")).alias("o"))).alias("__best"))
    return targets.join(best, ident, "left").select(*targets.columns, *[F.col(f"__best.{c}").alias(c) for c in columns])


def nearest(rows: DataFrame, sources: DataFrame, keys: Sequence[str], ident: str, order: str) -> DataFrame:
    """The source whose midpoint is nearest to each row's, the first by `order` of equal ones, as struct `r`: two window passes over both tables at once."""
    middle = (F.col("start") + F.col("end")) / 2
    left = rows.select(*keys, middle.alias("m"), F.col(ident).alias("__ident"), F.lit(None).cast(sources.schema["start"].dataType).alias("__o"), F.lit(None).alias("r"))
    right = sources.select(*keys, middle.alias("m"), F.lit(None).alias("__ident"), F.col(order).alias("__o"), F.struct(*sources.columns).alias("r"))
    right = right.groupBy(*keys, "m").agg(F.min_by("r", "__o").alias("r"), F.min("__o").alias("__o")).withColumn("__ident", F.lit(None))
    both = left.select(*keys, "m", "__ident", F.lit(None).cast(right.schema["__o"].dataType).alias("__o"), F.lit(None).cast(right.schema["r"].dataType).alias("r")).unionByName(
        right.select(*keys, "m", F.col("__ident").cast(left.schema["__ident"].dataType), "__o", "r")
    )
    w = Window.partitionBy(*keys).orderBy("m")
    held = F.when(F.col("r").isNotNull(), F.struct("m", "__o", "r"))
    found = both.withColumns(
        {"lo": F.last(held, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "hi": F.first(held, True).over(w.rangeBetween(0, Window.unboundedFollowing))}
    ).filter(F.col("__ident").isNotNull())
    down, up = F.col("m") - F.col("lo.m"), F.col("hi.m") - F.col("m")
    low = F.when(F.col("hi").isNull(), True).when(F.col("lo").isNull(), False).otherwise((down < up) | ((down == up) & (F.col("lo.__o") <= F.col("hi.__o"))))
    return found.select(F.col("__ident").alias(ident), F.when(low, F.col("lo.r")).otherwise(F.col("hi.r")).alias("r")).filter("r is not null")


def assign_speakers(words: DataFrame, turns: DataFrame, keys: Sequence[str], ident: str, order: str, bucket: float = 3600.0) -> DataFrame:
    """Words with the speaker of the turn that overlaps them most, else of the turn nearest by midpoint; without turns null."""
    attached = attach_by_overlap(words, turns.withColumnRenamed("label", "speaker"), keys, ident, order, ["speaker"], bucket)
    named, rest = attached.filter("speaker is not null"), attached.filter("speaker is null").drop("speaker")
    close = nearest(rest, turns.withColumnRenamed("label", "speaker"), keys, ident, order).select(ident, F.col("r.speaker").alias("speaker"))
    return named.unionByName(rest.join(close, ident, "left").select(*rest.columns, "speaker"))


def tiles(words: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A cue's time as centisecond intervals, one per word and one per gap (highlight null), contiguous and without overlap.

    words: keys, cue_start, cue_end, start, end and an order within the cue.
    """
    cs = lambda c: F.rint(F.col(c) * 100).cast("long")
    w = Window.partitionBy(*keys).orderBy(order)
    low = words.withColumns({"__c0": cs("cue_start"), "__c1": cs("cue_end"), "__s": cs("start"), "__e": cs("end"), "__i": F.row_number().over(w) - 1})
    low = low.withColumns({"__s": F.least(F.greatest("__s", "__c0"), "__c1"), "__e": F.least(F.greatest("__e", "__c0"), "__c1")})
    cursor = F.greatest(F.coalesce(F.max("__e").over(w.rowsBetween(*BEFORE)), F.col("__c0")), F.col("__c0"))
    placed = low.withColumn("__cursor", cursor).withColumn("__s", F.greatest("__s", "__cursor")).withColumn("__e", F.greatest("__e", "__s"))
    placed = placed.withColumn("__last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())) == 1)
    end = F.greatest("__cursor", "__e")
    none = F.lit(None).cast("int")
    parts = F.array(
        F.struct(F.col("__cursor").alias("start_cs"), F.col("__s").alias("end_cs"), none.alias("highlight")),
        F.struct(F.col("__s").alias("start_cs"), F.col("__e").alias("end_cs"), F.col("__i").cast("int").alias("highlight")),
        F.struct(end.alias("start_cs"), F.when(F.col("__last"), F.col("__c1")).otherwise(end).alias("end_cs"), none.alias("highlight")),
    )
    return placed.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*").filter("end_cs > start_cs")


def excerpts(scenes: DataFrame, words: DataFrame, keys: Sequence[str], scene: str, order: str, most: int, bucket: float = 3600.0) -> DataFrame:
    """The words that overlap each scene, in order, white space collapsed, cut to `most` characters with an ellipsis."""
    held = overlaps(scenes, words, keys, bucket).groupBy(F.col(f"l.{scene}").alias(scene)).agg(
        F.array_sort(F.collect_list(F.struct(F.col("r.start").alias("s"), F.col(f"r.{order}").alias("o"), F.col("r.word").alias("w")))).alias("ws")
    )
    text = F.trim(F.regexp_replace(F.array_join("ws.w", " "), r"\s+", " "))
    cut = F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)
    return scenes.join(held, scene, "left").select(*scenes.columns, F.coalesce(cut, F.lit("")).alias("transcript"))


def silent_runs(levels: DataFrame, keys: Sequence[str], threshold: float, least: float) -> DataFrame:
    """Runs of windows below the threshold, from the first's start to the next loud one's (or the last's end), of at least `least`.

    levels: keys, start, end, level.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    quiet = F.col("level") < threshold
    marked = levels.withColumns({"__quiet": quiet, "__next": F.lead("start").over(w)})
    runs = islands(marked, keys, ["start"], F.coalesce(F.lag("__quiet").over(w) != F.col("__quiet"), F.lit(True)), "__run").filter("__quiet")
    out = runs.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max(F.coalesce("__next", "end")).alias("end"), F.avg("level").alias("level")).drop("__run")
    return out.filter(F.col("end") - F.col("start") >= least)


def normalise_scenes(scenes: DataFrame, keys: Sequence[str], duration: Column, fps: Column) -> DataFrame:
    """Scenes clamped to the media, empty ones dropped, frames recomputed where they are inverted, times to six places."""
    clamped = scenes.withColumns({"start": F.greatest(F.lit(0.0), F.least(duration, F.col("start"))), "end": F.greatest(F.lit(0.0), F.least(duration, F.col("end")))}).filter("end > start")
    wrong = F.col("end_frame") <= F.col("start_frame")
    first = F.when(wrong, F.rint(F.col("start") * fps).cast("int")).otherwise(F.col("start_frame"))
    stop = F.when(wrong, F.rint(F.col("end") * fps).cast("int")).otherwise(F.col("end_frame"))
    return clamped.withColumns({"start_frame": first, "end_frame": stop, "start": F.round("start", 6), "end": F.round("end", 6)})


def hold_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, every: int, name: str = "held") -> DataFrame:
    """Each row's value at the latest row that was looked at, which is every `every`-th of its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = F.when((F.row_number().over(w) - 1) % every == 0, F.col(value))
    return rows.withColumn("__seen", seen).withColumn(name, F.last("__seen", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__seen")
