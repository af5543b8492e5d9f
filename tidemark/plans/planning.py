"""Edit plans as tables: a row per segment and a row per operation; prediction, checks, repairs and streamability are column rules.

A segment has plan_id, seq, source, start, end and the source's metadata (fps,
width, height, frame_count, total_seconds); an operation has plan_id, seq, pos,
op and its arguments. All checks of a plan are collected, never only the first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-3
TASK_ROWS = 200_000  #: segments that a task sorts at a time, some hundred bytes each

#: What each operation is to a stream of frames. effect: changes frames in place, else a transform; filter: an effect that
#: becomes a filter; passthrough: it leaves pictures alone; requires: it needs context; streams; source: it looks at the source first; duration: it changes time.
TRAITS = ("effect", "filter", "passthrough", "requires", "streams", "source", "duration")
FRAME_EFFECTS = (
    "full_image_overlay", "blur_effect", "zoom_effect", "color_adjust", "vignette", "ken_burns", "fade", "image_overlay", "shake", "punch_in", "flash", "chromatic_aberration", "glitch", "film_grain",
    "sharpen", "pixelate", "mirror_flip", "kaleidoscope", "object_detection_overlay",
)
OPERATIONS: dict[str, tuple[str, ...]] = {op: ("effect", "streams") for op in FRAME_EFFECTS} | {
    "volume_adjust": ("effect", "filter", "passthrough", "streams"), "text_overlay": ("effect", "filter", "streams"), "add_subtitles": ("effect", "filter", "requires", "streams"),
    "cut": (), "cut_frames": (), "resize": ("streams",), "resample_fps": ("streams",), "crop": ("streams",), "speed_change": ("streams", "duration"), "freeze_frame": ("streams", "duration"),
    "silence_removal": ("requires", "streams", "duration"), "face_crop": ("streams", "source"),
}


def parse(plans: DataFrame, plan: str = "plan") -> tuple[DataFrame, DataFrame]:
    """Segments and operations of JSON plans (plan_id and the text): plan_id, seq, source, start, end; and plan_id, seq, pos, op, args (variant)."""
    value = F.try_parse_json(plan)
    segments = plans.select("plan_id", F.posexplode(F.from_json(F.to_json(F.try_variant_get(value, "$.segments", "variant")), "array<struct<source:string,start:double,end:double,operations:array<string>>>")).alias("seq", "s"))
    ops = segments.select("plan_id", "seq", F.posexplode("s.operations").alias("pos", "text")).withColumn("args", F.try_parse_json("text"))
    return segments.select("plan_id", "seq", "s.source", "s.start", "s.end"), ops.select("plan_id", "seq", "pos", F.try_variant_get("args", "$.op", "string").alias("op"), "args")


ERROR = "struct<code:string,location:string,field:string,value:double,limit:double>"


def _when(condition: Column, code: str, field: str, value: Column | None = None, limit: Column | None = None, place: str = "") -> Column:
    location = F.concat(F.lit("segments["), (F.col("seq") - 1).cast("string"), F.lit("]" + place))
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    return F.when(condition, F.struct(F.lit(code).alias("code"), location.alias("location"), F.lit(field).alias("field"), number(value).alias("value"), number(limit).alias("limit")))


def _listed(rows: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """A row for each rule that a row breaks: plan_id, seq, rule (its place among them), code, location, field, value, limit."""
    return rows.select("plan_id", "seq", F.posexplode(F.array(*rules)).alias("rule", "e")).filter("e is not null").select("plan_id", "seq", "rule", "e.*")


def _bounds(segments: DataFrame) -> tuple[list[Column], list[Column]]:
    """The rules of a segment's own bounds, and of its effect's window, which count only where its bounds are right."""
    start, end, total = F.col("start"), F.col("end"), F.col("total_seconds")
    own = [
        _when(start < 0, "segment_negative", "start", start, F.lit(0)),
        _when(end < 0, "segment_negative", "end", end, F.lit(0)),
        _when(end <= start, "segment_range", "end", end, start),
        _when(end > total + EPS, "segment_end_exceeds_source", "end", end, total),
    ]
    if "window_start" not in segments.columns:
        return own, []
    right, a, b, length, at = (start >= 0) & (end > start) & (end <= total + EPS), F.col("window_start"), F.col("window_stop"), end - start, ".operations[0]"
    return own, [
        _when(right & (a < 0), "window_negative", "window.start", a, F.lit(0), at),
        _when(right & (b < 0), "window_negative", "window.stop", b, F.lit(0), at),
        _when(right & (b < a), "window_order", "window.stop", b, a, at),
        _when(right & (a > length + EPS), "effect_window_exceeds_duration", "window.start", a, length, at),
        _when(right & (b > length + EPS), "effect_window_exceeds_duration", "window.stop", b, length, at),
    ]


def bounds_errors(segments: DataFrame) -> DataFrame:
    """One row per fault of a segment's bounds or effect window. segments: plan_id, seq, start, end, total_seconds and, optionally, window_start, window_stop."""
    own, window = _bounds(segments)
    return _listed(segments, own + window).drop("rule")


def repaired(segments: DataFrame, clamp_end: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments with what has one obvious repair repaired, and a row (plan_id, seq, location, field, old, new, code) for each change.

    A negative start becomes 0 and a window is clamped to the segment's length. An end past
    the source is clamped only with clamp_end, since that changes what is shown; without it
    such a segment stays as it is. Within EPS of a limit nothing changes.
    """
    start, end, total = F.col("start"), F.col("end"), F.col("total_seconds")
    beyond = end > total + EPS
    new_end = F.when(F.lit(clamp_end) & beyond, F.round(total, 4)).otherwise(end)
    new = {"start": F.when(start < 0, F.lit(0.0)).otherwise(start), "end": new_end}
    codes = {"start": F.lit("segment_negative"), "end": F.lit("segment_end_exceeds_source")}
    if "window_start" in segments.columns:
        length = new["end"] - new["start"]
        known = (length > 0) & (new["end"] <= total + EPS)
        for c in ("window_start", "window_stop"):
            v = F.col(c)
            new[c] = F.when(known & (v < 0), F.lit(0.0)).when(known & (v > length + EPS), length).otherwise(v)
            codes[c] = F.when(v < 0, "window_negative").otherwise("effect_window_exceeds_duration")
    both = segments.withColumns({f"__new_{c}": e for c, e in new.items()})
    place = F.concat(F.lit("segments["), (F.col("seq") - 1).cast("string"), F.lit("]"))

    def change(c: str) -> Column:
        named = (place if c in ("start", "end") else F.concat(place, F.lit(".operations[0]"))), F.lit(c.replace("_", ".")), F.col(c), F.col(f"__new_{c}"), codes[c]
        row = F.struct(*[v.alias(n) for n, v in zip(("location", "field", "old", "new", "code"), named, strict=True)])
        return F.when(~F.col(c).eqNullSafe(F.col(f"__new_{c}")), row)

    log = both.select("plan_id", "seq", F.explode(F.array_compact(F.array(*map(change, new)))).alias("x")).select("plan_id", "seq", "x.*")
    return both.withColumns({c: F.col(f"__new_{c}") for c in new}).drop(*[f"__new_{c}" for c in new]), log


def _concat() -> tuple[dict[str, Column], list[Column]]:
    """What a segment must know of its plan's first one, and the rules for both to be joined."""
    upto = Window.partitionBy("plan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    firsts = {f"__first_{c}": F.first(c).over(upto) for c in ("fps", "width", "height")}
    wrong = (F.col("width") != F.col("__first_width")) | (F.col("height") != F.col("__first_height"))
    return firsts, [_when(F.col("fps") != F.col("__first_fps"), "concat_mismatch", "fps", F.col("fps"), F.col("__first_fps")), _when(wrong, "concat_mismatch", "dimensions")]


def concat_errors(segments: DataFrame) -> DataFrame:
    """Segments whose rate or size differs from their plan's first: plan_id, seq, code, location, field, value, limit."""
    firsts, rules = _concat()
    return _listed(segments.withColumns(firsts), rules).drop("rule")


def _transitions(fps: Column) -> tuple[dict[str, Column], list[Column], list[Column]]:
    """What a segment must know of the one before it, the rule of its transition that needs no durations, and the one that does."""
    w = Window.partitionBy("plan_id").orderBy("seq")
    there, first, most = F.col("transition").isNotNull(), F.col("__first"), F.least("frames", "__before")
    overlap = F.rint(F.col("transition") * fps).cast("long")
    long = _when(there & ~first & (overlap >= most), "transition_too_long", "transition_in.duration", F.col("transition"), F.round(most / fps, 4))
    return {"__before": F.lag("frames").over(w), "__first": F.row_number().over(w) == 1}, [_when(there & first, "transition_too_long", "transition_in")], [long]


def transition_errors(segments: DataFrame, fps: Column) -> DataFrame:
    """Transitions that leave no frame of a segment they join, or stand before the first one. segments: plan_id, seq, frames, transition (seconds or null)."""
    before, structure, durations = _transitions(fps)
    return _listed(segments.withColumns(before), structure + durations).drop("rule")


def checked(segments: DataFrame, fps: Column) -> DataFrame:
    """All faults of each plan in the order in which they are found: plan_id, ord, code, location, field, value, limit.

    Transitions before the first segment come first, then bounds, then windows; what
    depends on every segment (concatenation, transitions' durations) is left out
    for plans with a segment that can't be cut. Rows without a plan_id are one plan.
    All rules are asked in one pass over the segments, which meet once, by plan_id.
    """
    own, window = _bounds(segments)
    firsts, concat = _concat()
    before, structure, durations = _transitions(fps)
    whole = Window.partitionBy("plan_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.max(reduce(Column.__or__, [rule.isNotNull() for rule in own])).over(whole)
    dependent = [F.when(~F.col("__cut"), rule) for rule in concat + durations]
    stages = [0] * len(structure) + [1] * len(own) + [2] * len(window) + [3] * len(concat) + [4] * len(durations)
    every = _listed(segments.withColumns(firsts | before | {"__cut": cut}), structure + own + window + dependent)
    stage = F.get(F.array(*map(F.lit, stages)), "rule")
    order = F.row_number().over(Window.partitionBy("plan_id").orderBy(stage, "seq", "rule"))
    return every.select("plan_id", order.alias("ord"), "code", "location", "field", "value", "limit")


def number_text(value: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def prompt_line(code: Column, location: Column, op: Column, field: Column, value: Column, limit: Column, detail: Column) -> Column:
    """A fault as a line of text; what is null is left out."""
    named = F.coalesce(F.concat(F.coalesce(field, F.lit("value")), F.lit("="), number_text(value)), field)
    clauses = F.concat_ws(", ", named, F.concat(F.lit("limit "), number_text(limit)))
    parts = [F.upper(code), F.coalesce(F.concat(F.lit(" at "), location), F.lit("")), F.coalesce(F.concat(F.lit(" (op '"), op, F.lit("')")), F.lit(""))]
    return F.concat(*parts, F.when(clauses != "", F.concat(F.lit(": "), clauses)).otherwise(""), F.coalesce(F.concat(F.lit(" -- "), detail), F.lit("")))


def normalised_sizes(segments: DataFrame) -> DataFrame:
    """Segments with the size of their plan's largest (first of equal ones) and whether a resize must be appended."""
    by = F.struct((F.col("width") * F.col("height")).alias("a"), (-F.col("seq")).alias("s"))
    target = segments.groupBy("plan_id").agg(F.max_by(F.struct("width", "height"), by).alias("t"))
    wrong = (F.col("width") != F.col("t.width")) | (F.col("height") != F.col("t.height"))
    return segments.join(target, "plan_id").withColumn("resize", wrong).withColumns({"width": F.col("t.width"), "height": F.col("t.height")}).drop("t")


def streamability(ops: DataFrame, keys: Sequence[str] = ("plan_id", "seq"), order: str = "pos", traits: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """keys, order, op and kind of each operation: how it runs in a single pass over the frames, by what stands before it in its list.

    frame_effect, filter or unstreamable: what needs context after a change of duration, a
    frame effect after a filter that itself follows one, and a look at the source
    behind any effect can't stream. A list of operations is one segment's, a few.
    """
    table = F.create_map(*[x for op, has in (traits or OPERATIONS).items() for x in (F.lit(op), F.array(*[F.lit(t) for t in has]).cast("array<string>"))])
    known = F.coalesce(F.try_element_at(table, F.col("op")), F.array().cast("array<string>"))
    item = F.struct(order, "op", *[F.array_contains(known, t).alias(t) for t in TRAITS])
    kind = """case when x.effect then case when x.requires and a.d then 'unstreamable' when x.filter then 'filter' when not x.streams or a.n then 'unstreamable' else 'frame_effect' end
                   when x.requires and a.d or not x.streams or x.source and (a.e or a.n) then 'unstreamable' else 'filter' end"""
    step = f"""transform(array({kind}), k -> named_struct(
        'e', a.e or x.effect and not x.filter and not (x.requires and a.d),
        'n', a.n or k = 'filter' and not x.passthrough and (a.e or a.n and not x.effect),
        'd', a.d or k = 'filter' and not x.effect and x.duration, 'o', array_append(a.o, k)))[0]"""
    folded = ops.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("xs")).withColumn(
        "ks", F.expr(f"aggregate(xs, named_struct('e', false, 'n', false, 'd', false, 'o', cast(array() as array<string>)), (a, x) -> {step}).o")
    )
    return folded.select(*keys, F.explode(F.arrays_zip("xs", "ks")).alias("x")).select(*keys, f"x.xs.{order}", "x.xs.op", F.col("x.ks").alias("kind"))


def predicted(meta: DataFrame, op: str, **args) -> DataFrame:
    """The metadata (fps, width, height, frame_count, total_seconds) that an operation makes of each row's; null where the operation can't run."""
    n, fps, seconds = F.col("frame_count"), F.col("fps"), F.col("total_seconds")
    w, h = F.col("width"), F.col("height")
    out: dict[str, Column] = {}
    if op == "cut":
        a, b = F.rint(args["start"] * fps), F.rint(args["end"] * fps)
        out["frame_count"] = F.when((b > a) & (b <= n + 1), F.least(b, n) - a)
    elif op == "cut_frames":
        out["frame_count"] = F.when((F.lit(args["end"]) > args["start"]) & (F.lit(args["end"]) <= n), F.lit(args["end"] - args["start"]))
    elif op == "resize":
        even = lambda v: F.greatest(F.lit(2), (F.rint(v / 2) * 2).cast("int"))
        width, height = args.get("width"), args.get("height")
        out["width"] = even(F.lit(width)) if width else even(w * height / h)
        out["height"] = even(F.lit(height)) if height else even(h * width / w)
    elif op == "resample_fps":
        out["fps"], out["frame_count"] = F.lit(float(args["fps"])), F.rint(seconds * args["fps"])
    elif op == "crop":
        size = lambda v, full: F.floor(full * v) if isinstance(v, float) and 0 < v <= 1 else F.lit(int(v))
        width, height = size(args["width"], w), size(args["height"], h)
        fits = (width <= w) & (height <= h)
        out["width"], out["height"] = F.when(fits, width), F.when(fits, height)
    elif op == "speed_change":
        a, b = args["speed"], args.get("end_speed") or args["speed"]
        frames = (n / ((a + b) / 2)).cast("int")
        out["frame_count"] = F.when(frames > 0, frames)
    elif op == "freeze_frame":
        held, first = F.rint(args.get("duration", 2.0) * fps), F.least(F.rint(args["timestamp"] * fps), n - 1)
        inside = (F.lit(args["timestamp"]) >= 0) & (F.lit(args["timestamp"]) < seconds)
        out["frame_count"] = F.when(inside, n + held - (F.least(held, n - first) if args.get("position") == "replace" else 0))
    elif op == "aspect_crop":
        # the largest box of that shape, both sides even
        ratio = args["ratio"][0] / args["ratio"][1]
        even = lambda v: F.greatest(F.lit(2), (F.floor(v.cast("int") / 2) * 2).cast("int"))
        wide, tall, broad = F.lit(ratio) < w / h, even(h), even(w)
        out["width"], out["height"] = F.when(wide, even(tall * ratio)).otherwise(broad), F.when(wide, tall).otherwise(even(broad / ratio))
    else:
        raise ValueError(f"unknown operation {op!r}")
    out = {c: e.cast(meta.schema[c].dataType) for c, e in out.items()}
    changed = meta.withColumns(out)
    return changed.withColumn("total_seconds", F.round(F.col("frame_count") / F.col("fps"), 4)) if {"frame_count", "fps"} & out.keys() else changed


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over all shuffle partitions by key, however few bytes they are: a number that is given is not coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def dealt_by_rows(rows: DataFrame, key: str, least: int = 0) -> DataFrame:
    """rows over as many partitions by key as leave each about TASK_ROWS, and a partition a core, or `least`, at least.

    Windows over the key follow without a further shuffle. Coalesced by bytes, a partition
    would be some millions of segments, all of them in a task's sorts at once.
    """
    return rows.repartition(max(least, rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), key)


def index_map(meta: DataFrame, op: str, **args) -> DataFrame:
    """video_id, frame_idx, src_idx: which source frame each frame of the result shows, for operations that only move frames.

    A few bytes of metadata make thousands of frames, so videos are dealt over all tasks
    by video_id first; a file of them would else be one task's. Sums per video need no
    further shuffle.
    """
    n, fps = F.col("frame_count"), F.col("fps")
    meta = _dealt(meta, "video_id")
    if op == "cut":
        a, b = F.rint(args["start"] * fps).cast("long"), F.least(F.rint(args["end"] * fps).cast("long"), n)
        return meta.select("video_id", F.posexplode(F.sequence(a, b - 1)).alias("frame_idx", "src_idx"))
    if op == "resample_fps":
        size = F.rint(n / fps * args["fps"]).cast("long")
        rows = meta.select("video_id", "frame_count", "fps", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("frame_idx"))
        return rows.select("video_id", "frame_idx", F.least(n - 1, F.floor(F.col("frame_idx") * fps / args["fps"])).alias("src_idx"))
    if op == "speed_change":
        first, last = args["speed"], args.get("end_speed") or args["speed"]
        size = (n / ((first + last) / 2)).cast("long")
        rows = meta.filter(size > 0).select("video_id", "frame_count", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("frame_idx"))
        j = F.col("frame_idx")
        # frame i is due at a place that grows with i; a slot shows the last frame that is due before the slot's middle
        if first == last:
            before = j * first + (0.5 if first > 1 else first / 2)
        else:
            # speed grows along the source, so places are a logarithm of i, and i an exponential of the place
            before = n * first / (last - first) * (F.exp((j + 0.5) * math.log(last / first) / F.col("size")) - 1)
        # the last whole number below the place, where up to 5e-10 above a whole number counts as on it (F.round of doubles makes decimals)
        whole = F.floor(before)
        return rows.select("video_id", "frame_idx", F.greatest(F.lit(0), F.least(n - 1, F.when(before - whole < 5e-10, whole - 1).otherwise(whole))).alias("src_idx"))
    if op == "freeze_frame":
        at = F.least(n - 1, F.rint(args["timestamp"] * fps)).cast("long")
        held = F.rint(args.get("duration", 2.0) * fps).cast("long")
        replaced = F.least(held, n - at) if args.get("position") == "replace" else F.lit(0).cast("long")
        rows = meta.select("video_id", at.alias("at"), held.alias("held"), replaced.alias("gone"), F.explode(F.sequence(F.lit(0).cast("long"), n + held - replaced - 1)).alias("frame_idx"))
        j = F.col("frame_idx")
        # inserted frames stand at the held one, before or after makes no difference; replaced ones go from it on
        stop = F.col("at") + F.col("held") - F.when(F.col("gone") > 0, 1).otherwise(0)
        src = F.when(j <= F.col("at"), j).when(j <= stop, F.col("at")).otherwise(j - F.col("held") + F.col("gone"))
        return rows.select("video_id", "frame_idx", src.alias("src_idx"))
    raise ValueError(f"{op!r} does more than move frames")


def timeline_map(segments: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys, frame_idx, group, seq_a, idx_a, seq_b, idx_b, weight: what each frame of the assembled timeline shows.

    segments: keys, order, frames, and overlap: by how many frames a segment fades in over
    the end of the one before (0 for a cut; it counts for nothing on the first). In an
    overlap frame b is mixed in with the weight k / overlap of its k-th frame; elsewhere b
    is null. group counts the runs of segments that are joined by cuts. A segment must have
    at least as many frames as its two overlaps together. Each frame is made by its own
    segment, so no frame meets another.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.coalesce("overlap", F.lit(0))).cast("long")
    rows = segments.withColumn("__in", own).withColumns({
        "__out": F.coalesce(F.lead("__in").over(w), F.lit(0)), "__frames": F.lag("frames").over(w), "__seq": F.lag(order).over(w),
        "group": F.sum(F.when(F.col("__in") > 0, 1).otherwise(0)).over(upto),
    })
    rows = rows.withColumn("__at", F.coalesce(F.sum(F.col("frames") - F.col("__in")).over(before), F.lit(0)) - F.col("__in"))
    rows = rows.withColumn("__at", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("__at")))
    shown = rows.select(*keys, "group", order, "__in", "__frames", "__seq", "__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - F.col("__out") - 1)).alias("k"))
    fading, k = F.col("k") < F.col("__in"), F.col("k")
    return shown.select(
        *keys, (F.col("__at") + k).alias("frame_idx"), "group",
        F.when(fading, F.col("__seq")).otherwise(F.col(order)).alias("seq_a"), F.when(fading, F.col("__frames") - F.col("__in") + k).otherwise(k).alias("idx_a"),
        F.when(fading, F.col(order)).alias("seq_b"), F.when(fading, k).alias("idx_b"), F.when(fading, k / F.col("__in")).alias("weight"),
    )
