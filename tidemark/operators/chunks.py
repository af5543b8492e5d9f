"""Audio as rows of chunks: a clip is its keys, chunk numbers from 0 and, in each row, `size` samples of one channel (the last one fewer).

A clip is as long as its rows are many, and no operator brings a clip together: what
spans the border of two chunks is put together from parts of both (cuts, joins,
overlays) or from partial sums (levels, windows). All chunks of a clip but the last
have the same size, so a chunk's place is its number times the size. Null samples count
as silence; a clip without samples has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = "array<double>"


def chunked(clips: DataFrame, keys: Sequence[str], samples: str, size: int) -> DataFrame:
    """Chunks of clips that hold their samples in one array."""
    last = F.floor((F.size(samples) - 1) / size).cast("long")
    rows = clips.filter(F.size(samples) > 0).select(*keys, F.col(samples).alias("__s"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return rows.select(*keys, "chunk", _clean(F.slice("__s", (F.col("chunk") * size + 1).cast("int"), F.lit(size))).alias("samples"))


def whole(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clips in one array again; only for clips that are known to be short."""
    held = F.array_sort(F.collect_list(F.struct("chunk", "samples")))
    return chunks.groupBy(*keys).agg(F.flatten(held["samples"]).alias("samples"))


def _clean(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def lengths(chunks: DataFrame, keys: Sequence[str], name: str = "length") -> DataFrame:
    """The number of samples of each clip."""
    return chunks.groupBy(*keys).agg(F.sum(F.size("samples").cast("long")).alias(name))


def levels(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, length, rms, peak of each clip, from each chunk's sum of squares and largest value."""
    parts = chunks.select(*keys, F.size("samples").cast("long").alias("n"), _total(F.transform("samples", lambda x: x * x)).alias("s"), F.array_max(F.transform("samples", F.abs)).alias("p"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("length"), F.sqrt(F.sum("s") / F.sum("n")).alias("rms"), F.max("p").alias("peak"))


def moved(chunks: DataFrame, keys: Sequence[str], size: int, by: Column, length: Column | None = None) -> DataFrame:
    """Clips moved by `by` samples (a column of the rows; to the left if negative) and cut off before 0 and, if given, behind `length`.

    A chunk falls into two chunks of the result at most, so a row of the result is made of
    two parts; what lies before the moved clip in its first chunk is silence.
    """
    first = F.col("chunk") * size + by
    rows = chunks.withColumns({"__first": first.cast("long"), "__stop": (first + F.size("samples")).cast("long")})
    if length is not None:
        rows = rows.withColumn("__stop", F.least("__stop", length.cast("long")))
    rows = rows.filter(F.col("__stop") > F.greatest("__first", F.lit(0)))
    low = F.greatest(F.lit(0), F.floor(F.col("__first") / size)).cast("long")
    spread = rows.select(*keys, "samples", "__first", "__stop", F.explode(F.sequence(low, F.floor((F.col("__stop") - 1) / size).cast("long"))).alias("chunk"))
    start = F.greatest(F.col("__first"), F.col("chunk") * size)
    stop = F.least(F.col("__stop"), (F.col("chunk") + 1) * size)
    part = F.slice("samples", (start - F.col("__first") + 1).cast("int"), (stop - start).cast("int"))
    held = F.array_sort(F.collect_list(F.struct((start - F.col("chunk") * size).cast("int").alias("at"), part.alias("samples"))))
    return spread.groupBy(*keys, "chunk").agg(held.alias("parts")).select(
        *keys, "chunk", F.concat(F.array_repeat(F.lit(0.0), F.col("parts")[0]["at"]), F.flatten("parts.samples")).alias("samples")
    )


def cut(chunks: DataFrame, keys: Sequence[str], size: int, rate: int, start: float, end: float) -> DataFrame:
    """The samples from start to end (seconds), both cut down to whole samples, in chunks of their own."""
    if not 0 <= start <= end:
        raise ValueError("a slice begins at 0 or later and doesn't end before it begins")
    first, stop = int(start * rate), int(end * rate)
    inside = chunks.filter((F.col("chunk") >= first // size) & (F.col("chunk") * size < stop))
    return moved(inside, keys, size, F.lit(-first), F.lit(stop - first))


def scaled(chunks: DataFrame, factor: Column) -> DataFrame:
    """Multiplied and clipped to [-1, 1]."""
    return chunks.withColumn("samples", F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * factor))))


def normalised(chunks: DataFrame, keys: Sequence[str], target_db: float = -3.0, method: str = "peak") -> DataFrame:
    """Brought to a peak or rms level; silent clips as they are. One row a clip is joined back."""
    if method not in ("peak", "rms"):
        raise ValueError(f"unknown method {method!r}")
    level = levels(chunks, keys).select(*keys, F.col(method).alias("__level"))
    gain = F.when(F.col("__level") < 1e-7, F.lit(None)).otherwise(F.pow(F.lit(10.0), F.lit(target_db / 20)) / F.col("__level"))
    rows = chunks.join(level, list(keys)).withColumn("__gain", gain)
    changed = F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.col("__gain"))))
    return rows.withColumn("samples", F.when(F.col("__gain").isNull(), F.col("samples")).otherwise(changed)).drop("__level", "__gain")


def _added(a: DataFrame, b: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Sums of two clips, chunk by chunk; shorter chunks are filled up with silence where the other one or a later chunk needs it."""
    rows = a.withColumn("__which", F.lit(0)).unionByName(b.withColumn("__which", F.lit(1)))
    both = rows.groupBy(*keys, "chunk").agg(F.collect_list("samples").alias("__two"))
    longest = F.aggregate("__two", F.lit(0), lambda n, s: F.greatest(n, F.size(s)))
    most = F.max("chunk").over(Window.partitionBy(*keys))
    n = F.when(F.col("chunk") < most, F.lit(size)).otherwise(longest)
    filled = lambda s, n: F.concat(s, F.array_repeat(F.lit(0.0), n - F.size(s)))
    total = F.aggregate("__two", F.array_repeat(F.lit(0.0), n), lambda t, s: F.zip_with(t, filled(s, n), lambda x, y: x + y))
    return both.select(*keys, "chunk", total.alias("samples"))


def overlaid(a: DataFrame, b: DataFrame, keys: Sequence[str], size: int, at: int) -> DataFrame:
    """b added to a from sample `at` on; a clip whose sum passes 1 is brought down to a peak of 1."""
    both = _filled(_added(a, moved(b, keys, size, F.lit(at)), keys, size), keys, size)
    top = both.groupBy(*keys).agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("__top"))
    rows = both.join(top, list(keys))
    return rows.withColumn("samples", F.when(F.col("__top") > 1, F.transform("samples", lambda x: x / F.col("__top"))).otherwise(F.col("samples"))).drop("__top")


def _filled(chunks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Adds silent chunks where numbers are missing before a clip's last chunk: one row a gap tells how many."""
    before = F.lag("chunk", 1, -1).over(Window.partitionBy(*keys).orderBy("chunk"))
    gaps = chunks.select(*keys, "chunk", before.alias("__before")).filter("chunk > __before + 1")
    silent = gaps.select(*keys, F.explode(F.sequence(F.col("__before") + 1, F.col("chunk") - 1)).alias("chunk"), F.array_repeat(F.lit(0.0), size).alias("samples"))
    return chunks.unionByName(silent)


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], size: int, overlap: int = 0) -> DataFrame:
    """a then b; the last `overlap` samples of a fade linearly into the first of b. Clips that only one side has stay as they are."""
    n = lengths(a, keys, "__n")
    place = F.col("chunk") * size
    fade = F.greatest(F.coalesce("__n", F.lit(0)) - overlap, F.lit(0))
    out = F.transform("samples", lambda x, i: F.when(place + i >= fade, x * (1 - (place + i - fade) / F.lit(float(overlap or 1)))).otherwise(x))
    rise = F.transform("samples", lambda x, i: F.when((place + i < overlap) & F.col("__n").isNotNull(), x * ((place + i) / F.lit(float(overlap or 1)))).otherwise(x))
    there = b.select(*keys).distinct().withColumn("__there", F.lit(True))
    left = a.join(n, list(keys)).join(there, list(keys), "left")
    left = left.withColumn("samples", F.when(F.col("__there") & F.lit(overlap > 0), out).otherwise(F.col("samples"))).select(*keys, "chunk", "samples")
    right = b.join(n, list(keys), "left")
    if overlap:
        right = right.withColumn("samples", rise)
    right = moved(right.withColumn("__by", F.when(F.col("__n").isNull(), 0).otherwise(fade)), keys, size, F.col("__by"))
    return _added(left, right, keys, size)


def windows(chunks: DataFrame, keys: Sequence[str], size: int, width: int, hop: int) -> DataFrame:
    """Each complete window of `width` samples every `hop`: keys, window, rms, peak. A window that spans chunks is summed up from its parts."""
    first = F.col("chunk") * size
    stop = first + F.size("samples")
    low = F.greatest(F.lit(0), F.ceil((first - width + 1) / hop)).cast("long")
    high = F.floor((stop - 1) / hop).cast("long")
    spread = chunks.filter((F.size("samples") > 0) & (high >= low)).select(*keys, "chunk", "samples", F.explode(F.sequence(low, high)).alias("window"))
    begin, end = F.greatest(first, F.col("window") * hop), F.least(stop, F.col("window") * hop + width)
    part = spread.select(*keys, "window", F.slice("samples", (begin - first + 1).cast("int"), (end - begin).cast("int")).alias("p")).filter(F.size("p") > 0)
    sums = part.select(*keys, "window", F.size("p").alias("n"), _total(F.transform("p", lambda x: x * x)).alias("s"), F.array_max(F.transform("p", F.abs)).alias("m"))
    found = sums.groupBy(*keys, "window").agg(F.sum("n").alias("n"), F.sqrt(F.sum("s") / width).alias("rms"), F.max("m").alias("peak"))
    return found.filter(F.col("n") == width).drop("n")


# --- volume over time


TERM = "struct<start:double,end:double,low:double,high:double,shape:string>"


def term(start: Column, end: Column, low: Column, high: Column, shape: str = "line") -> Column:
    """The gain from start to end, both included: from low to high, along a line or along a square root ("rise" slows down, "fall" speeds up)."""
    named = (("start", start), ("end", end), ("low", low), ("high", high), ("shape", F.lit(shape)))
    return F.struct(*[c.alias(n) for n, c in named]).cast(TERM)


def duck_terms(start: Column, end: Column, amount: float, attack: float, release: float) -> Column:
    """Terms of one window of speech: down over the attack, held until it ends, up over the release."""
    one, floor = F.lit(1.0), F.lit(1.0 - amount)
    return F.array(term(start, start + attack, one, floor), term(start + attack, end, floor, floor), term(end, end + release, floor, one))


def volume_terms(start: Column, end: Column, volume: Column, ramp: float) -> Column:
    """Terms of a change of volume from start to end with ramps at both ends, which are half of it at most."""
    edge = F.least(F.lit(ramp), (end - start) / 2)
    flat = F.array(term(start, end, volume, volume))
    ramped = F.array(term(start, start + edge, F.lit(1.0), volume, "rise"), term(start + edge, end - edge, volume, volume), term(end - edge, end, volume, F.lit(1.0), "fall"))
    return F.when(end <= start, F.array().cast(f"array<{TERM}>")).when(edge > 0, ramped).otherwise(flat)


def gain(t: Column, terms: Column) -> Column:
    """The gain at time t: of the first term that t lies in, 1 in none."""

    def of(x: Column) -> Column:
        share = (t - x["start"]) / (x["end"] - x["start"])
        share = F.when(x["end"] <= x["start"], F.lit(0.0)).otherwise(share)
        eased = F.when(x["shape"] == "rise", F.sqrt(share)).when(x["shape"] == "fall", 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - share))).otherwise(share)
        return x["low"] + (x["high"] - x["low"]) * eased

    inside = F.filter(terms, lambda x: (t >= x["start"]) & (t <= x["end"]))
    return F.coalesce(F.get(F.transform(F.slice(inside, 1, 1), of), F.lit(0)), F.lit(1.0))


def enveloped(chunks: DataFrame, terms: DataFrame, keys: Sequence[str], size: int, rate: int) -> DataFrame:
    """Samples times the gain of the terms of their clip. terms: keys, ord and a term; of terms that overlap, the first by ord counts.

    Terms go to the chunks that they touch, so that a chunk meets its own terms only.
    """
    low = F.greatest(F.lit(0), F.floor(F.col("term.start") * rate / size)).cast("long")
    high = F.floor(F.col("term.end") * rate / size).cast("long")
    spread = terms.filter(F.col("term.end") >= F.greatest(F.col("term.start"), F.lit(0.0))).select(*keys, "ord", "term", F.explode(F.sequence(low, high)).alias("chunk"))
    held = spread.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "term")))["term"].alias("__terms"))
    rows = chunks.join(held, [*keys, "chunk"], "left")
    t = lambda i: (F.col("chunk") * size + i) / F.lit(float(rate))
    changed = F.transform("samples", lambda x, i: x * gain(t(i), F.col("__terms")))
    return rows.withColumn("samples", F.when(F.col("__terms").isNotNull(), changed).otherwise(F.col("samples"))).drop("__terms")
