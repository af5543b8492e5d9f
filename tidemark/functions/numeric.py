"""Column functions on numbers: boxes, sizes, easing, tempo, timing, gain envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of speech per second by language, and for any other.
SPEECH_RATE = {
    "en": 14.0, "es": 14.0, "pt": 13.5, "it": 13.5, "fr": 13.0, "de": 12.0, "pl": 12.5, "nl": 12.5, "ru": 12.0, "uk": 12.0, "cs": 12.0, "sk": 12.0,
    "ro": 13.0, "hu": 12.0, "fi": 11.0, "sv": 12.5, "da": 13.0, "nb": 13.0, "no": 13.0, "ja": 8.0, "ko": 9.0, "zh": 7.0, "zh-CN": 7.0, "zh-TW": 7.0,
    "th": 9.0, "vi": 11.0, "ar": 10.0, "he": 10.0, "hi": 11.0, "ta": 10.0, "id": 12.0, "ms": 12.0, "tr": 12.0, "el": 12.0,
}
SPEECH_RATE_DEFAULT = 12.0
SPEECH_SLACK = 1.15


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height); 0 where they don't meet."""
    width = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    height = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    shared = width * height
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def center(box: Column) -> Column:
    return F.struct((box["x"] + box["width"] / 2).alias("x"), (box["y"] + box["height"] / 2).alias("y"))


def area(box: Column) -> Column:
    return box["width"] * box["height"]


def to_even(value: Column) -> Column:
    """The nearest even number, 2 at least."""
    return F.greatest(F.lit(2), (F.rint(value / 2) * 2).cast("int"))


def floor_even(value: Column) -> Column:
    return F.greatest(F.lit(2), (F.floor(value / 2) * 2).cast("int"))


def ease(t: Column, mode: str) -> Column:
    """Quadratic easing of t in [0, 1]."""
    if mode == "in":
        return t * t
    if mode == "out":
        return 1 - (1 - t) * (1 - t)
    if mode == "in_out":
        return F.when(t < 0.5, 2 * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(2)) / 2)
    return t


def curve(t: Column, kind: str) -> Column:
    return F.sqrt(t) if kind == "sqrt" else t * t if kind == "exponential" else t


def tempo_stages(speed: Column) -> Column:
    """A tempo factor as factors between 0.5 and 2; none where it is within 0.001 of 1."""
    up = F.greatest(F.ceil(F.log2(speed)) - 1, F.lit(0)).cast("int")
    down = F.greatest(F.ceil(-F.log2(speed)) - 1, F.lit(0)).cast("int")
    k, step = F.when(speed >= 1, up).otherwise(down), F.when(speed >= 1, F.lit(2.0)).otherwise(F.lit(0.5))
    return F.when(F.abs(speed - 1) < 0.001, F.array().cast("array<double>")).otherwise(F.concat(F.array_repeat(step, k), F.array(speed / F.pow(step, k))))


def target_chars(duration: Column, lang: Column) -> Column:
    """Characters that fit a duration in a language, with slack, 1 at least."""
    rates = F.create_map(*[F.lit(x) for item in SPEECH_RATE.items() for x in item])
    rate = F.coalesce(F.try_element_at(rates, lang), F.lit(SPEECH_RATE_DEFAULT))
    return F.greatest(F.lit(1), (duration * rate * SPEECH_SLACK).cast("long"))


def synchronised(original: Column, target: Column, slowest: float = 0.8, fastest: float = 1.3) -> Column:
    """How a clip of `original` seconds fits `target`: speed_factor within limits, actual_duration, was_truncated."""
    needed = F.when(target > 0, original / target).otherwise(F.lit(1.0))
    factor = F.greatest(F.lit(slowest), F.least(F.lit(fastest), needed))
    speed = F.when(F.abs(factor - 1) > 0.01, factor).otherwise(F.lit(1.0))
    stretched = original / speed
    cut = stretched > target + 0.01
    return F.struct(
        original.alias("original_duration"), target.alias("target_duration"), F.when(cut, target).otherwise(stretched).alias("actual_duration"), speed.alias("speed_factor"), cut.alias("was_truncated")
    )


def expressiveness(level: Column, baseline: Column) -> Column:
    """calm, default or dramatic by the ratio of two levels."""
    ratio = F.when(baseline > 0, level / baseline)
    return F.when(ratio < 0.7, "calm").when(ratio > 1.3, "dramatic").otherwise("default")


def frame_budget(duration: Column, scale: float, base: float, most: int) -> Column:
    """How many frames to look at: grows with the logarithm of the duration."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(scale * F.ln(duration / base + 1)).cast("int")))


def sample_times(start: Column, end: Column, count: Column) -> Column:
    """`count` interior times of a span, the midpoint for one."""
    inside = F.transform(F.sequence(F.lit(1), count), lambda i: F.least(F.greatest(start + (end - start) * i / (count + 1), start + 1e-3), end - 1e-3))
    return F.when(count == 1, F.array((start + end) / 2)).otherwise(inside)


def duck_gain(t: Column, windows: Column, amount: float, attack: float, release: float) -> Column:
    """Gain at time t under ducking windows (array of start, end): down over the attack, held, up over the release.

    The first window that t lies in counts, and in it the first of the three, so an attack
    that is longer than its window runs on past its end.
    """
    floor = 1 - amount
    inside = F.filter(windows, lambda x: (t >= x["start"]) & ((t <= x["start"] + attack) | (t <= x["end"] + release)))
    x = F.try_element_at(inside, F.lit(1))
    down = 1 - amount * (t - x["start"]) / attack if attack else F.lit(floor)
    up = floor + amount * (t - x["end"]) / (release or math.inf)
    gain = F.when(t <= x["start"] + attack, down).when(t <= x["end"], F.lit(floor)).otherwise(up)
    return F.when(x.isNull(), F.lit(1.0)).otherwise(gain)


def class_hue(label: Column) -> Column:
    """The hue of a label: its MD5, as one number, modulo 360."""
    digits = F.split(F.md5(label), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("long")) % 360)
