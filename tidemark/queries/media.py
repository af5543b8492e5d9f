"""Queries of the signal, frame and streaming operators: vectors stand for samples and for small frames."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folds, frames, signal
from ..shared import shared_dir
from ..streaming import stateful
from .base import table

SIDE = 8
TINT = (997, 991, 983)  #: what a number is multiplied by for each colour of its pixel


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to [-1, 1] as clips of samples."""
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("samples"))


_S = """s AS (SELECT vec_id, label, list_transform(embedding, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE))) AS x FROM embeddings)"""


def audio_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _samples(spark, sf_dir).select("vec_id", signal.levels(F.col("samples")).alias("l"))
    return found.select("vec_id", *[F.round(f"l.{c}", 8).alias(c) for c in ("rms", "peak", "db_rms", "db_peak")])


def levels_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.windows(_samples(spark, sf_dir), ["vec_id"], "samples", 16, 8)
    return out.select("vec_id", F.col("window").cast("long").alias("win"), F.round("rms", 8).alias("rms"), F.round("peak", 8).alias("peak"))


def audio_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak of each clip brought to -3 dB, as stereo made mono, and the clip's first half faded into its second over four samples."""
    s = F.col("samples")
    loud = signal.normalised(s, -3.0)
    mono = signal.to_mono(s, 2)
    half = F.floor(F.size(s) / 2).cast("int")
    joined = signal.joined(F.slice(s, F.lit(1), half), F.slice(s, half + 1, F.size(s)), 4)
    return _samples(spark, sf_dir).select("vec_id", F.round(signal.peak(loud), 8).alias("peak"), F.round(signal.rms(mono), 8).alias("mono_rms"), F.round(signal.rms(joined), 8).alias("joined_rms"))


def audio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a label placed a quarter of their length apart and summed per sample."""
    clips = _samples(spark, sf_dir).withColumn("start", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) * 16.0)
    return signal.assembled(clips, ["label"], 1).select("label", F.col("idx").cast("long").alias("idx"), F.round("value", 8).alias("value"))


def audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.classified(signal.features(_samples(spark, sf_dir), "vec_id", "samples", 8000, 32, 16))
    return found.select("vec_id", F.col("window").cast("long").alias("win"), "kind", *[F.round(c, 6).alias(c) for c in (*signal.FEATURES, "confidence")])


def audio_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and peaks of clips that were cut, split, doubled, padded, scaled, overlaid and matched."""
    s, n = F.col("samples"), F.size("samples")
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)
    over = signal.overlaid(s, F.reverse(s), 16)
    return _samples(spark, sf_dir).select(
        "vec_id", total(signal.cut(s, 0.25, 1.5, 32)).alias("cut"), total(signal.channel(s, 2, 0)).alias("left"), F.size(signal.to_stereo(s)).alias("stereo"), total(F.slice(signal.to_stereo(s), F.lit(1), n)).alias("stereo_half"),
        F.size(signal.silence(F.lit(0.5), 16, 2)).alias("silence"), F.size(signal.fitted(s, n + 16)).alias("padded"), total(signal.fitted(s, F.lit(10))).alias("short"), total(signal.scaled(s, F.lit(1.5))).alias("scaled"),
        F.size(over).alias("overlaid"), F.round(signal.peak(over), 6).alias("top"), total(over).alias("mixed"), F.round(signal.peak(signal.peak_matched(F.slice(s, 1, 32), F.slice(s, 33, 32))), 6).alias("matched"), signal.is_silent(s).alias("silent"),
    )


def audio_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.resampled(_samples(spark, sf_dir), "vec_id", "samples", 0.5).select("vec_id", signal.levels(F.col("samples")).alias("l")).select("vec_id", "l.*")


def phash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of a vector's 64 numbers as its code; per label, a code within 4 bits of one kept before goes."""
    code = F.expr("aggregate(transform(embedding, (v, i) -> if(v > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", code.alias("code"))
    return folds.distinct_hashes(rows, ["label"], "vec_id", "code", 4)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 frames, a pixel to a number twenty to a video."""

    def go(batches):
        import numpy as np

        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            raw = [(np.abs(np.resize(np.asarray(e.values, np.float64), (SIDE * SIDE, 1))) * TINT % 256).astype(np.uint8).tobytes() for e in batch.column("embedding")]
            side = pa.array([SIDE] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids // 20), pa.array(ids % 20), side, side, pa.array(raw, pa.binary())], ["video_id", "frame_idx", "width", "height", "pixels"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(go, frames.FRAMES)


EFFECTS = {
    "fade": {"mode": "in_out", "frames": 5}, "flash": {}, "color_adjust": {"brightness": 0.1, "contrast": 1.2, "saturation": 0.8}, "vignette": {}, "blur_effect": {"mode": "ascending"}, "sharpen": {}, "zoom_effect": {},
    "punch_in": {}, "ken_burns": {}, "shake": {"amount": 1}, "chromatic_aberration": {"shift": 1}, "glitch": {"amount": 2}, "film_grain": {}, "pixelate": {"size": 2}, "mirror_flip": {}, "kaleidoscope": {}, "crop": {"x": 1, "y": 1, "width": 6, "height": 6}, "resize": {"width": 12, "height": 4},
}


def frame_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean colours of all frames after each effect."""
    return frames.means_of_each(_frames(spark, sf_dir), EFFECTS, 20, 2, 18)


def frame_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by an index map that repeats the fifth one three times."""
    source = _frames(spark, sf_dir)
    moved = source.select("video_id", "frame_idx").withColumn("src_idx", F.col("frame_idx")).withColumn("frame_idx", F.when(F.col("src_idx") > 5, F.col("src_idx") + 3).otherwise(F.col("src_idx")))
    held = source.filter("frame_idx = 5").select("video_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (6, 7, 8)])).alias("frame_idx")).withColumn("src_idx", F.lit(5).cast("long"))
    return frames.means(frames.remap(source, moved.select("video_id", "frame_idx", "src_idx").unionByName(held)))


def _drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return stateful.drained(stream, f"{folder}/out", f"{folder}/state")


def sess_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user's events: those that the stream closed, and those that are open at its end."""
    closed = _drained(stateful.sessions(stateful.events(spark, f"{sf_dir}/events.parque[t]"), ["user_id"], "1 hour", "1 hour"), spark)
    rest = stateful.unclosed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), closed, ["user_id"])
    every = closed.unionByName(stateful.sessions(rest, ["user_id"], "1 hour", "1 hour"))
    return every.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", "confidence")


def ema_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drained(stateful.smoothed(stateful.events(spark, f"{sf_dir}/events.parque[t]"), "user_id", 0.8), spark)
    return out.select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


def hold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(stateful.held(stateful.events(spark, f"{sf_dir}/events.parque[t]"), "user_id", 3), spark)


QUERIES = {f.__name__: f for f in (audio_levels, levels_windows, audio_normalise, audio_mix, audio_features, audio_edits, audio_resample, phash_dedup, frame_effects, frame_freeze, sess_stream, ema_stream, hold_stream)}

_EV = """n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""

_TOTAL = lambda x: f"round(coalesce(list_sum({x}), 0), 6)"

ORACLE_SQL = {
    "audio_features": f"""WITH {_S}, w AS (SELECT vec_id, i AS win, list_slice(x, i * 16 + 1, i * 16 + 32) AS p FROM s, unnest(range(0, (len(x) - 32) // 16 + 1)) AS u(i) WHERE len(x) >= 32),
        d AS (SELECT vec_id, win, k, list_sum(list_transform(range(0, 32), lambda j: p[j + 1] * cos(2 * pi() * k * j / 32))) AS re, list_sum(list_transform(range(0, 32), lambda j: p[j + 1] * sin(2 * pi() * k * j / 32))) AS im FROM w, unnest(range(0, 17)) AS v(k)),
        m AS (SELECT vec_id, win, k * 250.0::DOUBLE AS hz, sqrt(re * re + im * im) AS mag FROM d),
        f AS (SELECT vec_id, win, exp(avg(ln(mag + 1e-10))) / (avg(mag) + 1e-10) AS flatness, sum(hz * mag) / (sum(mag) + 1e-10) AS centroid, coalesce(sum(mag * mag) FILTER (hz >= 300 AND hz <= 3400), 0) / (sum(mag * mag) + 1e-10) AS speech_ratio FROM m GROUP BY ALL),
        z AS (SELECT f.*, sqrt(list_sum(list_transform(p, lambda v: v * v)) / 32) AS rms, list_sum(list_transform(range(1, 32), lambda j: abs(sign(p[j + 1]) - sign(p[j])))) / 64.0::DOUBLE AS zero_crossings FROM f JOIN w USING (vec_id, win)),
        k AS (SELECT *, CASE WHEN rms < 0.01 THEN 0 WHEN flatness > 0.5 AND zero_crossings > 0.1 THEN 1 WHEN speech_ratio > 0.4 AND zero_crossings > 0.02 AND zero_crossings < 0.15 THEN 2 WHEN flatness < 0.3 AND centroid < 2000 THEN 3 ELSE 4 END AS c FROM z)
        SELECT vec_id, win, ['silence', 'noise', 'speech', 'music', 'speech'][c + 1] AS kind, round(rms, 6) AS rms, round(zero_crossings, 6) AS zero_crossings, round(flatness, 6) AS flatness, round(centroid, 6) AS centroid, round(speech_ratio, 6) AS speech_ratio,
               round([0.95, least(0.7, flatness), least(0.8, speech_ratio), least(0.7, 1 - flatness), 0.4][c + 1], 6) AS confidence FROM k""",
    "audio_edits": f"""WITH {_S}, o AS (SELECT *, list_transform(range(1, len(x) + 17), lambda i: coalesce(x[i], 0) + CASE WHEN i > 16 THEN list_reverse(x)[i - 16] ELSE 0 END) AS b FROM s),
        t AS (SELECT *, greatest(1, list_max(list_transform(b, lambda v: abs(v)))) AS top, list_max(list_transform(x[1:32], lambda v: abs(v))) AS own, list_max(list_transform(x[33:64], lambda v: abs(v))) AS ref FROM o)
        SELECT vec_id, {_TOTAL("x[9:48]")} AS cut, {_TOTAL("list_transform(range(0, (len(x) + 1) // 2), lambda i: x[2 * i + 1])")} AS "left", 2 * len(x) AS stereo,
               round(list_sum(list_transform(range(0, len(x)), lambda i: x[i // 2 + 1])), 6) AS stereo_half, 16 AS silence, len(x) + 16 AS padded, {_TOTAL("x[1:10]")} AS short,
               {_TOTAL("list_transform(x, lambda v: greatest(-1, least(1, v * 1.5)))")} AS scaled, len(x) + 16 AS overlaid, round(list_max(list_transform(b, lambda v: abs(v))) / top, 6) AS top, round(list_sum(b) / top, 6) AS mixed,
               round(CASE WHEN own <= 0 OR ref <= 0 OR abs(ref / own - 1) < 0.001 THEN own ELSE ref END, 6) AS matched, list_max(list_transform(x, lambda v: abs(v))) < 1e-7 AS silent FROM t""",
    "sess_stream": """WITH l AS (SELECT *, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
        SELECT user_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS n, max(value) AS confidence FROM n GROUP BY user_id, k""",
    "audio_levels": f"""WITH {_S}, l AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS r, list_max(list_transform(x, lambda v: abs(v))) AS p FROM s)
        SELECT vec_id, round(r, 8) AS rms, round(p, 8) AS peak, round(20 * log10(greatest(r, 1e-10)), 8) AS db_rms, round(20 * log10(greatest(p, 1e-10)), 8) AS db_peak FROM l""",
    "levels_windows": f"""WITH {_S}, w AS (SELECT vec_id, i AS win, list_slice(x, i * 8 + 1, i * 8 + 16) AS p FROM s, unnest(range(0, (len(x) - 16) // 8 + 1)) AS u(i) WHERE len(x) >= 16)
        SELECT vec_id, win, round(sqrt(list_sum(list_transform(p, lambda v: v * v)) / 16), 8) AS rms, round(list_max(list_transform(p, lambda v: abs(v))), 8) AS peak FROM w""",
    "audio_normalise": f"""WITH {_S}, p AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS p FROM s),
        m AS (SELECT *, list_transform(range(0, len(x) // 2), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / 2) AS mono, list_concat(list_concat(x[1:len(x) // 2 - 4], list_transform(range(0, 4), lambda i: x[len(x) // 2 - 3 + i] * (1 - i / 4.0::DOUBLE) + x[len(x) // 2 + 1 + i] * (i / 4.0::DOUBLE))), x[len(x) // 2 + 5:]) AS j FROM p)
        SELECT vec_id, round(CASE WHEN p < 1e-7 THEN p ELSE list_max(list_transform(x, lambda v: abs(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v * (pow(10, -3.0::DOUBLE / 20) / p)))))) END, 8) AS peak,
          round(sqrt(list_sum(list_transform(mono, lambda v: v * v)) / len(mono)), 8) AS mono_rms, round(sqrt(list_sum(list_transform(j, lambda v: v * v)) / len(j)), 8) AS joined_rms FROM m""",
    "audio_mix": f"""WITH {_S}, c AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 16 AS o, x FROM s)
        SELECT label, o + i - 1 AS idx, round(sum(x[i]), 8) AS value FROM c, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY label, idx""",
    "phash_dedup": """WITH RECURSIVE c AS (SELECT label, vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808 ELSE 1::BIGINT << i END ELSE 0 END))::BIGINT AS code FROM embeddings),
        n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM c),
        r AS (SELECT label, i, [code] AS kept, true AS own, vec_id, code FROM n WHERE i = 1
              UNION ALL SELECT n.label, n.i, CASE WHEN len(list_filter(r.kept, lambda k: bit_count(xor(k, n.code)) <= 4)) > 0 THEN r.kept ELSE list_append(r.kept, n.code) END, len(list_filter(r.kept, lambda k: bit_count(xor(k, n.code)) <= 4)) = 0, n.vec_id, n.code
              FROM r JOIN n ON n.label = r.label AND n.i = r.i + 1)
        SELECT label, vec_id, code FROM r WHERE own""",
    "ema_stream": f"""WITH RECURSIVE {_EV}, r AS (SELECT user_id, event_id, i, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN n.value IS NULL THEN r.y ELSE 0.8::DOUBLE * r.y + 0.2::DOUBLE * n.value END FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
        SELECT user_id, event_id, round(y, 6) AS smoothed FROM r""",
    "hold_stream": f"""WITH {_EV} SELECT user_id, event_id, last_value(CASE WHEN (i - 1) % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS held FROM n""",
}
