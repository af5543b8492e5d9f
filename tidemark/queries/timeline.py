"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, intervals
from .base import BOXES_SQL, TOTAL, boxes, spans, spans_sql


def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_events(spans(spark, sf_dir), ["label"], gap=60.0, order="event_id")


def speech_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speech_windows(spans(spark, sf_dir), ["user_id"], 600.0, F.lit(TOTAL), ["start", "event_id"])


def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.complement(speech_windows(spark, sf_dir), ["user_id"], F.lit(TOTAL), 86400.0)


def keep_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.frame_ranges(silence_gaps(spark, sf_dir), 24.0)


def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_regions(spans(spark, sf_dir, 100.0), ["user_id"], F.lit(TOTAL), 300.0, 1800.0)


def transcript_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sliced(spans(spark, sf_dir, 100.0), 10 * 86400.0, 12 * 86400.0)


def overlap_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's strongest overlap with the events of its user, its own wider span among them."""
    targets, sources = spans(spark, sf_dir, 100.0), spans(spark, sf_dir, 1000.0)
    found = intervals.attach_by_overlap(targets.drop("confidence"), sources, ["user_id"], "event_id", "event_id", ["confidence"], 86400.0)
    return found.select("event_id", "user_id", "start", "end", "confidence")


def speaker_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spans(spark, sf_dir, 100.0).drop("label", "confidence")
    turns = spans(spark, sf_dir, 1000.0).withColumns({"start": F.col("start") + 3600.0, "end": F.col("end") + 3600.0}).withColumn("label", F.concat(F.lit("speaker_"), (F.col("event_id") % 7).cast("string"))).drop("confidence")
    return intervals.assign_speakers(words, turns, ["user_id"], "event_id", "event_id", 86400.0).select("event_id", "user_id", "speaker")


def word_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of 8 hours per user, whose words are that user's events."""
    ev = spans(spark, sf_dir, 100.0).withColumn("cue", F.floor(F.col("start") / 28800))
    words = ev.withColumns({"cue_start": F.col("cue") * 28800.0, "cue_end": (F.col("cue") + 1) * 28800.0, "ord": F.struct("start", "event_id")})
    return intervals.tiles(words, ["user_id", "cue"], "ord")


def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as level windows."""
    day = F.floor(F.col("start") / 86400)
    levels = spans(spark, sf_dir).groupBy("user_id", day.alias("day")).agg(F.round(F.avg("confidence"), 6).alias("level"))
    levels = levels.select("user_id", (F.col("day") * 86400.0).alias("start"), ((F.col("day") + 1) * 86400.0).alias("end"), "level")
    return intervals.silent_runs(levels, ["user_id"], 50.0, 2 * 86400.0).withColumn("level", F.round("level", 10))


def hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.hold_last(spans(spark, sf_dir), ["user_id"], ["start", "event_id"], "confidence", 3).select("event_id", "user_id", "held")


def scene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.budget_groups(spans(spark, sf_dir), ["user_id"], ["start", "event_id"], "confidence", 200.0).select("user_id", "event_id", F.col("group").cast("long").alias("grp"))


def merge_short_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps between a user's events as scenes."""
    return folds.merge_short(silence_scenes(spark, sf_dir), ["user_id"], 43200.0).select("user_id", F.col("scene").cast("long").alias("scene"), "start", "end")


def silence_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    return spans(spark, sf_dir).withColumn("next", F.lead("start").over(w)).filter("next > start").select("user_id", "start", F.col("next").alias("end"))


def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.smoothed(spans(spark, sf_dir), ["user_id"], ["start", "event_id"], "confidence", 0.8)
    return out.select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


def track_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.tracks(boxes(spark, sf_dir), ["shot"])


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events and wider events that overlap: how many and how long."""
    left, right = spans(spark, sf_dir, 100.0), spans(spark, sf_dir, 1000.0)
    pairs = intervals.overlaps(left, right, ["user_id"], 86400.0)
    return pairs.groupBy(F.col("l.user_id").alias("user_id")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("overlap"), 3).alias("seconds"))


QUERIES = {f.__name__: f for f in (event_merge, speech_windows, silence_gaps, keep_frames, merge_regions, transcript_slice, overlap_attach, speaker_assign, word_tiles, silence_runs, hold_last, scene_groups, merge_short_scenes, ema_smooth, track_association, overlap_pairs)}

_WINDOWS = f"""{spans_sql()}, p AS (SELECT user_id, event_id, start AS s0, greatest(0, start - 600) AS start, least({TOTAL}, "end" + 600) AS "end" FROM ev),
        q AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p WHERE "end" > start),
        r AS (SELECT *, sum(CASE WHEN pe IS NULL OR start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, event_id) AS g FROM q),
        windows AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM r GROUP BY user_id, g)"""
_GAPS = f"""{_WINDOWS}, gaps AS (
        SELECT user_id, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY start), 0) AS start, start AS "end" FROM windows
        UNION ALL SELECT user_id, max("end"), {TOTAL} FROM windows GROUP BY user_id),
        silence AS (SELECT * FROM gaps WHERE "end" > start AND "end" - start >= 86400)"""

ORACLE_SQL = {
    "event_merge": f"""
        WITH {spans_sql()}, a AS (SELECT *, lag("end") OVER w AS pe FROM ev WINDOW w AS (PARTITION BY label ORDER BY start, event_id)),
        b AS (SELECT *, sum(CASE WHEN pe IS NULL OR start - pe > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY start, event_id) AS g FROM a)
        SELECT label, min(start) AS start, arg_max("end", row(start, event_id)) AS "end", max(confidence) AS confidence, count(*) AS n
        FROM b GROUP BY label, g""",
    "speech_windows": f"WITH {_WINDOWS} SELECT * FROM windows",
    "silence_gaps": f"WITH {_GAPS} SELECT * FROM silence",
    "keep_frames": f"""WITH {_GAPS} SELECT user_id, round_even(start * 24, 0)::BIGINT AS first, round_even("end" * 24, 0)::BIGINT AS stop FROM silence
        WHERE round_even("end" * 24, 0) > round_even(start * 24, 0)""",
    "merge_regions": f"""
        WITH {spans_sql(100.0)}, p AS (SELECT user_id, greatest(0, start - 300) AS start, least({TOTAL}, "end" + 300) AS "end" FROM ev WHERE "end" > start AND "end" > 0 AND start < {TOTAL}),
        q AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p),
        r AS (SELECT *, sum(CASE WHEN pe IS NULL OR start > pe + 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM q)
        SELECT user_id, min(start) AS start, max("end") AS "end" FROM r GROUP BY user_id, g""",
    "transcript_slice": f"""WITH {spans_sql(100.0)} SELECT event_id, user_id, label, start - 864000.0 AS start, confidence, "end" - 864000.0 AS "end" FROM ev WHERE "end" > 864000 AND start < 1036800""",
    "overlap_attach": f"""
        WITH {spans_sql(100.0, "t")}, {spans_sql(1000.0, "s")},
        m AS (SELECT t.event_id, arg_max(s.confidence, row(least(t."end", s."end") - greatest(t.start, s.start), -s.event_id)) AS confidence
              FROM t JOIN s ON t.user_id = s.user_id AND least(t."end", s."end") > greatest(t.start, s.start) GROUP BY t.event_id)
        SELECT t.event_id, t.user_id, t.start, t."end", m.confidence FROM t LEFT JOIN m USING (event_id)""",
    "speaker_assign": f"""
        WITH {spans_sql(100.0, "a")}, {spans_sql(1000.0, "b")}, words AS (SELECT * FROM a),
        turns AS (SELECT event_id, user_id, start + 3600 AS start, "end" + 3600 AS "end", 'speaker_' || (event_id % 7) AS speaker FROM b),
        o AS (SELECT w.event_id, arg_max(t.speaker, row(least(w."end", t."end") - greatest(w.start, t.start), -t.event_id)) AS speaker
              FROM words w JOIN turns t ON w.user_id = t.user_id AND least(w."end", t."end") > greatest(w.start, t.start) GROUP BY w.event_id),
        n AS (SELECT w.event_id, arg_min(t.speaker, row(abs((w.start + w."end") / 2 - (t.start + t."end") / 2), t.event_id)) AS speaker
              FROM words w JOIN turns t ON w.user_id = t.user_id WHERE w.event_id NOT IN (SELECT event_id FROM o) GROUP BY w.event_id)
        SELECT w.event_id, w.user_id, coalesce(o.speaker, n.speaker) AS speaker FROM words w LEFT JOIN o USING (event_id) LEFT JOIN n USING (event_id)""",
    "word_tiles": f"""
        WITH {spans_sql(100.0)}, w AS (SELECT user_id, floor(start / 28800)::BIGINT AS cue, start AS s0, event_id,
                 (floor(start / 28800) * 2880000)::BIGINT AS c0, ((floor(start / 28800) + 1) * 2880000)::BIGINT AS c1, round_even(start * 100, 0)::BIGINT AS s, round_even("end" * 100, 0)::BIGINT AS e FROM ev),
        x AS (SELECT user_id, cue, s0, event_id, c0, c1, least(greatest(s, c0), c1) AS s, least(greatest(e, c0), c1) AS e, row_number() OVER (PARTITION BY user_id, cue ORDER BY s0, event_id) - 1 AS i FROM w),
        y AS (SELECT *, greatest(coalesce(max(e) OVER (PARTITION BY user_id, cue ORDER BY s0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c0), c0) AS cur,
                     row_number() OVER (PARTITION BY user_id, cue ORDER BY s0 DESC, event_id DESC) = 1 AS last FROM x),
        z AS (SELECT *, greatest(s, cur) AS s1, greatest(e, greatest(s, cur)) AS e1 FROM y),
        parts AS (SELECT user_id, cue, cur AS start_cs, s1 AS end_cs, NULL::INT AS highlight FROM z UNION ALL SELECT user_id, cue, s1, e1, i::INT FROM z
                  UNION ALL SELECT user_id, cue, greatest(cur, e1), c1, NULL FROM z WHERE last)
        SELECT * FROM parts WHERE end_cs > start_cs""",
    "silence_runs": f"""
        WITH {spans_sql()}, l AS (SELECT user_id, floor(start / 86400) AS day, round(avg(confidence), 6) AS level FROM ev GROUP BY ALL),
        m AS (SELECT user_id, day * 86400.0 AS start, (day + 1) * 86400.0 AS "end", level, level < 50 AS quiet, lead(day * 86400.0) OVER (PARTITION BY user_id ORDER BY day) AS nx FROM l),
        r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> quiet THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start) AS g FROM (SELECT *, lag(quiet) OVER (PARTITION BY user_id ORDER BY start) AS p FROM m)),
        o AS (SELECT user_id, min(start)::DOUBLE AS start, max(coalesce(nx, "end"))::DOUBLE AS "end", round(avg(level), 10) AS level FROM r WHERE quiet GROUP BY user_id, g)
        SELECT * FROM o WHERE "end" - start >= 172800""",
    "hold_last": f"""
        WITH {spans_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) - 1 AS i FROM ev)
        SELECT event_id, user_id, last_value(CASE WHEN i % 3 = 0 THEN confidence END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS held FROM n""",
    "scene_groups": f"""
        WITH RECURSIVE {spans_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS i FROM ev),
        r AS (SELECT user_id, event_id, i, confidence AS t, 0 AS grp FROM n WHERE i = 1
              UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN r.t + n.confidence <= 200 THEN r.t + n.confidence ELSE n.confidence END, CASE WHEN r.t + n.confidence <= 200 THEN r.grp ELSE r.grp + 1 END
              FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
        SELECT user_id, event_id, grp::BIGINT AS grp FROM r""",
    "ema_smooth": f"""
        WITH RECURSIVE {spans_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS i FROM ev),
        r AS (SELECT user_id, event_id, i, confidence AS y FROM n WHERE i = 1
              UNION ALL SELECT n.user_id, n.event_id, n.i, 0.8::DOUBLE * r.y + 0.2::DOUBLE * n.confidence FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
        SELECT user_id, event_id, round(y, 6) AS smoothed FROM r""",
    "overlap_pairs": f"""
        WITH {spans_sql(100.0, "t")}, {spans_sql(1000.0, "s")}
        SELECT t.user_id, count(*) AS pairs, round(sum(least(t."end", s."end") - greatest(t.start, s.start)), 3) AS seconds
        FROM t JOIN s ON t.user_id = s.user_id AND least(t."end", s."end") > greatest(t.start, s.start) GROUP BY t.user_id""",
}
