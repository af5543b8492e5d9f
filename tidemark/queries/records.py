"""Queries of the rules on records: events stand for words and spans, vectors for frames, parts for media and scenes, orders for plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import records
from .base import BOXES_SQL, boxes, spans, spans_sql, table


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("o_orderkey") % 30 * 86400.0
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.lit(1).alias("seq"), F.col("o_custkey").alias("source"), first.alias("first"), (first + 43200.0).alias("last"))


_PLAN = "plan AS (SELECT o_orderkey AS plan_id, 1 AS seq, o_custkey AS source, o_orderkey % 30 * 86400.0::DOUBLE AS first, o_orderkey % 30 * 86400.0::DOUBLE + 43200 AS last FROM orders)"


def segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spans(spark, sf_dir).select("event_id", F.col("user_id").alias("source"), "start", "end")
    return records.segment_context(words, _plan(spark, sf_dir)).select("plan_id", "event_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def missing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    key = F.element_at(F.array(*map(F.lit, ("click", "view", "signup"))), (F.col("plan_id") % 3 + 1).cast("int"))
    context = spans(spark, sf_dir).select(F.col("user_id").alias("source"), F.col("label").alias("key"))
    return records.missing_context(plan, plan.select("plan_id", "seq", key.alias("key")), context)


def merged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir).groupBy(F.col("user_id").alias("source")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    given = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select((F.col("c_custkey") * 2).alias("source"), F.col("c_acctbal").alias("value"))
    return records.merged_context(found, given, "source", "value")


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("source"))
    metas = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("source"), F.col("p_size").cast("double").alias("total_seconds"))
    return records.resolved_sources(segments, metas)


def scene_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's scene gets the caption of its brand's group."""
    parts = table(spark, sf_dir, "part")
    captions = parts.groupBy("p_brand").agg(F.min("p_name").alias("caption"))
    return parts.select("p_partkey", "p_brand").join(captions, "p_brand")


def requested_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return records.requested(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), "p_name"), wanted, "scene_id")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("video_id"), (F.col("vec_id") % 20).alias("frame_idx"), "vec_id")


_FRAMES = "frames AS (SELECT vec_id // 20 AS video_id, vec_id % 20 AS frame_idx, vec_id FROM embeddings)"


def frames_at_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames at the times that events name, at four frames a second, in the order of the requests."""
    at = (F.coalesce("value", F.lit(0.0)) * 4).cast("long") % 20
    wanted = table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("video_id"), F.col("event_id").alias("pos"), at.alias("frame_idx"))
    return records.frames_at(_frames(spark, sf_dir), wanted, ["video_id"])


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return frames.join(frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("count")), "video_id")


def frame_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _counted(spark, sf_dir)
    out = records.frame_slice(counted, F.col("count"), -15, -3).withColumn("part", F.lit("tail"))
    return out.unionByName(records.frame_slice(counted, F.col("count"), 4, None).withColumn("part", F.lit("rest"))).drop("count")


def frame_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.halves(_counted(spark, sf_dir), F.col("count")).drop("count")


def frames_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd video after the even one before it."""
    frames = _frames(spark, sf_dir).withColumn("pair", F.floor(F.col("video_id") / 2))
    first, second = (frames.filter(F.col("video_id") % 2 == k).drop("video_id") for k in (0, 1))
    counts = first.groupBy("pair").agg(F.count(F.lit(1)).alias("frame_count"))
    return records.appended(first, second, ["pair"], counts)


def confident_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir).withColumns({"confidence": F.round(F.col("height") * 2, 6), "label": F.when(F.col("frame_idx") % 3 == 0, "face").otherwise("dog"), "det": F.col("frame_idx") * 1000 + F.col("det_idx")}).withColumns({"x": F.col("x") * 2 - 0.1, "width": F.col("width") * 2})
    kept = records.confident_objects(found, 0.5, ["face"])
    kept = records.ranked(records.ranked(kept, ["shot"], F.col("confidence"), "det", "by_confidence"), ["shot"], numeric.area(F.struct("width", "height")), "det", "by_area")
    return kept.select("shot", "frame_idx", "det_idx", *[F.round(c, 8).alias(c) for c in ("x", "y", "width", "height")], "by_confidence", "by_area")


def inlined_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.inlined(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey")
    return rows.select("c_nationkey", F.concat_ws(",", F.transform("shown", lambda x: x.cast("string"))).alias("shown"), "rest")


def default_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = spans(spark, sf_dir).filter("label = 'signup'").select(F.col("user_id").alias("video_id"), "start", "end")
    return records.default_scenes(scenes, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_acctbal").alias("total_seconds")), "video_id")


def silence_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside two keep-windows a video, renumbered."""
    frames = _frames(spark, sf_dir)
    video = frames.select("video_id").distinct()
    windows = video.select("video_id", (F.col("video_id") % 3 + 1).alias("first"), F.lit(7).cast("long").alias("stop")).unionByName(video.select("video_id", F.lit(10).cast("long").alias("first"), (F.col("video_id") % 5 + 12).alias("stop")))
    return records.kept_frames(frames.select("video_id", "frame_idx"), windows, ["video_id"])


def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sliding_chunks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip_id"), "p_size"), F.col("p_size"), 10, 5).drop("p_size")


def voiced_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.voiced_prefix(spans(spark, sf_dir), ["user_id"], 16, 4800)


def scene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    scene = F.struct(F.col("p_partkey").cast("string").alias("id"), F.bround(F.col("p_size") / 5, 1).alias("duration"), F.when(even, F.col("p_type")).otherwise("").alias("shot_type"), F.when(~even, F.col("p_brand")).alias("caption"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("transcript"))
    return table(spark, sf_dir, "part").select("p_partkey", records.scene_line(scene).alias("line"))


def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived fields of parts as media: sizes, durations, escapes, comparisons, curves and defaults."""
    n = F.col("p_size")
    media = lambda k: F.struct((n * k).alias("height"), (n + k).alias("width"), (F.lit(24.4) + k / 10).alias("fps"), F.lit(10.0).alias("total_seconds"))
    box = F.struct((n / 100).alias("x"), (n / 200).alias("y"), F.lit(0.5).alias("width"), (n / 50).alias("height"))
    timed = records.inherited_times(F.when(n % 2 == 0, n * 1.0).otherwise(0.0), F.lit(0.0), F.when(n % 3 == 0, "A"), F.struct(F.lit(3.0).alias("start"), F.lit(4.0).alias("end"), F.lit("B").alias("speaker")))
    given = records.given_only({"exaggeration": F.when(n % 2 == 0, n / 10), "cfg_weight": F.when(n % 3 == 0, n / 5), "temperature": F.lit(0.5)})
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.filter_escape(F.concat("p_name", F.lit(":'"))).alias("escaped"), F.round(numeric.center(box)["x"], 8).alias("center_x"), F.round(numeric.center(box)["y"], 8).alias("center_y"), F.round(numeric.area(box), 8).alias("area"),
        numeric.to_even(n / 3).cast("int").alias("even"), numeric.floor_even(n / 3).cast("int").alias("floored"), F.round(numeric.curve(n / 50, "sqrt"), 8).alias("root"), F.round(numeric.curve(n / 50, "exponential"), 8).alias("square"), numeric.expressiveness(n / 10, F.lit(2.5)).alias("style"),
        records.downsamples_to(media(2), media(1)).alias("down"), records.downsamples_to(media(1), media(2)).alias("up"), timed["start"].alias("start"), timed["end"].alias("end"), timed["speaker"].alias("speaker"), F.array_join(F.array_sort(F.map_keys(given)), ",").alias("given"),
    )


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the distinct speakers, segments without one under "unknown", words flattened from segments, and seconds by speaker."""
    ev = spans(spark, sf_dir).withColumn("speaker", F.when(F.col("label") != "click", F.col("label")))
    segments = ev.groupBy("user_id", "speaker").agg(F.collect_list(F.struct("event_id", "confidence")).alias("words"), F.round(F.sum("confidence"), 4).alias("seconds"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("speaker", F.lit("unknown")), F.size("words").cast("string"))))
    timing = F.map_from_entries(F.collect_list(F.struct(F.coalesce("speaker", F.lit("unknown")), F.size("words"))))
    per = segments.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.array_join(listed, ",").alias("by_speaker"), F.flatten(F.collect_list("words")).alias("all"), timing.alias("timing"))
    return per.select("user_id", "speakers", "by_speaker", F.size("all").cast("long").alias("words"), F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["event_id"]).alias("ids"), F.coalesce(F.try_element_at("timing", F.lit("unknown")), F.lit(0)).cast("long").alias("unknown"))


def image_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images shown for a while: their frames, and what a video says of itself."""
    shown = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), "p_size", F.explode(F.sequence(F.lit(1), F.rint(F.col("p_size") / 16 * 24).cast("int"))).alias("i"))
    return shown.groupBy("video_id").agg(F.count(F.lit(1)).alias("frame_count"), F.first("p_size").alias("height")).withColumn("total_seconds", F.round(F.col("frame_count") / 24, 4))


def plan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans in JSON, nulls kept."""
    plan = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("music"), F.col("o_orderpriority").alias("name"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(plan, {"ignoreNullFields": "false"}).alias("plan"))


QUERIES = {
    f.__name__: f
    for f in (segment_context, missing_context, merged_context, resolved_sources, scene_captions, requested_scenes, frames_at_times, frame_slice, frame_halves, frames_appended, confident_objects, inlined_keyframes, default_scenes, silence_removal, sliding_chunks, voiced_prefix, scene_lines, derived_columns, speakers, image_videos, plan_records)
}

ORACLE_SQL = {
    "segment_context": f"""WITH {spans_sql()}, {_PLAN} SELECT plan_id, event_id, round(start - first, 6) AS start, round("end" - first, 6) AS "end" FROM plan JOIN ev ON user_id = source WHERE "end" > first AND start < last""",
    "missing_context": f"""WITH {_PLAN}, n AS (SELECT *, ['click', 'view', 'signup'][plan_id % 3 + 1] AS key FROM plan) SELECT plan_id, seq, key, source FROM n WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = source AND event_type = key)""",
    "merged_context": """WITH f AS (SELECT user_id AS source, count(*)::DOUBLE AS v FROM events GROUP BY user_id), g AS (SELECT c_custkey * 2 AS source, c_acctbal AS w FROM customer WHERE c_acctbal > 0)
        SELECT source, coalesce(w, v) AS value FROM f FULL JOIN g USING (source)""",
    "resolved_sources": """SELECT l_orderkey AS plan_id, l_linenumber AS seq, l_partkey AS source, p_size::DOUBLE AS total_seconds, CASE WHEN p_size IS NULL THEN 'source_unreadable' END AS code
        FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""",
    "scene_captions": "SELECT p_partkey, p_brand, min(p_name) OVER (PARTITION BY p_brand) AS caption FROM part",
    "requested_scenes": "SELECT l_partkey AS scene_id, min(l_orderkey * 10 + l_linenumber) AS pos, any_value(p_name) AS p_name FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey",
    "frames_at_times": f"""WITH {_FRAMES}, w AS (SELECT event_id % 40 AS video_id, event_id AS pos, trunc(coalesce(value, 0) * 4)::BIGINT % 20 AS frame_idx FROM events) SELECT * FROM w JOIN frames USING (video_id, frame_idx)""",
    "frame_slice": f"""WITH {_FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
        SELECT video_id, frame_idx - greatest(0, n - 15) AS frame_idx, vec_id, 'tail' AS part FROM c WHERE frame_idx >= n - 15 AND frame_idx < n - 3 UNION ALL SELECT video_id, frame_idx - 4, vec_id, 'rest' FROM c WHERE frame_idx >= 4""",
    "frame_halves": f"""WITH {_FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY video_id) // 2 AS m FROM frames) SELECT video_id, CASE WHEN frame_idx >= m THEN frame_idx - m ELSE frame_idx END AS frame_idx, vec_id, (frame_idx >= m)::INT AS half FROM c""",
    "frames_appended": f"""WITH {_FRAMES} SELECT video_id // 2 AS pair, row_number() OVER (PARTITION BY video_id // 2 ORDER BY vec_id) - 1 AS frame_idx, vec_id FROM frames""",
    "confident_objects": f"""WITH {BOXES_SQL}, b AS (SELECT shot, frame_idx, det_idx, frame_idx * 1000 + det_idx AS d, round(height * 2, 6) AS c, x * 2 - 0.1 AS x, y, width * 2 AS w, height AS h FROM boxes WHERE frame_idx % 3 = 0),
        k AS (SELECT shot, frame_idx, det_idx, d, c, greatest(0, least(1, x)) AS x, greatest(0, least(1, y)) AS y, least(1, x + w) AS r, least(1, y + h) AS l FROM b WHERE c >= 0.5),
        z AS (SELECT *, greatest(0, r - x) AS width, greatest(0, l - y) AS height FROM k)
        SELECT shot, frame_idx, det_idx, round(x, 8) AS x, round(y, 8) AS y, round(width, 8) AS width, round(height, 8) AS height, row_number() OVER (PARTITION BY shot ORDER BY c DESC, d) AS by_confidence,
               row_number() OVER (PARTITION BY shot ORDER BY width * height DESC, d) AS by_area FROM z""",
    "inlined_keyframes": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
        SELECT c_nationkey, coalesce(string_agg(CASE WHEN i <= 12 THEN c_custkey::VARCHAR END, ',' ORDER BY i), '') AS shown, count(*) FILTER (i > 12) AS rest FROM n GROUP BY c_nationkey""",
    "default_scenes": f"""WITH {spans_sql()}, s AS (SELECT user_id AS video_id, start, "end" FROM ev WHERE label = 'signup')
        SELECT * FROM s UNION ALL SELECT c_custkey, 0, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT video_id FROM s)""",
    "silence_removal": f"""WITH {_FRAMES}, k AS (SELECT * FROM frames WHERE (frame_idx >= video_id % 3 + 1 AND frame_idx < 7) OR (frame_idx >= 10 AND frame_idx < video_id % 5 + 12))
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS frame_idx, frame_idx AS src_idx FROM k""",
    "sliding_chunks": """SELECT p_partkey AS clip_id, s AS start, least(10, p_size - s) AS n, CASE WHEN p_size <= 10 THEN 0 ELSE 10 - least(10, p_size - s) END AS padded
        FROM part, unnest(CASE WHEN p_size <= 10 THEN [0] ELSE range(0, p_size, 5) END) AS u(s)""",
    "voiced_prefix": f"""WITH {spans_sql()}, s AS (SELECT user_id, start, "end", trunc(start * 16)::BIGINT AS first, trunc("end" * 16)::BIGINT - trunc(start * 16)::BIGINT AS size FROM ev),
        l AS (SELECT *, 4800 - coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s)
        SELECT user_id, first, least(size, rest)::BIGINT AS n FROM l WHERE least(size, rest) > 0""",
    "scene_lines": """SELECT p_partkey, '[' || p_partkey || '] ' || printf('%.1f', p_size / 5.0) || 's' || CASE WHEN p_size % 2 = 0 THEN ' | ' || p_type ELSE ' | ' || p_brand END || CASE WHEN p_size % 3 = 0 THEN chr(10) || '  speech: ' || p_name ELSE '' END AS line FROM part""",
    "derived_columns": """SELECT p_partkey, '''' || regexp_replace(p_name || ':''', '([\\\\'':])', '\\\\\\1', 'g') || '''' AS escaped, round(p_size / 100 + 0.25, 8) AS center_x, round(p_size / 200 + p_size / 100, 8) AS center_y, round(0.5 * p_size / 50, 8) AS area,
        greatest(2, (round_even(p_size / 3 / 2, 0) * 2)::INT) AS even, greatest(2, (floor(p_size / 3 / 2) * 2)::INT) AS floored, round(sqrt(p_size / 50), 8) AS root, round((p_size / 50) * (p_size / 50), 8) AS square,
        CASE WHEN p_size / 10 / 2.5 < 0.7 THEN 'calm' WHEN p_size / 10 / 2.5 > 1.3 THEN 'dramatic' ELSE 'default' END AS style, round_even(24.6, 0) >= round_even(24.5, 0) AS down, false AS up,
        CASE WHEN p_size % 2 = 0 AND p_size <> 0 THEN p_size ELSE 3 END::DOUBLE AS start, CASE WHEN p_size % 2 = 0 AND p_size <> 0 THEN 0 ELSE 4 END::DOUBLE AS "end", CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END AS speaker,
        concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'cfg_weight' END, CASE WHEN p_size % 2 = 0 THEN 'exaggeration' END, 'temperature') AS given FROM (SELECT p_partkey, p_name, p_size::DOUBLE AS p_size FROM part)""",
    "speakers": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'click' THEN event_type END AS speaker FROM events), g AS (SELECT user_id, coalesce(speaker, 'unknown') AS s, count(*) AS n, sum(event_id) AS i FROM e GROUP BY ALL)
        SELECT user_id, coalesce(string_agg(CASE WHEN s <> 'unknown' THEN s END, ',' ORDER BY s), '') AS speakers, string_agg(s || ':' || n, ',' ORDER BY s || ':' || n) AS by_speaker, sum(n)::BIGINT AS words, sum(i)::BIGINT AS ids,
               coalesce(max(CASE WHEN s = 'unknown' THEN n END), 0) AS unknown FROM g GROUP BY user_id""",
    "image_videos": """WITH n AS (SELECT p_partkey AS video_id, round_even(p_size / 16.0::DOUBLE * 24, 0)::BIGINT AS frame_count, p_size AS height FROM part) SELECT *, round(frame_count / 24.0::DOUBLE, 4) AS total_seconds FROM n""",
    "plan_records": """SELECT o_orderkey, to_json({'id': o_orderkey, 'music': CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'name': o_orderpriority})::VARCHAR AS plan FROM orders""",
}
