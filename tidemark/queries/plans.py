"""Queries of the plan algebra, summaries and catalog lookups: orders stand for plans, their lines for segments, parts for sources."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import summaries
from ..plans import planning
from .base import BOXES_SQL, boxes, spans, spans_sql, table


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as segments: start and end from discount and quantity, sources of p_size seconds."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("total_seconds"))
    start = F.col("l_discount") * 100 - 1
    # line numbers repeat within an order, so segments are numbered by the whole row
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = planning.dealt_by_rows(lines, "l_orderkey").withColumn("seq", n)
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("plan_id"), "seq", start.alias("start"), (start + F.col("l_quantity") - 2).alias("end"), "total_seconds",
        (F.col("l_tax") * 100 - 1).alias("window_start"), (F.col("l_tax") * 500).alias("window_stop"),
        (F.lit(24.0) + F.floor(F.col("l_tax") * 25)).alias("fps"), (F.lit(320) * (1 + F.col("l_suppkey") % 3)).cast("int").alias("width"), (F.lit(180) * (1 + F.col("l_suppkey") % 3)).cast("int").alias("height"),
        F.col("l_quantity").cast("long").alias("frames"), F.when(F.col("seq") % 2 == 0, F.col("l_discount") * 10).alias("transition"), F.rint(F.col("l_discount") * 24).cast("long").alias("overlap"),
    )


_SEG = """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
        seg AS (SELECT l_orderkey AS plan_id, seq, l_discount * 100 - 1 AS start, l_discount * 100 - 1 + l_quantity - 2 AS "end", p_size::DOUBLE AS total_seconds,
        l_tax * 100 - 1 AS window_start, l_tax * 500 AS window_stop, 24 + floor(l_tax * 25) AS fps, (320 * (1 + l_suppkey % 3))::INT AS width, (180 * (1 + l_suppkey % 3))::INT AS height,
        l_quantity::BIGINT AS frames, CASE WHEN seq % 2 = 0 THEN l_discount * 10 END AS transition, round_even(l_discount * 24, 0)::BIGINT AS overlap FROM numbered JOIN part ON p_partkey = l_partkey)"""


def bounds_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.bounds_errors(_segments(spark, sf_dir))


def repair_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.repaired(_segments(spark, sf_dir), clamp_end=True)[0].select("plan_id", "seq", "start", "end", "window_start", "window_stop")


def repair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = planning.repaired(_segments(spark, sf_dir))[1]
    return log.groupBy("field", "code").agg(F.count(F.lit(1)).alias("changes"), F.round(F.sum(F.col("new") - F.col("old")), 4).alias("moved"))


def concat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.concat_errors(_segments(spark, sf_dir))


def transition_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.transition_errors(_segments(spark, sf_dir), F.lit(24.0))


def normalize_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.normalised_sizes(_segments(spark, sf_dir)).select("plan_id", "seq", "width", "height", "resize")


def conform_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.conform_target(_segments(spark, sf_dir), ["plan_id"])


def assembled_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.assembled(_segments(spark, sf_dir), ["plan_id"], "seq", F.lit(24.0))


def plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of every plan, in order, as it is told to whoever repairs the plan."""
    found = planning.checked(_segments(spark, sf_dir), F.lit(24.0))
    none, two = F.lit(None).cast("string"), lambda c: F.round(c, 2)
    line = planning.prompt_line(F.col("code"), F.col("location"), none, F.col("field"), two("value"), two("limit"), F.when(F.col("ord") == 1, "first"))
    return found.withColumn("line", line)


TRAITS = {"click": ("effect", "streams"), "view": ("streams",), "signup": ("streams", "duration"), "error": ("effect", "filter", "requires", "streams"), "purchase": ("effect", "filter", "passthrough", "streams")}


def streamability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day in order as operations."""
    ev = spans(spark, sf_dir).withColumns({"op": F.col("label"), "day": F.floor(F.col("start") / 86400), "pos": F.struct("start", "event_id")})
    return planning.streamability(ev, ["user_id", "day"], "pos", TRAITS).select("pos.event_id", "op", "kind")


def predict_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as media, cut, slowed down and brought to 24 frames a second."""
    meta = _media(spark, sf_dir)
    for op, args in (("cut", {"start": 0.5, "end": 1.0}), ("speed_change", {"speed": 0.5}), ("resample_fps", {"fps": 24.0}), ("resize", {"width": 320})):
        meta = planning.predicted(meta, op, **args)
    return meta


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = (F.lit(12) + F.col("p_size") % 3 * 6).cast("double")
    count = (F.col("p_size") * 30).cast("long")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("video_id"), fps.alias("fps"), (F.col("p_size") % 7 * 50 + 302).cast("int").alias("width"), (F.col("p_size") % 5 * 50 + 540).cast("int").alias("height"), count.alias("frame_count"), F.round(count / fps, 4).alias("total_seconds")
    )


def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index maps of all parts for a freeze, a resampling and a speed change, summed up per video."""
    meta = _media(spark, sf_dir)
    sums = {"frames": F.count(F.lit(1)), "src_sum": F.sum("src_idx"), "src_max": F.max("src_idx")}
    jobs = (("freeze_frame", {"timestamp": 0.5, "duration": 1.0}), ("resample_fps", {"fps": 10.0}), ("speed_change", {"speed": 2.0}))
    return _summed(meta, "op", [(op, op, args) for op, args in jobs], sums)


def _summed(meta: DataFrame, name: str, jobs: list[tuple[str, str, dict]], sums: dict[str, Column]) -> DataFrame:
    """The sums of each job's index map per video: each map is summed up before the next one's rows follow."""
    each = [planning.index_map(meta, op, **args).groupBy("video_id").agg(*[v.alias(c) for c, v in sums.items()]).select(F.lit(job).alias(name), "video_id", *sums) for job, op, args in jobs]
    return functools.reduce(DataFrame.unionByName, each)


def frame_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index maps of ramps up and down, of an odd speed, and of a freeze that replaces frames, summed up per video."""
    meta = _media(spark, sf_dir)
    jobs = [("up", "speed_change", {"speed": 0.5, "end_speed": 2.0}), ("down", "speed_change", {"speed": 3.0, "end_speed": 1.5}), ("odd", "speed_change", {"speed": 1.7}),
            ("slow", "speed_change", {"speed": 0.4}), ("replace", "freeze_frame", {"timestamp": 0.8, "duration": 1.5, "position": "replace"})]
    sums = {"frames": F.count(F.lit(1)), "src_sum": F.sum("src_idx"), "weighted": F.sum(F.col("src_idx") * F.col("frame_idx")), "src_max": F.max("src_idx")}
    return _summed(meta, "job", jobs, sums)


def timeline_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the frames of each run of each plan's timeline show, summed up, with fades of up to half of the shorter segment."""
    w = Window.partitionBy("plan_id").orderBy("seq")
    seg = _segments(spark, sf_dir).select("plan_id", "seq", "frames", "overlap").withColumn("most", F.floor(F.least("frames", F.lag("frames").over(w)) / 2))
    shown = planning.timeline_map(seg.withColumn("overlap", F.least("overlap", "most")), ["plan_id"], "seq")
    sums = {"frames": F.count(F.lit(1)), "last": F.max("frame_idx"), "faded": F.count("seq_b"), "weight": F.round(F.sum("weight"), 6)}
    sums |= {c: F.sum(F.col(c) * (F.col("frame_idx") + 1)) for c in ("seq_a", "idx_a", "seq_b", "idx_b")}
    return shown.groupBy("plan_id", "group").agg(*[v.alias(c) for c, v in sums.items()])


def resolve_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = summaries.resolve(*_catalog(spark, sf_dir), "scene_id")
    return found


def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.resolve(*_catalog(spark, sf_dir), "scene_id")[1]


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines that name a scene by their order's number, of which the parts' catalog has the low ones only."""
    plan = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("seq"), F.col("l_orderkey").alias("scene_id"))
    catalog = table(spark, sf_dir, "part").select((F.col("p_partkey")).alias("scene_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("caption"), F.col("p_size").alias("duration"))
    return plan, catalog


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sync = numeric.synchronised(F.col("l_quantity"), F.col("l_quantity") * (1 - F.col("l_discount") * 4))
    out = summaries.timing_summary(lines.select("l_returnflag", sync.alias("s")).select("l_returnflag", "s.*"), ["l_returnflag"])
    return out.withColumns({"mean_speed_factor": F.round("mean_speed_factor", 8), "max_truncation": F.round("max_truncation", 8)})


def tempo_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = F.col("l_quantity") / 10.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.tempo_stages(speed).alias("s")).select("l_orderkey", "l_linenumber", F.size("s").alias("stages"), F.round(F.coalesce(F.try_element_at("s", F.lit(-1)), F.lit(1.0)), 8).alias("last"))


def clip_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("start") / 86400)
    rows = spans(spark, sf_dir).select(day.alias("day"), "label", (F.col("confidence") / 100).alias("prob"))
    return summaries.clip_predictions(rows, ["day"], 3, 0.3).select("day", "label", F.round("prob", 6).alias("prob"), F.col("rank").cast("long").alias("rank"))


def voice_sample_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).select("user_id", "event_id", "start", "end", (F.col("confidence") / 200).alias("rms"), (F.col("event_id") % 5 / 20.0).alias("background_rms"), (F.col("confidence") / 100).alias("peak"))
    return summaries.voice_samples(rows, ["user_id"], "event_id").withColumn("score", F.round("score", 8))


def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("n_chars") / 100.0
    out = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"), *[numeric.frame_budget(d, s, b, m).alias(n) for n, s, b, m in (("low", 2.0, 8.0, 8), ("medium", 3.0, 5.0, 30), ("high", 4.0, 3.0, 60))])
    times = numeric.sample_times(F.lit(0.0), F.col("d"), F.col("low"))
    return out.select("doc_id", "low", "medium", "high", F.round(F.element_at(times, 1), 6).alias("first"), F.round(F.element_at(times, -1), 6).alias("last"))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box against the box of the same number in the next frame."""
    a = boxes(spark, sf_dir).select("frame_idx", "det_idx", F.struct("x", "y", "width", "height").alias("a"))
    b = boxes(spark, sf_dir).select((F.col("frame_idx") - 1).alias("frame_idx"), "det_idx", F.struct("x", "y", "width", "height").alias("b"))
    return a.join(b, ["frame_idx", "det_idx"]).select("frame_idx", "det_idx", F.round(numeric.iou(F.col("a"), F.col("b")), 8).alias("iou"))


def select_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot's largest and most central box, numbered through its frames."""
    faces = boxes(spark, sf_dir).withColumn("det_idx", F.col("frame_idx") * 1000 + F.col("det_idx"))
    big, mid = (summaries.select_face(faces, ["shot"], s).select("shot", F.col("det_idx").alias(s)) for s in ("largest", "centered"))
    return big.join(mid, "shot")


def duck_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain at each event's time within its hour, under two windows."""
    t = F.col("start") - F.floor(F.col("start") / 10) * 10
    windows = F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end")), F.struct(F.lit(5.0).alias("start"), F.lit(7.5).alias("end")))
    return spans(spark, sf_dir).select("event_id", F.round(numeric.duck_gain(t, windows, 0.8, 0.2, 0.5), 8).alias("gain"), F.round(numeric.ease(t / 10, "in_out"), 8).alias("eased"))


QUERIES = {
    f.__name__: f
    for f in (bounds_errors, repair_clamp, repair_log, concat_errors, transition_errors, plan_errors, normalize_dimensions, conform_min, assembled_timeline, streamability, predict_cut, frame_index, frame_ramp, timeline_frames, resolve_plan, unknown_ids, timing_summary, tempo_stages, clip_predictions, voice_sample_top1, frame_budget, iou_pairs, select_face, duck_gain)
}

_ERR = lambda test, code, field, value="NULL::DOUBLE", limit="NULL::DOUBLE", place="": f"""CASE WHEN {test} THEN {{'code': '{code}', 'location': 'segments[' || (seq - 1) || ']{place}', 'field': '{field}', 'value': ({value})::DOUBLE, 'limit': ({limit})::DOUBLE}} END"""
_OWN = ", ".join([
    _ERR("start < 0", "segment_negative", "start", "start", "0"), _ERR('"end" < 0', "segment_negative", "end", '"end"', "0"),
    _ERR('"end" <= start', "segment_range", "end", '"end"', "start"), _ERR('"end" > total_seconds + 0.001', "segment_end_exceeds_source", "end", '"end"', "total_seconds"),
])
_OK = 'start >= 0 AND "end" >= 0 AND "end" > start AND "end" <= total_seconds + 0.001'
_WINDOW = ", ".join([
    _ERR(f"{_OK} AND {test}", code, field, value, limit, ".operations[0]") for test, code, field, value, limit in (
        ("window_start < 0", "window_negative", "window.start", "window_start", "0"), ("window_stop < 0", "window_negative", "window.stop", "window_stop", "0"), ("window_stop < window_start", "window_order", "window.stop", "window_stop", "window_start"),
        ('window_start > "end" - start + 0.001', "effect_window_exceeds_duration", "window.start", "window_start", '"end" - start'), ('window_stop > "end" - start + 0.001', "effect_window_exceeds_duration", "window.stop", "window_stop", '"end" - start'))
])
_FIRSTS = f"""{_SEG}, f AS (SELECT *, first_value(fps) OVER w AS f0, first_value(width) OVER w AS w0, first_value(height) OVER w AS h0, lag(frames) OVER w AS before, row_number() OVER w AS i FROM seg WINDOW w AS (PARTITION BY plan_id ORDER BY seq))"""
_CONCAT = ", ".join([_ERR("fps <> f0", "concat_mismatch", "fps", "fps", "f0"), _ERR("(width, height) <> (w0, h0)", "concat_mismatch", "dimensions")])
_FIRST = _ERR("transition IS NOT NULL AND i = 1", "transition_too_long", "transition_in")
_LONG = _ERR("transition IS NOT NULL AND i > 1 AND round_even(transition * 24, 0) >= least(frames, before)", "transition_too_long", "transition_in.duration", "transition", "round(least(frames, before) / 24.0::DOUBLE, 4)")
_NUM = lambda c: f"""CASE WHEN round({c}, 2) = floor(round({c}, 2)) THEN round({c}, 2)::BIGINT::VARCHAR ELSE round({c}, 2)::VARCHAR END"""
_E = """e.code AS code, e.location AS location, e.field AS field, e.value AS value, e."limit" AS "limit\""""
_PICK = lambda rules, source: f"""SELECT plan_id, seq, {_E} FROM (SELECT plan_id, seq, unnest([{rules}]) AS e FROM {source}) WHERE e IS NOT NULL"""
_STAGE = lambda k, rules: f"SELECT plan_id, seq, {k} AS stage, generate_subscripts([{rules}], 1) AS rule, unnest([{rules}]) AS e FROM f"
_FIX = lambda clamp: f"""{_SEG}, a AS (SELECT *, greatest(start, 0) AS s, CASE WHEN {clamp} AND "end" > total_seconds + 0.001 THEN total_seconds ELSE "end" END AS e FROM seg),
        k AS (SELECT *, e > s AND e <= total_seconds + 0.001 AS known FROM a),
        fix AS (SELECT *, CASE WHEN known AND window_start < 0 THEN 0 WHEN known AND window_start > e - s + 0.001 THEN e - s ELSE window_start END AS ws,
                CASE WHEN known AND window_stop < 0 THEN 0 WHEN known AND window_stop > e - s + 0.001 THEN e - s ELSE window_stop END AS wt FROM k)"""  # noqa: E731
_WCODE = lambda c: f"CASE WHEN {c} < 0 THEN 'window_negative' ELSE 'effect_window_exceeds_duration' END"
_MEDIA = """media AS (SELECT p_partkey AS video_id, (12 + p_size % 3 * 6)::DOUBLE AS fps, p_size % 7 * 50 + 302 AS width, p_size % 5 * 50 + 540 AS height, p_size * 30 AS frame_count FROM part)"""

ORACLE_SQL = {
    "bounds_errors": f"""WITH {_SEG} {_PICK(_OWN + ", " + _WINDOW, "seg")}""",
    "repair_clamp": f"""WITH {_FIX("true")} SELECT plan_id, seq, s AS start, e AS "end", ws AS window_start, wt AS window_stop FROM fix""",
    "repair_log": f"""WITH {_FIX("false")}, x AS (SELECT 'start' AS field, 'segment_negative' AS code, start AS o, s AS n FROM fix
          UNION ALL SELECT 'window.start', {_WCODE("window_start")}, window_start, ws FROM fix UNION ALL SELECT 'window.stop', {_WCODE("window_stop")}, window_stop, wt FROM fix)
        SELECT field, code, count(*) AS changes, round(sum(n - o), 4) AS moved FROM x WHERE o IS DISTINCT FROM n GROUP BY field, code""",
    "concat_errors": f"""WITH {_FIRSTS} {_PICK(_CONCAT, "f")}""",
    "transition_errors": f"""WITH {_FIRSTS} {_PICK(_FIRST + ", " + _LONG, "f")}""",
    "plan_errors": f"""WITH {_FIRSTS}, s AS ({" UNION ALL ".join(_STAGE(k, r) for k, r in enumerate((_FIRST, _OWN, _WINDOW, _CONCAT, _LONG)))}), bad AS (SELECT DISTINCT plan_id FROM s WHERE stage = 1 AND e IS NOT NULL),
        n AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY stage, seq, rule)::INT AS ord, {_E} FROM s WHERE e IS NOT NULL AND (stage < 3 OR plan_id NOT IN (SELECT plan_id FROM bad)))
        SELECT *, upper(code) || ' at ' || location || ': ' || field || CASE WHEN value IS NULL THEN '' ELSE '=' || {_NUM("value")} END || CASE WHEN "limit" IS NULL THEN '' ELSE ', limit ' || {_NUM('"limit"')} END || CASE WHEN ord = 1 THEN ' -- first' ELSE '' END AS line FROM n""",
    "normalize_dimensions": f"""WITH {_SEG}, t AS (SELECT plan_id, arg_max(row(width, height), row(width * height, -seq)) AS t, arg_max(width, row(width * height, -seq)) AS tw, arg_max(height, row(width * height, -seq)) AS th FROM seg GROUP BY plan_id)
        SELECT plan_id, seq, tw AS width, th AS height, width <> tw OR height <> th AS resize FROM seg JOIN t USING (plan_id)""",
    "conform_min": f"""WITH {_SEG} SELECT plan_id, CASE WHEN count(*) > 1 THEN min(fps) END AS fps, CASE WHEN count(*) > 1 THEN min(width) END AS width, CASE WHEN count(*) > 1 THEN min(height) END AS height FROM seg GROUP BY plan_id""",
    "assembled_timeline": f"""WITH {_SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY seq) AS i FROM seg), s AS (SELECT plan_id, (sum(frames) - sum(CASE WHEN i > 1 THEN overlap ELSE 0 END))::BIGINT AS frames FROM n GROUP BY plan_id)
        SELECT plan_id, frames, round(frames / 24.0::DOUBLE, 4) AS seconds FROM s""",
    "streamability": f"""WITH {spans_sql()}, o AS (SELECT event_id, user_id, floor(start / 86400) AS day, label AS op, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS pos FROM ev),
        a AS (SELECT *, coalesce(bool_or(op = 'click') OVER w, false) AS seen_frame, coalesce(bool_or(op = 'signup') OVER w, false) AS seen_time FROM o WINDOW w AS (PARTITION BY user_id, day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT *, op IN ('view', 'signup') AND seen_frame OR op = 'error' AND seen_frame AND NOT seen_time AS opens FROM a),
        c AS (SELECT *, coalesce(bool_or(opens) OVER (PARTITION BY user_id, day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM b)
        SELECT event_id, op, CASE op WHEN 'click' THEN CASE WHEN late THEN 'unstreamable' ELSE 'frame_effect' END WHEN 'error' THEN CASE WHEN seen_time THEN 'unstreamable' ELSE 'filter' END
               WHEN 'view' THEN 'filter' WHEN 'signup' THEN 'filter' WHEN 'purchase' THEN 'filter' ELSE 'unstreamable' END AS kind FROM c""",
    "predict_cut": f"""WITH {_MEDIA}, c AS (SELECT *, CASE WHEN round_even(fps, 0) > round_even(fps * 0.5::DOUBLE, 0) AND round_even(fps, 0) <= frame_count + 1 THEN least(round_even(fps, 0), frame_count) - round_even(fps * 0.5::DOUBLE, 0) END AS n FROM media),
        s AS (SELECT *, trunc(n / 0.5::DOUBLE) AS n2 FROM c), r AS (SELECT *, round_even(round(n2 / fps, 4) * 24, 0) AS n3 FROM s WHERE true)
        SELECT video_id, 24.0::DOUBLE AS fps, 320 AS width, greatest(2, (round_even(height * 320.0::DOUBLE / width / 2, 0) * 2)::INT) AS height, n3::BIGINT AS frame_count, round(n3 / 24.0::DOUBLE, 4) AS total_seconds FROM r""",
    "frame_index": f"""WITH {_MEDIA}, z AS (SELECT *, least(frame_count - 1, floor(0.5::DOUBLE * fps))::BIGINT AS fz, round_even(fps, 0)::BIGINT AS held FROM media),
        m AS (SELECT 'freeze_frame' AS op, video_id, CASE WHEN i <= fz THEN i WHEN i <= fz + held THEN fz ELSE i - held END AS src FROM z, unnest(range(0, frame_count + held)) AS u(i)
          UNION ALL SELECT 'resample_fps', video_id, least(frame_count - 1, floor(i * fps / 10.0::DOUBLE))::BIGINT FROM media, unnest(range(0, round_even(frame_count / fps * 10, 0)::BIGINT)) AS u(i)
          UNION ALL SELECT 'speed_change', video_id, least(frame_count - 1, floor(i * 2.0::DOUBLE))::BIGINT FROM media, unnest(range(0, trunc(frame_count / 2.0::DOUBLE)::BIGINT)) AS u(i))
        SELECT op, video_id, count(*) AS frames, sum(src)::BIGINT AS src_sum, max(src) AS src_max FROM m GROUP BY op, video_id""",
    "frame_ramp": f"""WITH {_MEDIA},
        j(job, a, b) AS (VALUES ('up', 0.5::DOUBLE, 2.0::DOUBLE), ('down', 3.0::DOUBLE, 1.5::DOUBLE), ('odd', 1.7::DOUBLE, 1.7::DOUBLE), ('slow', 0.4::DOUBLE, 0.4::DOUBLE)),
        o AS (SELECT job, a, b, video_id, frame_count AS n, trunc(frame_count / ((a + b) / 2))::BIGINT AS m FROM media, j),
        p AS (SELECT job, video_id, k, n, CASE WHEN a <> b THEN n * a / (b - a) * (exp((k + 0.5::DOUBLE) * ln(b / a) / m) - 1) WHEN a > 1 THEN k * a + 0.5::DOUBLE ELSE k * a + a / 2 END AS x FROM o, unnest(range(0, m)) AS u(k)),
        z AS (SELECT video_id, frame_count AS n, least(frame_count - 1, round_even(0.8::DOUBLE * fps, 0))::BIGINT AS f, round_even(1.5::DOUBLE * fps, 0)::BIGINT AS held FROM media),
        e AS (SELECT job, video_id, k, greatest(0, least(n - 1, ceil(round(x, 9)) - 1))::BIGINT AS src FROM p
          UNION ALL SELECT 'replace', video_id, k, CASE WHEN k < f THEN k WHEN k < f + held THEN f ELSE k - held + least(held, n - f) END FROM z, unnest(range(0, n + held - least(held, n - f))) AS u(k))
        SELECT job, video_id, count(*) AS frames, sum(src)::BIGINT AS src_sum, sum(src * k)::BIGINT AS weighted, max(src) AS src_max FROM e GROUP BY job, video_id""",
    "timeline_frames": f"""WITH {_SEG}, l AS (SELECT plan_id, seq, frames, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE least(overlap, least(frames, lag(frames) OVER w) // 2) END AS lap, lag(frames) OVER w AS fb, lag(seq) OVER w AS sb FROM seg WINDOW w AS (PARTITION BY plan_id ORDER BY seq)),
        p AS (SELECT *, coalesce(lead(lap) OVER w, 0) AS nxt, (sum(frames - lap) OVER w - frames + lap)::BIGINT - lap AS st, (sum(CASE WHEN lap > 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS grp FROM l WINDOW w AS (PARTITION BY plan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        q AS (SELECT p.*, k FROM p, unnest(range(0, frames - nxt)) AS u(k)),
        r AS (SELECT plan_id, st + k AS j, grp, CASE WHEN k < lap THEN sb ELSE seq END AS seq_a, CASE WHEN k < lap THEN fb - lap + k ELSE k END AS idx_a,
          CASE WHEN k < lap THEN seq END AS seq_b, CASE WHEN k < lap THEN k END AS idx_b, CASE WHEN k < lap THEN k / lap::DOUBLE END AS weight FROM q)
        SELECT plan_id, grp AS "group", count(*) AS frames, max(j) AS last, count(seq_b) AS faded, round(sum(weight), 6) AS weight, sum(seq_a * (j + 1))::BIGINT AS seq_a,
          sum(idx_a * (j + 1))::BIGINT AS idx_a, sum(seq_b * (j + 1))::BIGINT AS seq_b, sum(idx_b * (j + 1))::BIGINT AS idx_b FROM r GROUP BY plan_id, grp""",
    "resolve_plan": "SELECT l_orderkey AS plan_id, l_linenumber AS seq, l_orderkey AS scene_id, p_name AS caption, p_size AS duration FROM lineitem JOIN part ON p_partkey = l_orderkey",
    "unknown_ids": "SELECT DISTINCT l_orderkey AS scene_id FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part)",
    "timing_summary": """WITH t AS (SELECT l_returnflag, l_quantity AS o, l_quantity * (1 - l_discount * 4) AS g FROM lineitem), f AS (SELECT *, greatest(0.8::DOUBLE, least(1.3::DOUBLE, CASE WHEN g > 0 THEN o / g ELSE 1 END)) AS f FROM t),
        s AS (SELECT *, CASE WHEN abs(f - 1) > 0.01 THEN f ELSE 1 END AS sp FROM f), a AS (SELECT *, o / sp > g + 0.01 AS cut, CASE WHEN o / sp > g + 0.01 THEN g ELSE o / sp END AS act FROM s)
        SELECT l_returnflag, count(*) AS total, count(*) FILTER (NOT cut AND abs(sp - 1) <= 0.01) AS clean, count(*) FILTER (abs(sp - 1) > 0.01) AS stretched, count(*) FILTER (cut) AS truncated,
          round(avg(sp), 8) AS mean_speed_factor, round(coalesce(max(CASE WHEN cut THEN greatest(0, o - act) END), 0), 8) AS max_truncation FROM a GROUP BY l_returnflag""",
    "tempo_stages": """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 10.0::DOUBLE AS f FROM lineitem), k AS (SELECT *, CASE WHEN f >= 1 THEN greatest(ceil(log2(f)) - 1, 0) ELSE greatest(ceil(-log2(f)) - 1, 0) END AS k FROM s)
        SELECT l_orderkey, l_linenumber, CASE WHEN abs(f - 1) < 0.001 THEN 0 ELSE k + 1 END::INT AS stages, round(CASE WHEN abs(f - 1) < 0.001 THEN 1 ELSE f / pow(CASE WHEN f >= 1 THEN 2 ELSE 0.5 END, k) END, 8) AS last FROM k""",
    "clip_predictions": f"""WITH {spans_sql()}, m AS (SELECT floor(start / 86400)::BIGINT AS day, label, avg(confidence / 100) AS prob FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY prob DESC, label) AS rank FROM m)
        SELECT day, label, round(prob, 6) AS prob, rank FROM r WHERE rank <= 3 AND prob >= 0.3""",
    "voice_sample_top1": f"""WITH {spans_sql()}, s AS (SELECT user_id, event_id, start, "end", "end" - start AS d, confidence / 200 AS rms, (event_id % 5) / 20.0::DOUBLE AS bg, confidence / 100 AS peak FROM ev),
        c AS (SELECT *, CASE WHEN d > 0 AND peak < 0.99 AND (bg <= 0 OR rms / bg >= 1.5) THEN rms - 0.05::DOUBLE * abs(d - 6) END AS score FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, d DESC, event_id) AS n FROM c)
        SELECT user_id, event_id, round(score, 8) AS score, start, least("end", start + 10) AS "end" FROM r WHERE n = 1""",
    "frame_budget": """WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS d FROM documents), b AS (SELECT doc_id, d, least(8, greatest(1, ceil(2 * ln(d / 8 + 1))::INT)) AS low, least(30, greatest(1, ceil(3 * ln(d / 5 + 1))::INT)) AS medium, least(60, greatest(1, ceil(4 * ln(d / 3 + 1))::INT)) AS high FROM d)
        SELECT doc_id, low, medium, high, round(CASE WHEN low = 1 THEN d / 2 ELSE least(greatest(d * 1 / (low + 1), 1e-3), d - 1e-3) END, 6) AS first, round(CASE WHEN low = 1 THEN d / 2 ELSE least(greatest(d * low / (low + 1), 1e-3), d - 1e-3) END, 6) AS last FROM b""",
    "iou_pairs": f"""WITH {BOXES_SQL}, p AS (SELECT a.frame_idx, a.det_idx, greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) AS i, a.width * a.height + b.width * b.height AS u
        FROM boxes a JOIN boxes b ON b.frame_idx = a.frame_idx + 1 AND b.det_idx = a.det_idx) SELECT frame_idx, det_idx, round(CASE WHEN u - i > 0 THEN i / (u - i) ELSE 0 END, 8) AS iou FROM p""",
    "select_face": f"""WITH {BOXES_SQL}, f AS (SELECT *, frame_idx * 1000 + det_idx AS d FROM boxes) SELECT shot, arg_min(d, row(-width * height, d)) AS largest, arg_min(d, row((x + width / 2 - 0.5) * (x + width / 2 - 0.5) + (y + height / 2 - 0.5) * (y + height / 2 - 0.5), d)) AS centered FROM f GROUP BY shot""",
    "duck_gain": f"""WITH {spans_sql()}, t AS (SELECT event_id, start - floor(start / 10) * 10 AS t FROM ev), g AS (SELECT *, CASE WHEN t >= 1 AND t < 2.5 THEN 1.0::DOUBLE WHEN t >= 5 AND t < 8 THEN 5.0::DOUBLE END AS a, CASE WHEN t >= 1 AND t < 2.5 THEN 2.0::DOUBLE WHEN t >= 5 AND t < 8 THEN 7.5::DOUBLE END AS b FROM t)
        SELECT event_id, round(CASE WHEN a IS NULL THEN 1 WHEN t < a + 0.2::DOUBLE THEN 1 - 0.8::DOUBLE * (t - a) / 0.2::DOUBLE WHEN t < b THEN 0.2 ELSE 0.2::DOUBLE + 0.8::DOUBLE * (t - b) / 0.5 END, 8) AS gain,
          round(CASE WHEN t / 10 < 0.5 THEN 2 * (t / 10) * (t / 10) ELSE 1 - pow(-2 * (t / 10) + 2, 2) / 2 END, 8) AS eased FROM g""",
}
