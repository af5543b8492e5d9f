"""Queries of the transcript operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import folds, intervals, transcript
from .base import spans, spans_sql, table


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).withColumnsRenamed({"label": "speaker"}).withColumn("word", F.concat(F.lit("w"), F.col("event_id").cast("string")))


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = transcript.turns(_words(spark, sf_dir), ["user_id"], ["start", "event_id"])
    return transcript.segments(words, ["user_id", "turn"], ["start", "event_id"])


def standardize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.by_count(_words(spark, sf_dir), ["user_id"], ["start", "event_id"], 5)


def standardize_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.by_time(_words(spark, sf_dir), ["user_id"], "event_id", 6 * 86400.0).select("user_id", "event_id", F.col("group").cast("long").alias("grp"))


def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transcript.chunks(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", 8)
    return out.select("conv_id", "turn", F.col("part").cast("long").alias("part"), "text")


def sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \n]+", " ")), " ")).alias("pos", "word"))
    return transcript.sentence_case(words, ["conv_id"], ["turn", "pos"]).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "word")


def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.speaker_shares(_words(spark, sf_dir), ["user_id"]).withColumn("share", F.round("share", 8))


def scene_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as scenes."""
    words = _words(spark, sf_dir).drop("confidence", "speaker")
    scenes = words.select("user_id", F.floor(F.col("start") / 86400).alias("day")).distinct()
    scenes = scenes.select("user_id", F.concat_ws("#", "user_id", "day").alias("scene"), (F.col("day") * 86400.0).alias("start"), ((F.col("day") + 1) * 86400.0).alias("end"))
    return intervals.excerpts(scenes, words, ["user_id"], "scene", "event_id", 40, 86400.0).select("user_id", "scene", "transcript")


def transcript_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a segment of its source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lines = docs.join(labels, "doc_id", "left").select("source", "doc_id", "quality", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    rows = lines.select(
        "source", F.struct("doc_id", "line").alias("at"), "text", F.col("doc_id").cast("double").alias("start"), (F.col("doc_id") + F.length("text") / 1000.0).alias("end"), (F.col("quality") - 2.0).cast("double").alias("avg_logprob")
    )
    out = transcript.assess(rows, ["source"], F.lit(20000.0), "at")
    return out.withColumns({"dominant_share": F.round("dominant_share", 8), "speech_fraction": F.round("speech_fraction", 8)})


def normalize_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_phrase(F.col("text")).alias("phrase"))


def vocab_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.vocabulary(table(spark, sf_dir, "part"), "p_name", "p_partkey")


def catalog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.col("p_brand"), F.lit("#"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.unique_id(base, F.col("p_partkey")).alias("id"))


def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.srt_blocks(_words(spark, sf_dir).withColumn("text", F.col("word")), ["user_id"], ["start", "event_id"]).withColumn("n", F.col("n").cast("long"))


def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every user's subtitles, parsed back."""
    docs = transcript.srt_documents(srt_lines(spark, sf_dir), ["user_id"])
    out = transcript.parse_srt(docs, ["user_id"])
    return out.select("user_id", F.col("n").cast("long").alias("n"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def ass_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = text.ass_color(F.col("user_id") % 256, F.col("event_id") % 256, (F.col("event_id") * 7) % 256, F.col("user_id") % 100)
    return spans(spark, sf_dir).select("event_id", text.ass_time(F.col("start")).alias("at"), color.alias("color"), text.ass_escape(F.concat(F.lit("{"), "label", F.lit("\\}\nx"))).alias("escaped"))


def target_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", numeric.target_chars(F.col("n_chars") / 14.0, F.col("lang")).alias("target"), text.translatable(F.col("text")).alias("translatable"))


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("weight", F.col("n_chars") + 40)
    return folds.budget_groups(rows, ["source"], ["doc_id"], "weight", 20000.0).select("source", "doc_id", F.col("group").cast("long").alias("grp"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tolerant read of a JSON column: k where it is a number, null else."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


def tag_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a document's tags comes first: a language, else a source; the creation time of the day it was counted."""
    tags = F.create_map(F.lit("title"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.lit("name"), F.col("source"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"), F.when(F.col("doc_id") % 2 == 0, "+02:00").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_present(tags, ["title", "name"]).alias("tag"), text.creation_time(day).alias("created"))


def geo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written both ways from customers' keys and balances."""
    at = table(spark, sf_dir, "customer")
    lat, lon = (F.col("c_custkey") % 140 - 70).cast("string"), (F.col("c_custkey") % 300 - 150).cast("string")
    signed = lambda c: F.when(c.startswith("-"), c).otherwise(F.concat(F.lit("+"), c))
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat(signed(lat), signed(lon), F.lit("/"))).otherwise(F.concat(lat, F.lit(", "), lon))
    return at.select("c_custkey", text.geo(written).alias("g")).select("c_custkey", "g.latitude", "g.longitude")


QUERIES = {
    f.__name__: f
    for f in (speaker_turns, standardize_words, standardize_time, chunk_segments, sentence_case, speaker_stats, scene_excerpt, transcript_quality, normalize_phrase, vocab_dedup, catalog_ids, srt_lines, srt_round_trip, ass_times, target_chars, token_chunks, json_props, tag_first_present, geo_parse)
}

_W = f"{spans_sql()}, words AS (SELECT *, label AS speaker, 'w' || event_id AS word, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS i FROM ev)"
_TURNS = f"""{_W}, t AS (SELECT *, sum(CASE WHEN i = 1 OR p IS DISTINCT FROM speaker THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS turn
        FROM (SELECT *, lag(speaker) OVER (PARTITION BY user_id ORDER BY i) AS p FROM words))"""
_SRT = """printf('%02d:%02d:%02d,%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"""
_MS = 'round_even("{0}" * 1000, 0)::BIGINT'

ORACLE_SQL = {
    "speaker_turns": f"""WITH {_TURNS} SELECT user_id, turn::BIGINT AS turn, arg_min(start, i) AS start, arg_max("end", i) AS "end", string_agg(word, ' ' ORDER BY i) AS text, arg_min(speaker, i) AS speaker, count(*) AS n_words
        FROM t GROUP BY user_id, turn""",
    "standardize_words": f"""WITH {_TURNS}, c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, turn ORDER BY i) - 1) // 5 AS part FROM t)
        SELECT user_id, turn::BIGINT AS turn, part::BIGINT AS part, arg_min(start, i) AS start, arg_max("end", i) AS "end", string_agg(word, ' ' ORDER BY i) AS text, arg_min(speaker, i) AS speaker, count(*) AS n_words
        FROM c GROUP BY user_id, turn, part""",
    "standardize_time": f"""WITH RECURSIVE {_W}, r AS (SELECT user_id, event_id, i, start AS st, speaker, 0 AS grp FROM words WHERE i = 1
        UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN n."end" - r.st > 518400 OR n.speaker IS DISTINCT FROM r.speaker THEN n.start ELSE r.st END,
          CASE WHEN n."end" - r.st > 518400 OR n.speaker IS DISTINCT FROM r.speaker THEN n.speaker ELSE r.speaker END, CASE WHEN n."end" - r.st > 518400 OR n.speaker IS DISTINCT FROM r.speaker THEN r.grp + 1 ELSE r.grp END
        FROM r JOIN words n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT user_id, event_id, grp::BIGINT AS grp FROM r""",
    "chunk_segments": r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)
        SELECT conv_id, turn, p::BIGINT AS part, array_to_string(list_slice(w, p * 8 + 1, p * 8 + 8), ' ') AS text FROM w, unnest(range(0, greatest(1, ceil(len(w) / 8.0)::INT))) AS u(p)""",
    "sentence_case": r"""WITH s AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[ \n]+', ' ', 'g')), ' ') AS w FROM conversations),
        w AS (SELECT conv_id, turn, i - 1 AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos, w[i] AS word FROM s, unnest(range(1, len(w) + 1)) AS u(i)),
        m AS (SELECT *, regexp_matches(regexp_replace(word, '["''”’)\]}»]+$', ''), '[.!?…]$') AS e, regexp_matches(word, '\p{L}') AS a FROM w),
        l AS (SELECT *, coalesce(max(CASE WHEN a THEN pos END) OVER o, -1) AS la, coalesce(max(CASE WHEN e THEN pos END) OVER o, -1) AS le FROM m WINDOW o AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, turn, p AS pos, CASE WHEN a AND la <= le THEN regexp_extract(word, '^([^\p{L}]*)', 1) || upper(regexp_extract(word, '^[^\p{L}]*(\p{L})', 1)) || regexp_extract(word, '^[^\p{L}]*\p{L}(.*)$', 1) ELSE word END AS word FROM l""",
    "speaker_stats": f"""WITH {_W}, s AS (SELECT user_id, speaker, sum("end" - start) AS x FROM words WHERE speaker IS NOT NULL GROUP BY ALL)
        SELECT user_id, speaker, round(CASE WHEN sum(x) OVER (PARTITION BY user_id) > 0 THEN x / sum(x) OVER (PARTITION BY user_id) ELSE 0 END, 8) AS share FROM s""",
    "scene_excerpt": f"""WITH {_W}, d AS (SELECT DISTINCT user_id, floor(start / 86400)::BIGINT AS day FROM words),
        x AS (SELECT d.user_id, d.user_id || '#' || d.day AS scene, coalesce(string_agg(word, ' ' ORDER BY w.start, w.event_id), '') AS t
              FROM d LEFT JOIN words w ON w.user_id = d.user_id AND w."end" > d.day * 86400.0 AND w.start < (d.day + 1) * 86400.0 AND w."end" > w.start GROUP BY ALL)
        SELECT user_id, scene, CASE WHEN length(t) > 40 THEN rtrim(substr(t, 1, 37)) || '...' ELSE t END AS transcript FROM x""",
    "transcript_quality": r"""WITH l AS (SELECT source, doc_id, quality, string_split(coalesce(text, ''), chr(10)) AS x FROM documents LEFT JOIN labels USING (doc_id)),
        s AS (SELECT source, doc_id, i AS line, x[i] AS text, length(x[i]) / 1000.0::DOUBLE AS d, (quality - 2.0)::DOUBLE AS lp FROM l, unnest(range(1, len(x) + 1)) AS u(i)),
        p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM s),
        b AS (SELECT source, phrase, sum(length(phrase)) AS chars, min(row(doc_id, line)) AS first FROM p WHERE phrase <> '' GROUP BY ALL),
        t AS (SELECT source, arg_min(phrase, row(-chars, first)) AS phrase, max(chars) AS most, sum(chars) AS chars FROM b GROUP BY source),
        w AS (SELECT source, median(lp) AS median_logprob, sum(doc_id + d - doc_id) / 20000.0::DOUBLE AS speech_fraction, count(*) AS n FROM p GROUP BY source),
        x AS (SELECT *, coalesce(most / chars, 0) AS share FROM w LEFT JOIN t USING (source)),
        f AS (SELECT *, share >= 0.7 AS rep, coalesce(median_logprob < -1.5, false) AS uns, speech_fraction < 0.05 AS qui FROM x)
        SELECT source, CASE WHEN rep THEN phrase END AS dominant_phrase, round(share, 8) AS dominant_share, median_logprob, round(speech_fraction, 8) AS speech_fraction, n AS n_segments,
          array_to_string(list_filter([CASE WHEN rep THEN 'dominant_phrase' END, CASE WHEN uns THEN 'low_confidence' END, CASE WHEN qui THEN 'little_speech' END], lambda v: v IS NOT NULL), ',') AS flags,
          CASE WHEN rep AND (uns OR qui) THEN 'reject' WHEN rep OR uns OR qui THEN 'warn' ELSE 'ok' END AS recommendation FROM f""",
    "normalize_phrase": r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM documents",
    "vocab_dedup": "SELECT arg_min(trim(p_name), p_partkey) AS term, min(p_partkey) AS pos FROM part WHERE trim(p_name) <> '' GROUP BY lower(trim(p_name))",
    "catalog_ids": """WITH b AS (SELECT p_partkey, p_brand || '#' || p_size AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b)
        SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM n""",
    "srt_lines": f"""WITH {_W} SELECT user_id, i AS n, i || chr(10) || {_SRT.format(_MS.format("start"))} || ' --> ' || {_SRT.format(_MS.format("end"))} || chr(10) || word AS block FROM words""",
    "srt_round_trip": f"""WITH {_W} SELECT user_id, i - 1 AS n, round({_MS.format("start")} / 1000.0::DOUBLE, 3) AS start, round({_MS.format("end")} / 1000.0::DOUBLE, 3) AS "end", word AS text FROM words""",
    "ass_times": f"""WITH {spans_sql()}, c AS (SELECT *, greatest(0, round_even(start * 100, 0))::BIGINT AS cs FROM ev)
        SELECT event_id, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS at,
          printf('&H%02X%02X%02X%02X', 255 - user_id % 100, (event_id * 7) % 256, event_id % 256, user_id % 256) AS color, '(' || label || '/) x' AS escaped FROM c""",
    "target_chars": r"""SELECT doc_id, greatest(1, trunc(n_chars / 14.0::DOUBLE * CASE lang WHEN 'en' THEN 14.0::DOUBLE WHEN 'de' THEN 12 WHEN 'fr' THEN 13 WHEN 'es' THEN 14 ELSE 12 END * 1.15::DOUBLE)::BIGINT) AS target,
        length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 2 AS translatable FROM documents""",
    "token_chunks": """WITH RECURSIVE n AS (SELECT source, doc_id, n_chars + 40 AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        r AS (SELECT source, doc_id, i, w AS t, 0 AS grp FROM n WHERE i = 1 UNION ALL
              SELECT n.source, n.doc_id, n.i, CASE WHEN r.t + n.w <= 20000 THEN r.t + n.w ELSE n.w END, CASE WHEN r.t + n.w <= 20000 THEN r.grp ELSE r.grp + 1 END FROM r JOIN n ON n.source = r.source AND n.i = r.i + 1)
        SELECT source, doc_id, grp::BIGINT AS grp FROM r""",
    "json_props": "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "tag_first_present": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS tag,
        CASE WHEN doc_id % 2 = 0 THEN printf('2024-01-%02dT08:00:00Z', doc_id % 28 + 1) ELSE printf('2024-01-%02dT10:00:00', doc_id % 28 + 1) END AS created FROM documents""",
    "geo_parse": "SELECT c_custkey, (c_custkey % 140 - 70)::DOUBLE AS latitude, (c_custkey % 300 - 150)::DOUBLE AS longitude FROM customer",
}
