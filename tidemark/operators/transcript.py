"""Transcripts: words to segments, chunks, sentence case, speaker shares, quality, SRT and ASS documents.

A word is a row with keys, start, end, word, speaker and an order; a key is one
transcript, so its rows are sorted once and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import fold
from .intervals import BEFORE, islands


#: When a transcript is doubtful.
DOMINANT_SHARE, LOW_LOGPROB, LOW_SPEECH, SHORT_SECONDS = 0.70, -1.5, 0.05, 30.0


def turns(words: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "turn") -> DataFrame:
    """Numbers the runs of words of one speaker; no speaker is a speaker too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.row_number().over(w) == 1
    return islands(words.withColumn("__new", new | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))), keys, order, F.col("__new"), name).drop("__new")


def segments(words: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group of words: the first's start, the last's end, the words joined by a space."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "word")))
    return words.groupBy(*keys).agg(
        F.min_by("start", F.struct(*order)).alias("start"), F.max_by("end", F.struct(*order)).alias("end"), F.array_join(parts["word"], " ").alias("text"),
        F.min_by("speaker", F.struct(*order)).alias("speaker"), F.count(F.lit(1)).alias("n_words"),
    )


def by_count(words: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Segments of at most `size` words, new at each change of speaker."""
    numbered = turns(words, keys, order)
    w = Window.partitionBy(*keys, "turn").orderBy(*order)
    return segments(numbered.withColumn("part", F.floor((F.row_number().over(w) - 1) / size)), [*keys, "turn", "part"], order)


def by_time(words: DataFrame, keys: Sequence[str], order: str, most: float) -> DataFrame:
    """Adds `group`: a new one where a word would end more than `most` after the group's start, or the speaker changes."""

    def step(state: tuple | None, start: float, end: float, speaker: str | None) -> tuple[tuple, int]:
        first, p, k = state or (None, None, -1)
        if k < 0 or end - first > most or speaker != p:
            first, p, k = start, speaker, k + 1
        return (first, p, k), k

    return fold(words, keys, ["start", order], ["start", "end", "speaker"], step, "group", "int").select(*keys, order, "start", "end", "speaker", "group")


def chunks(rows: DataFrame, keys: Sequence[str], text: str, size: int) -> DataFrame:
    """Segments of at most `size` words each of a text column's words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("__w") / size).cast("int") - 1)), lambda i: F.array_join(F.slice("__w", i * size + 1, F.lit(size)), " "))
    return rows.withColumn("__w", words).select(*keys, F.posexplode(parts).alias("part", "text"))


def sentence_case(words: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first word with a letter after each sentence's end, and of the whole, begins with a capital."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*BEFORE)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    bare = F.regexp_replace("word", r"""["'”’)\]}»]+$""", "")
    marked = words.withColumns({"__n": n, "__end": bare.rlike(r"[.!?…]$"), "__alpha": F.col("word").rlike(r"\p{L}")})
    last = lambda c: F.coalesce(F.max(F.when(F.col(c), F.col("__n"))).over(w), F.lit(-1))
    raised = F.concat(F.regexp_extract("word", r"^([^\p{L}]*)", 1), F.upper(F.regexp_extract("word", r"^[^\p{L}]*(\p{L})", 1)), F.regexp_extract("word", r"^[^\p{L}]*\p{L}(.*)$", 1))
    return marked.withColumn("word", F.when(F.col("__alpha") & (last("__alpha") <= last("__end")), raised).otherwise(F.col("word"))).drop("__n", "__end", "__alpha")


def speaker_shares(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each speaker's share of the spoken time; words without a speaker count for neither."""
    by = words.filter("speaker is not null").groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    total = by.groupBy(*keys).agg(F.sum("seconds").alias("total"))
    return by.join(total, list(keys)).select(*keys, "speaker", F.when(F.col("total") > 0, F.col("seconds") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def assess(segments_: DataFrame, keys: Sequence[str], duration: Column, order: str) -> DataFrame:
    """Quality of transcripts from segments (keys, text, start, end, avg_logprob): the dominant phrase's share of characters, median log probability, spoken share, flags and ok, warn or reject."""
    phrased = segments_.withColumns({"phrase": T.normalize_phrase(F.col("text")), "__d": duration})
    by_phrase = phrased.filter("phrase <> ''").groupBy(*keys, "phrase").agg(F.sum(F.length("phrase")).alias("chars"), F.min(order).alias("first"))
    top = by_phrase.groupBy(*keys).agg(F.min_by("phrase", F.struct((-F.col("chars")).alias("c"), "first")).alias("dominant_phrase"), F.max("chars").alias("most"), F.sum("chars").alias("chars"))
    whole = phrased.groupBy(*keys).agg(
        F.median("avg_logprob").alias("median_logprob"), F.max("__d").alias("__d"), F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("__spoken"), F.count(F.lit(1)).alias("n_segments")
    )
    fraction = F.when(F.col("__d") > 0, F.col("__spoken") / F.col("__d")).otherwise(F.lit(0.0))
    joined = whole.join(top, list(keys), "left").withColumns({"dominant_share": F.coalesce(F.col("most") / F.col("chars"), F.lit(0.0)), "speech_fraction": fraction})
    repeated = F.col("dominant_share") >= DOMINANT_SHARE
    unsure, quiet = F.coalesce(F.col("median_logprob") < LOW_LOGPROB, F.lit(False)), (F.col("__d") > SHORT_SECONDS) & (F.col("speech_fraction") < LOW_SPEECH)
    flags = F.array_compact(F.array(F.when(repeated, "dominant_phrase"), F.when(unsure, "low_confidence"), F.when(quiet, "little_speech")))
    verdict = F.when(repeated & (unsure | quiet), "reject").when(F.size(flags) > 0, "warn").otherwise("ok")
    return joined.select(
        *keys, F.when(repeated, F.col("dominant_phrase")).alias("dominant_phrase"), "dominant_share", "median_logprob", "speech_fraction", "n_segments", F.array_join(flags, ",").alias("flags"), verdict.alias("recommendation")
    )


def vocabulary(rows: DataFrame, term: str, order: str, budget: int | None = None) -> DataFrame:
    """Distinct terms, case and outer space aside, the first of each kept in order; the tail over a budget of characters goes."""
    clean = rows.select(F.trim(F.col(term)).alias("term"), F.col(order).alias("pos")).filter("term <> ''")
    first = clean.groupBy(F.lower("term").alias("key")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
    if budget is None:
        return first.select("term", "pos")
    spent = F.sum(F.length("term") + 1).over(Window.orderBy("pos"))
    fit = first.orderBy("pos").limit(budget // 2)  # a term takes two characters at least, so no more can fit
    return fit.withColumn("__spent", spent).filter(F.col("__spent") <= budget).select("term", "pos")


def srt_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Numbered subtitle blocks of segments (keys, start, end, text)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    body = F.concat(n.cast("string"), F.lit("\n"), T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")), F.lit("\n"), F.col("text"))
    return rows.select(*keys, n.alias("n"), body.alias("block"))


def srt_documents(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One document per key, blocks parted by a blank line."""
    held = F.array_sort(F.collect_list(F.struct("n", "block")))
    return blocks.groupBy(*keys).agg(F.concat(F.array_join(held["block"], "\n\n"), F.lit("\n")).alias("srt"))


def parse_srt(documents: DataFrame, keys: Sequence[str], srt: str = "srt") -> DataFrame:
    """Segments of SRT documents: blocks of three lines or more whose second one has an arrow, text lines joined by a newline, however many."""
    blocks = documents.select(*keys, F.posexplode(F.split(F.regexp_replace(F.regexp_replace(srt, "\r", ""), r"^\s+|\s+$", ""), r"\n\s*\n")).alias("n", "__block"))
    rows = blocks.withColumn("__lines", F.split("__block", "\n")).filter(F.size("__lines") >= 3)
    time = F.split(F.element_at("__lines", 2), r"\s*-->\s*")
    text = F.array_join(F.slice("__lines", F.lit(3), F.size("__lines") - 2), "\n")
    timed = rows.filter(F.size(time) == 2)
    return timed.select(*keys, "n", *[T.parse_srt_time(F.trim(F.get(time, F.lit(k)))).alias(c) for k, c in enumerate(("start", "end"))], text.alias("text"))


def ass_events(tiled: DataFrame, words: DataFrame, keys: Sequence[str], style: str = "Default", color: str = "&H50AF4C&") -> DataFrame:
    """A dialogue line for each tile of `intervals.tiles`, the spoken word coloured. words: keys, an index n and the word."""
    held = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ws"))
    shown = F.transform("ws", lambda w, i: F.when(i == F.col("highlight"), F.concat(F.lit("{\\c" + color + "}"), T.ass_escape(w["word"]), F.lit("{\\r}"))).otherwise(T.ass_escape(w["word"])))
    line = F.concat(F.lit("Dialogue: 0,"), T.ass_time(F.col("start_cs") / 100), F.lit(","), T.ass_time(F.col("end_cs") / 100), F.lit(f",{style},,0,0,0,,"), F.array_join(shown, " "))
    return tiled.join(held, list(keys)).select(*keys, "start_cs", "end_cs", line.alias("line"))
