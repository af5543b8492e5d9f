"""Text documents of the domain: SRT files, JSON records with fixed schemas, and media tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transcript

BOX = "struct<x:double,y:double,width:double,height:double>"
WORD = "struct<start:double,end:double,word:string,speaker:string>"
SCHEMAS = {
    "word": "start double, end double, word string, speaker string",
    "segment": f"start double, end double, text string, words array<{WORD}>, speaker string, avg_logprob double, no_speech_prob double, compression_ratio double",
    "scene": "start double, end double, start_frame int, end_frame int",
    "detection": f"label string, confidence double, box {BOX}",
    "audio_event": "start double, end double, label string, confidence double",
    "classification": "events array<struct<start:double,end:double,label:string,confidence:double>>, clip_predictions map<string,double>",
    "description": "caption string, subjects array<string>, shot_type string",
    "face_track": f"track_id int, frame_indices array<int>, boxes array<{BOX}>, confidences array<double>",
    "media": "height int, width int, fps double, frame_count int, total_seconds double",
}


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """path, n, start, end, text of the blocks of SRT files."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("srt"))
    return transcript.parse_srt(files, ["path"])


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of one of SCHEMAS; a line of another shape is an error."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def record(text: Column, kind: str) -> Column:
    """A JSON text as a struct of one of SCHEMAS; missing fields null, a confidence that is missing 1."""
    parsed = F.from_json(text, SCHEMAS[kind])
    return parsed.withField("confidence", F.coalesce(parsed["confidence"], F.lit(1.0))) if kind in ("detection", "audio_event") else parsed


def to_record(struct: Column) -> Column:
    """The JSON text of a record, nulls kept."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def merged_tags(stream: Column, container: Column) -> Column:
    """Tags of both, lower-case keys; the container's win."""
    lower = lambda m: F.transform_keys(m, lambda k, v: F.lower(k))
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(lower(stream), lambda k, v: ~F.map_contains_key(lower(container), k))), F.map_entries(lower(container))))


def frame_count(nb_frames: Column, duration: Column, fps: Column) -> Column:
    """The container's frame count if it is a number, else what its duration gives."""
    return F.when(nb_frames.rlike("^[0-9]+$"), nb_frames.cast("long")).otherwise(F.rint(duration * fps).cast("long"))
