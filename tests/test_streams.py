"""Streams give what the batch forms give, whatever the order of their triggers."""

import os
import random
import uuid
from pathlib import Path

import pytest

from tidemark.operators import folds
from tidemark.shared import shared_dir
from tidemark.streaming import stateful

BOXES = "shot int, ts timestamp, frame_idx long, det_idx long, x double, y double, width double, height double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, was)


def detections(seed):
    """Three shots of forty frames; a third of the frames, and a long stretch, without detections."""
    rng, rows = random.Random(seed), []
    for shot in range(3):
        for frame in range(40):
            n = 0 if rng.random() < 0.3 or 15 <= frame < 22 else rng.randint(1, 3)
            boxes = [(d, 0.1 * d + rng.random() * 0.1, rng.random() * 0.1, 0.3, 0.3) for d in range(n)] or [(None,) * 5]
            rows += [(shot, 1000.0 + frame, frame, *b) for b in boxes]
    return rows


def test_tracks_on_a_stream(rocks):
    from pyspark.sql import functions as F

    rows = detections(7)
    df = rocks.createDataFrame(rows, BOXES.replace("ts timestamp", "ts double")).withColumn("ts", F.col("ts").cast("timestamp"))
    boxes = df.filter("det_idx is not null").drop("ts")
    wanted = {tuple(r) for r in folds.tracks(boxes, ["shot"], 0.3, 2, df.select("shot", "frame_idx")).select("shot", "frame_idx", "det_idx", "track_id").collect()}
    folder = f"{shared_dir(rocks)}/tracks-{uuid.uuid4().hex}"
    order = list(range(len(rows)))
    # triggers hold frames out of order, within ten frames; a last row of another shot takes the watermark past all
    order.sort(key=lambda k: rows[k][2] // 10 * 10 + random.Random(k).random())
    for part in range(0, len(order), 40):
        rocks.createDataFrame([rows[k] for k in order[part : part + 40]], BOXES.replace("ts timestamp", "ts double")).coalesce(1).write.mode("append").parquet(f"{folder}/in/{part:04}")
    rocks.createDataFrame([(99, 9999.0, 0, None, None, None, None, None)], BOXES.replace("ts timestamp", "ts double")).coalesce(1).write.parquet(f"{folder}/in/9999")
    for k, file in enumerate(sorted(Path(folder.removeprefix("file:")).glob("in/*/*.parquet"))):
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)  # a stream takes files by age
    stream = rocks.readStream.schema(BOXES.replace("ts timestamp", "ts double")).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = stateful.tracked(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["shot"], "20 seconds", 0.3, 2)
    got = [tuple(r) for r in stateful.drained(found, f"{folder}/out", f"{folder}/state").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_smoothing_begins_at_the_first_value(spark):
    folder = f"{shared_dir(spark)}/ema-{uuid.uuid4().hex}"
    schema = "k long, event_id long, ts timestamp, value double"
    from pyspark.sql import functions as F

    for part, rows in enumerate([[(1, 0, 0, None)], [(1, 1, 1, 1.0), (1, 2, 2, None)], [(1, 3, 3, 2.0)]]):
        spark.createDataFrame(rows, "k long, event_id long, ts long, value double").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{folder}/in/{part}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = stateful.drained(stateful.smoothed(stream, "k", 0.5), f"{folder}/out", f"{folder}/state")
    assert [r.smoothed for r in got.orderBy("event_id").collect()] == [None, 1.0, 1.0, 1.5]
