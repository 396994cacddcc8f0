"""Frames stored where their requests are built.

A store is a table of frames (video, frame_idx, payload) bucketed by video and
segment, the run of ``SEGMENT`` frames a frame lies in. Frames are written
from the partitions they come in, so no payload crosses a shuffle, then or
later: a choice of frames is a few numbers a video, dealt to the buckets, and
the parts of a request lie within a segment. Segments also spread a video of
any length over the buckets.

A request for a long video comes in numbered parts of at most ``PART`` frames,
each a bounded row: ``first_rank`` is the place of a part's first frame in the
request, ``n_request`` the frame numbers that the whole request asks for.

Defined cases: frames without a video or number belong to no request; frames
that repeat a number are each kept; a video that isn't in the choice, or of
which no frame is chosen, has no part. A store whose write broke off has no
marker and is not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.sqltext import lit
from verdikt.operators.media_plan import MAX_FRAMES, REQUEST_STRIDE, sample_interval
from verdikt.session import create_file

# Frames of a segment, and of a request part.
SEGMENT = 1000
PART = 20

SCHEMA = "video STRING, segment BIGINT, frame_idx BIGINT, payload BINARY"


def store_frames(frames: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write (video, frame_idx, payload) to the new folder ``path``; returns the
    stored frames. The number of files is that of the tasks that hold frames
    times the buckets they meet: a task that decodes whole videos meets few."""
    spark = frames.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = frames.selectExpr("CAST(video AS STRING) AS video", f"CAST(floor(frame_idx / {SEGMENT}) AS BIGINT) AS segment", "CAST(frame_idx AS BIGINT) AS frame_idx", "CAST(payload AS BINARY) AS payload")
    name = f"frames_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "video", "segment").option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    create_file(spark, f"{path}/store.json", json.dumps({"buckets": n}))
    return stored_frames(spark, path)


def stored_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of a finished store, with their buckets. The catalog entry
    only tells Spark about these and goes once the frame knows them."""
    n = json.loads(spark.read.text(f"{path}/store.json").first()[0])["buckets"]
    name = f"frames_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (video, segment) INTO {n} BUCKETS LOCATION {lit(f'{path}/rows')}")
    df = spark.table(name)
    df.schema  # noqa: B018  (resolved before the entry goes)
    spark.sql(f"DROP TABLE {name}")
    return df


def stride_choice(videos: DataFrame, stride: int = REQUEST_STRIDE) -> DataFrame:
    """M9 + M10: every ``stride``-th of all frames, from (video, n_frames)."""
    return videos.select("video", "n_frames", F.lit(stride).cast("long").alias("step"))


def sample_choice(videos: DataFrame, max_frames: int = MAX_FRAMES) -> DataFrame:
    """M6: ``max_frames`` frames at even steps, from (video, n_frames)."""
    step = sample_interval(F.col("n_frames"), max_frames)
    return videos.select("video", F.least("n_frames", step * max_frames).alias("n_frames"), step.alias("step"))


def request_parts(stored: DataFrame, choice: DataFrame, part: int = PART) -> DataFrame:
    """(video, first_rank, n_frames, n_request, frames): the chosen frames in
    parts of at most ``part``, payloads in order.

    ``choice`` has a row per video (video, n_frames, step): every ``step``-th of
    its first ``n_frames`` frames. It is dealt to the buckets, a row a segment;
    frames are read as they lie, looked up, and grouped where they are.
    """
    last = F.floor((F.col("n_frames") - 1) / SEGMENT).cast("long")
    segments = choice.where("video IS NOT NULL AND n_frames > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    chosen = stored.join(segments.hint("shuffle_hash"), ["video", "segment"]).where("frame_idx < n_frames AND frame_idx % step = 0")
    rank = F.floor(F.col("frame_idx") / F.col("step")).cast("long")
    chosen = chosen.select("video", "segment", rank.alias("rank"), "payload", F.ceil(F.col("n_frames") / F.col("step")).cast("long").alias("n_request"))
    packed = chosen.groupBy("video", "segment", F.floor(F.col("rank") / part).alias("part")).agg(
        F.min("rank").alias("first_rank"),
        F.count(F.lit(1)).alias("n_frames"),
        F.max("n_request").alias("n_request"),
        F.sort_array(F.collect_list(F.struct("rank", "payload"))).getField("payload").alias("frames"),
    )
    return packed.select("video", "first_rank", "n_frames", "n_request", "frames")
