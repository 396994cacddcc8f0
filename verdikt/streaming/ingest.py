"""Incremental ingest of response logs (T1) with last-wins answers and
running metrics (T2).

Logs grow while a run is under way. Closed log files dropped into a folder
are read by the file stream source; each micro-batch is parsed, its answers
extracted (S1 + E*) and reduced last-wins within the batch, and the small
extracted rows (never the answer text) are written to the answer table as one
epoch, partitioned by run. How many lines ended in which status, bad lines
included, is counted per epoch beside it.

An epoch's folder is named by the query's id and the batch number. The id
belongs to the stream's checkpoint: a retried micro-batch overwrites its own
epoch (exactly once per epoch), while a new checkpoint, which counts from 0
again, writes beside what is stored, never over it. Every batch writes only its
own rows. Reading the table applies last-wins across epochs
(:func:`latest_table`), the same reduction the batch path uses, so the result
equals a batch run over all files.

With ``truth`` given, sliced metrics of all answers so far are written after
every micro-batch; ``compact_every`` folds the stored epochs into one each so
many batches, which bounds what those metrics have to read. Two chained
stateful aggregations are not possible in one streaming query, hence
``foreachBatch``. Table and stream checkpoint live under the shared checkpoint
folder, so a restart resumes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.dialects import extract_labels
from verdikt.operators.dedup import last_wins
from verdikt.operators.metrics import sliced_metrics
from verdikt.operators.scoring import attach_truth, score_rows
from verdikt.session import child_folders, delete_path, path_exists, rename_path
from verdikt.sources.logs import commit_of, parse_keyed_lines

KEYS = ["model", "method", "video"]
VALUES = ["raw_value", "parse_status", "line_order"]
MAX_BYTES = 1 << 30


def stream_lines(spark: SparkSession, folder: str, max_bytes_per_trigger: int = MAX_BYTES) -> DataFrame:
    """A streaming frame of log lines with file order and run attributes
    read from the folder layout ``model=<m>/method=<me>/*``. A micro-batch
    takes files up to ``max_bytes_per_trigger``, whatever their number."""
    df = (
        spark.readStream.format("text")
        .option("maxBytesPerTrigger", str(max_bytes_per_trigger))
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    meta = F.col("_metadata")
    path = meta.getField("file_path")
    return df.select(
        F.regexp_extract(path, r"model=([^/]+)", 1).alias("model"),
        F.regexp_extract(path, r"method=([^/]+)", 1).alias("method"),
        F.col("value").alias("line"),
        F.struct(
            meta.getField("file_modification_time").alias("mtime"),
            path.alias("path"),
            meta.getField("file_block_start").alias("block"),
        ).alias("file_order"),
    )


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def merge_batch(batch: DataFrame, epoch: str, table_path: str, dialect: str, key: str) -> None:
    """Write one micro-batch as the epoch named ``epoch``."""
    # Inside a micro-batch the frame is static: lines of a split are read
    # in order, so a per-split increasing id completes the file order.
    batch = batch.select(
        "model", "method", "line",
        F.struct(
            commit_of(F.col("file_order.path")).alias("commit"),
            F.col("file_order.mtime").alias("mtime"),
            F.col("file_order.path").alias("path"),
            F.col("file_order.block").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_order"),
    )
    rows = extract_labels(parse_keyed_lines(batch), dialect, key, line_col="line")
    status = F.when(F.col("line_status") == "ok", F.col("parse_status")).otherwise(F.col("line_status"))
    rows = rows.select("model", "method", "video", "raw_value", "line_order", "line_status", status.alias("parse_status"))
    new = last_wins(rows.where(F.col("line_status") == "ok"), KEYS, "line_order", VALUES)
    new.drop("n_versions").write.mode("overwrite").partitionBy("model", "method").parquet(f"{table_path}/answers/epoch={epoch}")
    counts = rows.groupBy("model", "method", "parse_status").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{table_path}/quality/epoch={epoch}")


def latest_table(spark: SparkSession, table_path: str) -> DataFrame:
    """T2 read side: the last answer per (run, video) across all epochs."""
    stored = spark.read.option("basePath", f"{table_path}/answers").parquet(f"{table_path}/answers")
    return last_wins(stored, KEYS, "line_order", VALUES).drop("n_versions")


def quality_table(spark: SparkSession, table_path: str) -> DataFrame:
    """A11 of the stream: lines per run and status, bad lines included."""
    stored = spark.read.option("basePath", f"{table_path}/quality").parquet(f"{table_path}/quality")
    return stored.groupBy("model", "method", "parse_status").agg(F.sum("n").alias("n"))


def running_metrics(spark: SparkSession, table_path: str, truth: DataFrame) -> DataFrame:
    """Sliced metrics of all answers stored so far."""
    latest = latest_table(spark, table_path).select(*KEYS, "raw_value", "parse_status")
    return sliced_metrics(score_rows(attach_truth(latest, truth), "wrong"))


def compact(spark: SparkSession, table_path: str) -> None:
    """Fold the stored epochs of answers into one. The folded epoch is written
    first and the old ones are deleted after it: readers that see both still
    read the same last answers, and a crash in between loses nothing."""
    answers = f"{table_path}/answers"
    old = child_folders(spark, answers) if path_exists(spark, answers) else []
    if len(old) < 2:
        return
    latest_table(spark, table_path).write.partitionBy("model", "method").parquet(f"{answers}/epoch=folded-{uuid.uuid4().hex}")
    for name in old:
        delete_path(spark, f"{answers}/{name}")


def ingest(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    dialect: str = "greedy",
    key: str = "result",
    max_bytes_per_trigger: int = MAX_BYTES,
    truth: DataFrame | None = None,
    compact_every: int | None = None,
):
    """Run the ingest until all present files are processed.

    Metrics after batch ``n`` are written to ``<table_path>/metrics/epoch=<id>-<n>``.
    """

    def merge(batch: DataFrame, n: int) -> None:
        epoch = f"{query_id(spark, checkpoint)}-{n:09d}"
        merge_batch(batch, epoch, table_path, dialect, key)
        if truth is not None:
            running_metrics(spark, table_path, truth).write.mode("overwrite").parquet(f"{table_path}/metrics/epoch={epoch}")
        if compact_every and n % compact_every == compact_every - 1:
            compact(spark, table_path)

    q = (
        stream_lines(spark, folder, max_bytes_per_trigger)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def write_log_files(lines: DataFrame, folder: str) -> str:
    """Publish log lines as the next commit of ``folder``: closed text files below
    ``commit=<n>``, laid out by run, from the partitions the lines are in (no
    shuffle and no sort, since each (run, video) occurs once in what is written
    by one call). Later commits win, whatever their files' times. Files are
    staged under a hidden name and renamed when all are written, so readers
    see a commit whole; a writer that finds its number taken takes the next."""
    spark = lines.sparkSession
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    lines.select("model", "method", F.col("line").alias("value")).write.partitionBy("model", "method").text(staged)
    while True:
        taken = [int(n.partition("=")[2]) for n in child_folders(spark, folder) if n.startswith("commit=")]
        commit = f"{folder}/commit={max(taken, default=-1) + 1:09d}"
        if rename_path(spark, staged, commit):
            return commit
