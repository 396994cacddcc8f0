"""Running metrics of a growing log by retraction.

The stream keeps the last answer of every (run, video) as keyed state, at fixed
width: its order, slice masks, truth and prediction. Python is called once for
the videos of a run and bucket that a batch brings, each of which is a map entry. A new answer that replaces
an old one takes the old one out of the counts and puts the new one in, so a
micro-batch changes the histogram by (run, masks, truth, prediction) by deltas:
what it reads and writes is in proportion to the batch, not to the log.

Each micro-batch writes the histogram after it as one epoch (a row per
combination that occurs, whatever the number of answers) and the sliced metrics
of all answers so far. An epoch is the one before plus the batch's deltas; a
retried batch finds its state and its predecessor as they were, and writes the
same epoch again.

Order: commit, modification time, path, split start, place in the split. An
answer that arrives late (a file with an older commit) replaces nothing.
Truth is joined before the state (a static frame; videos without truth have no
answer that counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verdikt.functions.dialects import extract_labels
from verdikt.functions.labels import answer_number
from verdikt.operators.metrics import default_slices, mask_cols, metrics_from_histogram
from verdikt.operators.scoring import attach_truth, score_rows
from verdikt.session import child_folders, delete_path, path_exists
from verdikt.sources.logs import commit_of, parse_keyed_lines
from verdikt.streaming.ingest import KEYS, MAX_BYTES, query_id, stream_lines

ORDER = ["commit", "mtime", "path", "block", "place"]
ORDER_DDL = "commit long, mtime long, path string, block long, place long"

# Into how many groups the videos of a run are dealt: one call a group and batch.
# Fixed, since a video has to be found where it was stored.
BUCKETS = 256

# Keyed state with map entries lives in RocksDB; a commit writes a batch's changes,
# not the files that hold them.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _arrivals():
    """A number that grows from row to row of a task. (Streams don't have
    ``monotonically_increasing_id``; only the order within a split matters.)"""
    seen = [0]

    def arrival(status: pa.Array) -> pa.Array:
        seen[0] += len(status)
        return pa.array(range(seen[0] - len(status), seen[0]), pa.int64())

    arrival.__annotations__ = {"status": pa.Array, "return": pa.Array}
    return F.arrow_udf(arrival, "long").asNondeterministic()


def _replace(masks: list[str], run_keys: list[str]) -> StatefulProcessor:
    """State processor: the answers of a run's bucket of videos -> their change
    to the histogram. Each video's last answer is a map entry of its own, so a
    batch reads and writes the entries of the videos it brings. (The class lies
    in a function since Python workers needn't find this module.)"""
    given, cells = [*ORDER, *masks, "truth", "prediction"], [*masks, "_t", "_p"]
    width = len(ORDER)
    value_ddl = f"{ORDER_DDL}, {_cells_ddl(masks)}"

    class Replace(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getMapState("last", "video string", value_ddl)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for f in rows:
                new = {}
                for video, row in zip(f["video"].tolist(), zip(*(f[c].tolist() for c in given))):
                    if video not in new or row[:width] > new[video][:width]:
                        new[video] = row
                change = []
                for video, row in new.items():
                    old = self.last.getValue((video,))
                    if old is not None:
                        if row[:width] <= tuple(old[:width]):
                            continue
                        change.append((*key[:-1], *old[width:], -1))
                    self.last.updateValue((video,), row)
                    change.append((*key[:-1], *row[width:], 1))
                if change:
                    yield pd.DataFrame(change, columns=[*run_keys, *cells, "_n"])

    return Replace()


def _cells_ddl(masks: list[str]) -> str:
    return ", ".join(f"{m} long" for m in masks) + ", _t int, _p int"


def _epochs(spark: SparkSession, path: str) -> list[str]:
    return child_folders(spark, path) if path_exists(spark, path) else []


def ingest_running(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    truth: DataFrame,
    dialect: str = "greedy",
    key: str = "result",
    max_bytes_per_trigger: int = MAX_BYTES,
) -> None:
    """Take in all present files of ``folder`` and bring the metrics up to date.

    After batch ``n`` the histogram is in ``<table_path>/counts/epoch=<id>-<n>``
    and the metrics in ``<table_path>/metrics/epoch=<id>-<n>``, ``id`` being
    that of the stream's checkpoint. Only the last two histograms are kept:
    the last, and the one that a retry of it starts from.
    """
    masks = mask_cols(default_slices())
    lines = stream_lines(spark, folder, max_bytes_per_trigger)
    o = F.col("file_order")
    named = [commit_of(o.path).alias("commit"), F.unix_micros(o.mtime).alias("mtime"), o.path.alias("path"), o.block.alias("block")]
    rows = extract_labels(parse_keyed_lines(lines.select("model", "method", "line", *named)), dialect, key, line_col="line")
    rows = rows.where(F.col("line_status") == "ok").select(*KEYS, *ORDER[:-1], answer_number(F.col("raw_value")).alias("number"), _arrivals()(F.col("parse_status")).alias("place"))
    scored = score_rows(attach_truth(rows, truth), "wrong")
    scored = scored.select(*KEYS, *ORDER, *masks, F.col("true_label").cast("int").alias("truth"), F.col("predicted_label").cast("int").alias("prediction"))
    bucket = F.pmod(F.xxhash64("video"), F.lit(BUCKETS)).alias("bucket")
    changes = scored.select("*", bucket).groupBy(*KEYS[:2], "bucket").transformWithStateInPandas(
        _replace(masks, KEYS[:2]), f"model string, method string, {_cells_ddl(masks)}, _n int", "update", "none"
    )
    group = ["model", "method", *masks, "_t", "_p"]

    def add(batch: DataFrame, n: int) -> None:
        own = query_id(spark, checkpoint)
        counts = batch.groupBy(*group).agg(F.sum("_n").alias("_n"))
        if n:
            counts = counts.unionByName(spark.read.parquet(f"{table_path}/counts/epoch={own}-{n - 1:09d}")).groupBy(*group).agg(F.sum("_n").alias("_n"))
        path = f"{table_path}/counts/epoch={own}-{n:09d}"
        counts.where("_n <> 0").write.mode("overwrite").parquet(path)
        metrics = metrics_from_histogram(spark.read.parquet(path), ["model", "method"])
        metrics.write.mode("overwrite").parquet(f"{table_path}/metrics/epoch={own}-{n:09d}")
        for name in _epochs(spark, f"{table_path}/counts"):
            if name.startswith(f"epoch={own}-") and int(name.rpartition("-")[2]) < n - 1:
                delete_path(spark, f"{table_path}/counts/{name}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        q = changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()


def metrics_after(spark: SparkSession, table_path: str, checkpoint: str) -> DataFrame:
    """The metrics after the last batch of the stream with this checkpoint."""
    own = query_id(spark, checkpoint)
    last = max(n for n in _epochs(spark, f"{table_path}/metrics") if n.startswith(f"epoch={own}-"))
    return spark.read.parquet(f"{table_path}/metrics/{last}")
