"""Sinks (K1-K7).

Responses are appended as Parquet partitioned by run, which replaces the
unsynchronised JSONL appends of a thread pool; a JSONL export in the same
one-object-per-line shape is available for tools that expect it. Scored rows
go to one partitioned table, so one run can no longer overwrite another's
output file.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdikt.session import child_files, create_file, delete_path


def append_responses(df: DataFrame, path: str, partition_cols: Sequence[str] = ("model", "method")) -> None:
    """K1 / K4: append scored responses, partitioned by run."""
    df.write.mode("append").partitionBy(*partition_cols).parquet(path)


def append_once(df: DataFrame, path: str, run: str, attempt: int = 0, partition_cols: Sequence[str] = ("model", "method")) -> bool:
    """K1 / K4 exactly once: the rows of (run, attempt) become part of the table
    at ``path`` by one file in its ``manifest`` folder, which names the folder
    they were written to. False if they are part of it already: a job that is run
    again writes nothing, and of two that race one publishes, the other drops
    what it staged. A job that dies leaves files that nothing names.
    Read with :func:`read_appended`."""
    spark = df.sparkSession
    name = quote(f"{run}-{attempt}", safe="")
    if name in child_files(spark, f"{path}/manifest"):
        return False
    data = uuid.uuid4().hex
    df.write.partitionBy(*partition_cols).parquet(f"{path}/data/{data}")
    published = create_file(spark, f"{path}/manifest/{name}", data)
    if not published:
        delete_path(spark, f"{path}/data/{data}")
    return published


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``append_once`` published, and nothing else. (Manifests are one
    short line for each run and attempt.)"""
    if not child_files(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    names = [r["value"] for r in spark.read.text(f"{path}/manifest").collect()]
    parts = [spark.read.schema(schema).option("basePath", f"{path}/data/{n}").parquet(f"{path}/data/{n}") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*schema.fieldNames())


def export_jsonl(df: DataFrame, path: str, key_col: str = "video", value_col: str = "response") -> None:
    """K1 JSONL form: one ``{video: response}`` object per line."""
    df.select(F.to_json(F.create_map(F.col(key_col), F.col(value_col))).alias("value")).write.mode("append").text(path)


ROWS_PER_DOCUMENT = 1000


def snapshot_list(df: DataFrame, path: str, rows: int = ROWS_PER_DOCUMENT) -> None:
    """K2: a snapshot as JSON arrays of [video, response] pairs, one array of
    at most ``rows`` pairs a line, so no document gathers all rows."""
    docs = _chunks(df, rows).agg(F.collect_list(F.array("video", "response")).alias("pairs"))
    docs.select(F.to_json("pairs", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def snapshot_object(df: DataFrame, path: str, rows: int = ROWS_PER_DOCUMENT) -> None:
    """K3: a snapshot as flat JSON objects ``{video: response, ...}`` of at
    most ``rows`` members a line. ``df`` holds one row per video."""
    docs = _chunks(df, rows).agg(F.map_from_entries(F.collect_list(F.struct("video", "response"))).alias("members"))
    docs.select(F.to_json("members", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _chunks(df: DataFrame, rows: int):
    n = F.monotonically_increasing_id()
    # Partition and place in it: a chunk never crosses partitions.
    return df.select("video", "response", F.floor(n / F.lit(rows)).alias("_chunk")).groupBy("_chunk")


def write_scored(df: DataFrame, path: str, partition_cols: Sequence[str] = ("model", "method"), fmt: str = "parquet") -> None:
    """K5: scored rows, one partition per run (dynamic overwrite of the
    touched runs only)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols)
        .format(fmt)
        .option("header", "true")
        .save(path)
    )


def dump_records(df: DataFrame, path: str, cols: Sequence[str] = ("video", "video_description", "reasoning", "anomaly")) -> None:
    """K7: extracted chain records as CSV for inspection. Texts are whole: every
    value is quoted, quotes are doubled, line breaks stay inside the quotes and
    a null is told from an empty text. Read with :func:`read_records`."""
    df.select(*cols).write.mode("overwrite").options(header="true", quoteAll="true", **_CSV).csv(path)


# A null is written as this text, which no record holds by itself.
_CSV = {"escape": '"', "nullValue": "\\N", "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`dump_records` wrote (records may span lines)."""
    return spark.read.schema(schema).options(header="true", multiLine="true", **_CSV).csv(path)
