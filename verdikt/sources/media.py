"""Media inventory scans (S7 flat, S8 recursive).

``list_media`` uses the ``binaryFile`` source; only path, length and
modification time are selected, so column pruning keeps the file contents
unread. Its listing goes through the driver, which holds every path.

``walk_media`` lists in tasks: each round lists the folders that the round
before found, a task a share of them, and writes files and folders to the
shared folder. The driver sees one number a round (how many folders are left),
and there are as many rounds as the tree is deep.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.config import MEDIA_SUFFIXES
from verdikt.session import checkpoint_path


def _glob(suffixes: list[str]) -> str:
    return "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"


def list_media(
    spark: SparkSession, root: str, recursive: bool = False, suffixes: list[str] | None = None
) -> DataFrame:
    """Files under ``root`` ending in one of ``suffixes`` (case-sensitive).

    Columns: ``path`` (absolute URI), ``rel_path`` (relative to root, '/'
    separated), ``name`` (last path part), ``length``, ``modification_time``.
    """
    suffixes = suffixes or MEDIA_SUFFIXES
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffixes))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(root).select("path", "length", "modificationTime")
    root_norm = root.rstrip("/")
    # Paths come back as URIs (file:/...); cut everything up to the root.
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _escape(root_norm) + "/", "")
    return df.select(
        F.col("path"),
        rel.alias("rel_path"),
        F.substring_index(F.col("path"), "/", -1).alias("name"),
        F.col("length"),
        F.col("modificationTime").alias("modification_time"),
    )


def _escape(s: str) -> str:
    special = set(".^$*+?()[]{}|\\")
    return "".join("\\" + ch if ch in special else ch for ch in s)


LISTED = pa.schema([("rel_path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modification_time", pa.timestamp("us", "UTC"))])


def _list_folders(root: str, patterns: list[str]):
    """Folders below ``root`` (batches of their relative paths) -> what is right in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = []
                for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base)):
                    name = info.base_name
                    is_folder = info.type == pafs.FileType.Directory
                    if is_folder or any(fnmatchcase(name, p) for p in patterns):
                        at = None if info.mtime_ns is None else datetime.fromtimestamp(info.mtime_ns // 1000 / 1e6, UTC)
                        rows.append((f"{folder}/{name}" if folder else name, is_folder, None if is_folder else info.size, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(LISTED)], schema=LISTED)

    return run


def walk_media(spark: SparkSession, root: str, recursive: bool = True, suffixes: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Files below ``root`` ending in one of ``suffixes`` (case-sensitive), listed
    by tasks: ``rel_path``, ``name``, ``length``, ``modification_time``. Hidden
    folders and files, and empty files, are listed like any other."""
    patterns = ["*." + s.lstrip(".") for s in suffixes or MEDIA_SUFFIXES]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base, depth = checkpoint_path(spark, f"walk-{uuid.uuid4().hex}"), 0
    frontier, left = spark.createDataFrame([("",)], "rel_path string"), 1
    while left:
        dealt = frontier.repartition(partitions) if left > 1 else frontier
        found = dealt.mapInArrow(_list_folders(root.rstrip("/"), patterns), "rel_path string, folder boolean, length long, modification_time timestamp")
        found.write.parquet(f"{base}/depth={depth}")
        frontier = spark.read.schema("rel_path string, folder boolean").parquet(f"{base}/depth={depth}").where("folder").select("rel_path")
        left = frontier.count() if recursive else 0
        depth += 1
    files = spark.read.schema("rel_path string, folder boolean, length long, modification_time timestamp").parquet(base).where("not folder")
    return files.select("rel_path", F.substring_index("rel_path", "/", -1).alias("name"), "length", "modification_time")
