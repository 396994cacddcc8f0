"""Session helpers.

The library never hard-codes cluster settings: it only fills in defaults that
are unset, so a cluster's own configuration (shuffle partitions, checkpoint
directory, AQE thresholds) always wins.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Optional setting: into how many partitions derived inputs are dealt before
# heavy per-row work. Unset (the default on a cluster), scans stay as they are.
SCAN_PARTITIONS = "spark.verdikt.scanPartitions"

# Defaults applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "verdikt", scan_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("VERDIKT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SCAN_PARTITIONS, str(scan_partitions or shuffle_partitions))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set library defaults on an existing session where they are unset."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is; it
    is an error to leave it unset there. Only a local master, whose tasks share
    the driver's disk, gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="verdikt-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a folder or file exist, in whatever store the path names?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder; False if it can't be, as when ``new`` is there."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    # A rename onto a folder that is there would move into it.
    return not fs.exists(b) and fs.rename(a, b)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small new file; False if it is there. Of several writers one wins."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory())


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right below ``path`` (none if it isn't there)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
