"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdikt.session import SCAN_PARTITIONS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a scan over ``partitions`` tasks (round robin).

    For inputs of one row group, which Spark can't split, such as the small
    test tables. Only done when asked for, by argument or by the session
    setting ``spark.verdikt.scanPartitions``: the plan never depends on the
    size of the data. At scale leave both unset and size scans with
    ``spark.sql.files.maxPartitionBytes``. Call it after projecting the needed
    columns so only those are moved.
    """
    n = partitions or int(df.sparkSession.conf.get(SCAN_PARTITIONS, "0"))
    return df.repartition(n) if n else df
