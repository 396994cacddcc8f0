"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.session import apply_defaults, checkpoint_path, delete_path

# Rows per Arrow batch sent to Python workers: whole texts travel in these
# batches, so the row count is kept low enough for long documents.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the Arrow operators rely on."""
    apply_defaults(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder of ``spark.checkpoint.dir``."""
    return checkpoint_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


# Remove a job's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs no recomputation of what lies before. Digests and
    fingerprints are hexadecimal text, which zstd halves. A written table needs
    its shuffle files no more, so they go with the job."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``saved`` that no later plan reads."""
    for t in tables:
        delete_path(t.sparkSession, t._saved_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``_row``, so that columns an operator adds
    can never clash with columns of its input. ``unpacked`` undoes it."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def utf8(a: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string array, without decoding them."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    return a.cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary()).to_pylist()


def arrow_udf(fn, kind):
    """An Arrow UDF that is evaluated once a row. The optimiser may repeat a
    deterministic UDF for every field and filter that refers to its result."""
    fn.__annotations__ = {**{n: pa.Array for n in fn.__code__.co_varnames[: fn.__code__.co_argcount]}, "return": pa.Array}
    return F.arrow_udf(fn, kind).asNondeterministic()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 8) -> DataFrame:
    """``big`` left join ``small`` (unique on ``keys``) where one key may hold a
    large share of ``big``: a salt from the row spreads the key over ``salts``
    tasks. Both sides get an exchange of their own, so adaptive execution may
    split what is still uneven."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[col(c) for c in big.columns]), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
