"""Ground truth (S4), rules (S5) and trim list (S6) scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.labels import truth_label


def with_truth_label(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``true_label`` (0/1, NULL for unknown label text)."""
    return df.withColumn("true_label", truth_label(F.col(label_col)))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Annotated CSV with at least Title, Category, Label columns.

    Read as text columns without schema inference (no extra pass over the
    file); only the needed columns are kept, so CSV column pruning applies.
    """
    df = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    df = df.select(
        F.col("`Title`").alias("title"),
        F.col("`Category`").alias("category"),
        F.col("`Label`").alias("label"),
    )
    return with_truth_label(df)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document holding ``{"rules": [...]}``; missing -> []."""
    df = spark.read.option("multiLine", "true").schema("rules ARRAY<STRING>").json(path)
    return df.select(F.coalesce(F.col("rules"), F.array().cast("array<string>")).alias("rules"))


MAX_RULES = 1000


def load_rules(spark: SparkSession, path: str) -> list[str]:
    """S5 for P5: the rules of one document as a list (at most ``MAX_RULES``:
    they are repeated whole in every second-pass prompt)."""
    rows = read_rules(spark, path).select(F.explode("rules")).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [r[0] for r in rows]


def rules_block(rules: DataFrame) -> DataFrame:
    """P5: the rules joined by newlines, one row."""
    return rules.select(F.array_join(F.col("rules"), "\n").alias("rules_text"))


def read_trim_list(spark: SparkSession, path: str) -> DataFrame:
    """Trim instructions ``No., Title, Time`` (signed seconds)."""
    df = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    return df.select(
        F.col("`No.`").try_cast("int").alias("no"),
        F.col("`Title`").alias("title"),
        F.col("`Time`").try_cast("double").alias("time"),
    )
