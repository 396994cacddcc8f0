"""Dataset statistics (N1-N4): the numbers behind the dataset figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.config import CATEGORIES


def category_names(category: F.Column, names: Sequence[str] = CATEGORIES) -> F.Column:
    """The category names a (multi-valued) category text contains."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda x: F.coalesce(category.contains(x), F.lit(False)))


def label_by_category(truth: DataFrame, names: Sequence[str] = CATEGORIES) -> DataFrame:
    """Clips per (category, label); a clip counts once per category it names."""
    x = truth.select(F.explode(category_names(F.col("category"), names)).alias("category"), "label")
    return x.groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))


def duration_histogram(df: DataFrame, value_col: str, width: float = 10.0, buckets: int = 10, short_below: float = 80.0) -> DataFrame:
    """Fixed-width buckets (the last one open-ended) and the count of
    short clips per bucket."""
    v = F.col(value_col)
    b = F.least(F.greatest(F.floor(v / F.lit(width)), F.lit(0)), F.lit(buckets - 1)).cast("int")
    x = df.where(v.isNotNull()).select(b.alias("bucket"), v)
    return x.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v < F.lit(short_below)).alias("n_short"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def word_count(text: F.Column) -> F.Column:
    """Number of white-space separated words (runs of non-space)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def word_stats(df: DataFrame, text_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Words per text, summarised per group (exact median)."""
    x = df.select(*group_cols, word_count(F.col(text_col)).alias("words"))
    return x.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("words").alias("total_words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
        F.percentile(F.col("words"), F.lit(0.5)).alias("median_words"),
    )


def source_counts(df: DataFrame, source_col: str = "source") -> DataFrame:
    """Clips per source (e.g. public / private collection)."""
    return df.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
