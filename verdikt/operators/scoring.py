"""Scoring: name normalisation, join to ground truth, correctness, policies.

J2 name normalisation, J3 label mapping (via the truth source), J5 inner
equi-join, J6 correctness, J7 numeric coercion, J8 invalid-as-wrong and J9
invalid-as-negative policies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.labels import coerced, label_number, predicted_label, strip_media_suffix
from verdikt.operators.metrics import with_slice_masks


def attach_truth(
    preds: DataFrame,
    truth: DataFrame,
    video_col: str = "video",
) -> DataFrame:
    """J2 + J5: strip '.mp4' from the video key and inner-join the truth.

    Unmatched rows on either side are dropped; a duplicated title multiplies
    rows, as an equi-join does. Rows whose label text is unknown (no
    ``true_label``) are excluded. No join hint: the planner broadcasts the
    truth only under ``spark.sql.autoBroadcastJoinThreshold`` (AQE checks the
    real size again), otherwise a shuffle join is planned. Run
    after deduplication, the prediction side holds at most one row per
    (run, video), so no video key can be hot on a shuffle join either.
    """
    t = truth.select("title", "category", "label", "true_label").where(F.col("true_label").isNotNull())
    # Which slices a video is in depends on its truth row alone.
    t = with_slice_masks(t)
    p = preds.withColumn("video_name", strip_media_suffix(F.col(video_col)))
    return p.join(t, p["video_name"] == t["title"], "inner")


def score_rows(joined: DataFrame, policy: str | Column = "wrong", value_col: str = "raw_value", coerce: bool | Column = True) -> DataFrame:
    """J6 + J8 / J9: add ``pred_number``, ``predicted_label`` and ``accuracy``.

    ``policy`` is 'wrong', 'negative' or a column holding one of them per row
    (e.g. joined from the run matrix). ``coerce`` (J7, a flag or a column)
    reads fractions as numbers; without it they are invalid. Rows of
    :func:`verdikt.plans.evaluate.latest_labels` hold the number instead of
    the text.
    """
    num = label_number(F.col(value_col), coerce) if value_col in joined.columns else coerced(F.col("number"), coerce)
    df = joined.withColumn("pred_number", num)
    pol = policy
    df = df.withColumn("predicted_label", predicted_label(F.col("pred_number"), F.col("true_label"), pol))
    return df.withColumn("accuracy", (F.col("predicted_label") == F.col("true_label")).cast("int"))


def scored_output(scored: DataFrame, run_cols=("model", "method")) -> DataFrame:
    """K5 shape: one row per scored video."""
    return scored.select(
        *run_cols,
        F.col("video_name"),
        F.col("predicted_label"),
        F.col("title"),
        F.col("category"),
        F.col("label"),
        F.col("true_label"),
        F.col("accuracy"),
    )
