"""Binary classification metrics over overlapping slices (A1-A8) and the
aggregates around them (A9 chain shift, A10 majority vote, A11 parse quality).

Slices overlap (a video can be in several categories), which rules out
GROUPING SETS. Membership is a property of the truth row, so it is decided
once there, as a bit mask (``with_slice_masks``). Metrics are two aggregations:
a histogram by run, mask, truth and prediction (all of fixed width, one row a
combination and map partition in the shuffle), and per-slice sums over its few
rows, unpivoted with ``inline``. Every slice therefore appears for every run,
with zero counts when it is empty, without a join against a slice dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.config import CATEGORIES, CLEAR_LABELS, VAGUE_LABELS
from verdikt.functions.sqltext import lit


def default_slices(categories: Sequence[str] = CATEGORIES) -> list[tuple[str, str, bool]]:
    """(name, membership predicate, is_category) for all/clear/vague + categories.

    Predicates are SQL text over ``label`` / ``category`` (a Column works as
    well). Category membership is a substring test on the category text.
    """
    clear = ", ".join(lit(x) for x in CLEAR_LABELS)
    vague = ", ".join(lit(x) for x in VAGUE_LABELS)
    out = [
        ("all", "true", False),
        ("clear", f"label IN ({clear})", False),
        ("vague", f"label IN ({vague})", False),
    ]
    for c in categories:
        out.append((c, f"coalesce(contains(category, {lit(c)}), false)", True))
    return out


MASK_BITS = 62


def mask_col(k: int) -> str:
    return f"slice_mask_{k}"


def mask_cols(slices: Sequence) -> list[str]:
    """Mask columns of as many slices: one for each ``MASK_BITS``."""
    return [mask_col(k) for k in range(-(-len(slices) // MASK_BITS))]


def with_slice_masks(df: DataFrame, slices: list[tuple[str, Column, bool]] | None = None) -> DataFrame:
    """Add the slices that a row is in, as bits of 64-bit masks."""
    slices = slices if slices is not None else default_slices()
    out = {}
    for k, name in enumerate(mask_cols(slices)):
        bits = []
        for i, (_, member, _) in enumerate(slices[k * MASK_BITS : (k + 1) * MASK_BITS]):
            member = F.expr(member) if isinstance(member, str) else member
            bits.append(F.when(member, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        out[name] = mask
    return df.withColumns(out)


def _ratio(num: Column, den: Column, empty: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(empty)


def metrics_from_counts(df: DataFrame) -> DataFrame:
    """A1-A7 from confusion counts (tn, fp, fn, tp, pos_other, neg_other).

    Empty denominators give 0.0 (sklearn's zero_division=0); overall
    accuracy of an empty slice is 0.0 for category slices (the reference's
    default) and NULL otherwise.
    """
    tn, fp, fn, tp = F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")
    pos = tp + fn + F.col("pos_other")
    neg = tn + fp + F.col("neg_other")
    n = pos + neg
    zero = F.lit(0.0)
    empty_overall = F.when(F.col("is_category"), zero).otherwise(F.lit(None).cast("double"))
    return df.select(
        *[c for c in df.columns if c not in ("tn", "fp", "fn", "tp", "pos_other", "neg_other", "is_category")],
        n.alias("n"),
        (F.col("pos_other") + F.col("neg_other")).alias("n_other"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
        (tn + tp).alias("correct"),
        _ratio(tp, pos, zero).alias("accuracy_abnormal"),
        _ratio(tn, neg, zero).alias("accuracy_normal"),
        _ratio(tn + tp, n, empty_overall).alias("overall_accuracy"),
        _ratio(tp, tp + fp, zero).alias("precision"),
        _ratio(tp, tp + fn, zero).alias("recall"),
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn, zero).alias("f1"),
    )


def sliced_metrics(
    scored: DataFrame,
    group_cols: Sequence[str] = ("model", "method"),
    slices: list[tuple[str, Column, bool]] | None = None,
    truth_col: str = "true_label",
    pred_col: str = "predicted_label",
) -> DataFrame:
    """Metrics for every (run, slice) in one aggregation.

    ``scored`` needs ``true_label``, ``predicted_label`` and either the slice
    masks of :func:`with_slice_masks` or ``label`` and ``category``. Output:
    group columns, ``slice``, counts and the six ratios.
    """
    if slices is not None or mask_col(0) not in scored.columns:
        scored = with_slice_masks(scored, slices)
    slices = slices if slices is not None else default_slices()
    masks = mask_cols(slices)
    hist = scored.groupBy(*group_cols, *masks, F.col(truth_col).alias("_t"), F.col(pred_col).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return metrics_from_histogram(hist, group_cols, slices)


CELLS = {
    "tn": "_t = 0 AND _p = 0",
    "fp": "_t = 0 AND _p = 1",
    "fn": "_t = 1 AND _p = 0",
    "tp": "_t = 1 AND _p = 1",
    "pos_other": "_t = 1 AND _p NOT IN (0, 1)",
    "neg_other": "_t = 0 AND _p NOT IN (0, 1)",
}


def metrics_from_histogram(hist: DataFrame, group_cols: Sequence[str], slices: list[tuple[str, Column, bool]] | None = None) -> DataFrame:
    """Metrics from rows (group columns, masks, ``_t``, ``_p``, ``_n``): per
    combination of slices, truth and prediction how many answers there are."""
    slices = slices if slices is not None else default_slices()
    # SQL text per aggregate: one expression object per aggregate instead of
    # a tree of small Column calls (plan building stays cheap with 60 of them).
    aggs = []
    for i in range(len(slices)):
        inside = f"{mask_col(i // MASK_BITS)} & {1 << i % MASK_BITS}L <> 0"
        for cell, cond in CELLS.items():
            aggs.append(F.expr(f"coalesce(sum(CASE WHEN {inside} AND {cond} THEN _n END), 0L) AS s{i}_{cell}"))
    wide = hist.groupBy(*group_cols).agg(*aggs)
    structs = []
    for i, (name, _, is_cat) in enumerate(slices):
        fields = ", ".join(f"'{c}', s{i}_{c}" for c in CELLS)
        structs.append(f"named_struct('slice', {lit(name)}, 'is_category', {str(is_cat).lower()}, {fields})")
    long = wide.select(*group_cols, F.inline(F.expr("array(" + ", ".join(structs) + ")")))
    return metrics_from_counts(long)


def parse_quality(df: DataFrame, group_cols: Sequence[str] = ("model", "method"), status_col: str = "parse_status") -> DataFrame:
    """How many answers ended in each parse status, per run."""
    return df.groupBy(*group_cols, status_col).agg(F.count(F.lit(1)).alias("n"))


def majority_vote(
    scored: DataFrame,
    group_cols: Sequence[str] = ("method",),
    video_col: str = "video_name",
    tie: int = 1,
) -> DataFrame:
    """A10: per (method, video) whether most runs predicted label 1.

    A label outside {0, 1} is a vote, but not one for 1. A tie (even number of
    voters split evenly) resolves to ``tie``.
    """
    agg = scored.groupBy(*group_cols, video_col).agg(
        F.count(F.lit(1)).alias("voters"),
        F.count_if(F.col("predicted_label") == 1).alias("votes_abnormal"),
        F.max("true_label").alias("true_label"),  # one truth per video
    )
    vote = (
        F.when(F.col("votes_abnormal") * 2 > F.col("voters"), F.lit(1))
        .when(F.col("votes_abnormal") * 2 < F.col("voters"), F.lit(0))
        .otherwise(F.lit(tie))
    )
    return agg.withColumn("vote", vote).withColumn("accuracy", (F.col("vote") == F.col("true_label")).cast("int"))


def chain_shift(
    pass1: DataFrame,
    pass2: DataFrame,
    keys: Sequence[str] = ("model", "video"),
    label1: str = "label_1",
    label2: str = "label_2",
) -> DataFrame:
    """How first-pass labels moved in the second pass.

    Both sides are one row per key (after last-wins), so the join is
    one-to-one; the count is grouped by the (before, after) pair.
    """
    j = pass1.select(*keys, label1).join(pass2.select(*keys, label2), list(keys), "full_outer")
    return j.groupBy(*[k for k in keys if k != "video"], label1, label2).agg(F.count(F.lit(1)).alias("n"))


def truth_quality(truth: DataFrame, title_col: str = "title") -> DataFrame:
    """A11 for the ground truth: rows, distinct titles, titles that appear more
    than once (they multiply joined rows) and rows with unknown label text
    (left out of the metrics). One row; two aggregations, both partial."""
    per_title = truth.groupBy(title_col).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("true_label").isNull()).alias("unlabelled"),
    )
    return per_title.agg(
        F.sum("copies").alias("rows"),
        F.count(F.lit(1)).alias("titles"),
        F.count_if(F.col("copies") > 1).alias("duplicate_titles"),
        F.sum("unlabelled").alias("unlabelled_rows"),
    )
