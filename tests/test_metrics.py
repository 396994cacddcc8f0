"""Sliced metrics: golden values, properties and empty-slice defaults.

The golden counts and ratios are fixed values: published example results that
the metrics must reproduce.
"""

import pytest

from verdikt.operators.metrics import default_slices, sliced_metrics


def expand(spark, cells, label="Normal", category="Security"):
    """cells: list of (true_label, predicted_label, count, label_text, category)."""
    rows = []
    i = 0
    for t, p, n, lab, cat in cells:
        for _ in range(n):
            rows.append(("m", "zeroshot", f"v{i}", t, p, lab, cat))
            i += 1
    return spark.createDataFrame(rows, "model string, method string, video_name string, true_label int, predicted_label int, label string, category string")


def by_slice(df):
    return {r["slice"]: r for r in df.collect()}


def test_golden_all_and_clear(spark):
    # Worked example: all [[472, 82], [248, 401]]; clear [[472, 82], [191, 367]].
    # Vague rows are all positives: 57 missed, 34 found.
    cells = [
        (0, 0, 472, "Normal", "Security"),
        (0, 1, 82, "Normal", "Security"),
        (1, 0, 191, "Abnormal", "Security"),
        (1, 1, 367, "Abnormal", "Security"),
        (1, 0, 57, "Vague Abnormal", "Wildlife"),
        (1, 1, 34, "Vague Abnormal", "Wildlife"),
    ]
    out = by_slice(sliced_metrics(expand(spark, cells)))
    a = out["all"]
    assert (a.tn, a.fp, a.fn, a.tp) == (472, 82, 248, 401)
    assert round(a.accuracy_abnormal, 2) == 0.62
    assert round(a.accuracy_normal, 2) == 0.85
    assert round(a.overall_accuracy, 2) == 0.73
    assert round(a.precision, 2) == 0.83
    assert round(a.recall, 2) == 0.62
    assert round(a.f1, 2) == 0.71
    c = out["clear"]
    assert (c.tn, c.fp, c.fn, c.tp) == (472, 82, 191, 367)
    assert (round(c.accuracy_abnormal, 2), round(c.accuracy_normal, 2), round(c.overall_accuracy, 2)) == (0.66, 0.85, 0.75)
    assert (round(c.precision, 2), round(c.recall, 2), round(c.f1, 2)) == (0.82, 0.66, 0.73)
    v = out["vague"]
    assert v.n == 91 and round(v.overall_accuracy, 2) == 0.37


@pytest.mark.parametrize(
    "name,tn,fp,fn,tp,expect",
    [
        ("Baby Monitoring", 18, 1, 2, 8, (0.80, 0.95, 0.90, 0.89, 0.80, 0.84)),
        ("Security", 290, 65, 69, 168, (0.71, 0.82, 0.77, 0.72, 0.71, 0.71)),
    ],
)
def test_golden_categories(spark, name, tn, fp, fn, tp, expect):
    cells = [(0, 0, tn, "Normal", name), (0, 1, fp, "Normal", name), (1, 0, fn, "Abnormal", name), (1, 1, tp, "Abnormal", name)]
    r = by_slice(sliced_metrics(expand(spark, cells)))[name]
    got = tuple(round(x, 2) for x in (r.accuracy_abnormal, r.accuracy_normal, r.overall_accuracy, r.precision, r.recall, r.f1))
    assert got == expect


def test_every_slice_present_with_defaults(spark):
    cells = [(1, 1, 3, "Abnormal", "Security, Pet Monitoring"), (0, 2, 1, "Normal", "Security")]
    out = by_slice(sliced_metrics(expand(spark, cells)))
    assert set(out) == {s[0] for s in default_slices()}
    # overlapping categories: the same rows count in both slices
    assert out["Security"].n == 4 and out["Pet Monitoring"].n == 3
    # an empty category slice: zero counts, 0.0 ratios (the reference default)
    e = out["Wildlife"]
    assert (e.n, e.tp, e.overall_accuracy, e.precision, e.f1) == (0, 0, 0.0, 0.0, 0.0)
    # an empty non-category slice: NULL overall accuracy
    assert out["vague"].n == 0 and out["vague"].overall_accuracy is None
    # a label outside {0, 1} is counted in n_other, never in the matrix
    s = out["Security"]
    assert s.n_other == 1 and s.tn + s.fp + s.fn + s.tp + s.n_other == s.n


def test_accuracy_abnormal_equals_recall_when_binary(spark):
    cells = [(0, 0, 5, "Normal", "x"), (0, 1, 2, "Normal", "x"), (1, 0, 3, "Abnormal", "x"), (1, 1, 7, "Abnormal", "x")]
    a = by_slice(sliced_metrics(expand(spark, cells)))["all"]
    assert a.accuracy_abnormal == a.recall


def test_one_shuffle_plan(spark):
    cells = [(0, 0, 2, "Normal", "Security"), (1, 1, 2, "Abnormal", "Wildlife")]
    df = sliced_metrics(expand(spark, cells))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The histogram, then the sums over its few rows: nothing is shuffled before
    # it is aggregated, and membership is no work above the masks.
    assert plan.count("Exchange") <= 2 and plan.count("HashAggregate") == 4
    above = plan[: plan.index("slice_mask_0")] if "slice_mask_0" in plan else plan
    assert "Contains" not in above and "SortAggregate" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
