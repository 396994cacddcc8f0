"""File order in 64 bits, fixed-width last-wins and slice masks."""

import os

import pytest
from pyspark.sql import functions as F

from verdikt.config import CATEGORIES
from verdikt.operators.dedup import last_wins
from verdikt.operators.metrics import MASK_BITS, sliced_metrics, with_slice_masks
from verdikt.plans import catalog
from verdikt.plans.evaluate import extract_from_lines, latest_labels
from verdikt.sources.logs import parse_keyed_lines, read_lines, run_from_path
from verdikt.streaming.ingest import write_log_files

LINES = "model string, method string, line string"


def log(spark, rows):
    return spark.createDataFrame([("m", "zeroshot", line) for line in rows], LINES)


def answers(spark, folder, **how):
    lines = read_lines(spark, folder, recursive=True, **how)
    lines = lines.select(run_from_path(F.col("file_path"), r"model=([^/]+)").alias("model"), run_from_path(F.col("file_path"), r"method=([^/]+)").alias("method"), "line", "line_order")
    return latest_labels(extract_from_lines(lines))


@pytest.mark.parametrize("limit", [200_000, 1])
def test_equal_times_keep_the_later_pass(spark, tmp_path, limit):
    folder = str(tmp_path / "log")
    for value in (0, 1, 0, 1):
        write_log_files(log(spark, [f'{{"v{i}": "{{\\"result\\": {value if i % 2 else 1 - value}}}"}}' for i in range(20)]).repartition(3), folder)
    for d, _, files in os.walk(folder):
        for f in files:
            os.utime(os.path.join(d, f), (1_700_000_000, 1_700_000_000))
    got = {r.video: r.number for r in answers(spark, folder, max_ranked=limit).collect()}
    assert got == {f"v{i}": float(i % 2) for i in range(20)}


def test_foreign_logs_rank_by_time_then_path(spark, tmp_path):
    d = tmp_path / "model=m" / "method=zeroshot"
    d.mkdir(parents=True)
    for name, value, at in (("z.jsonl", 0, 100), ("a.jsonl", 1, 200), ("b.jsonl", 2, 200)):
        p = d / name
        p.write_text("".join(f'{{"v": "{{\\"result\\": {value}}}"}}\n' for _ in range(3)))
        os.utime(p, (at, at))
    assert [r.number for r in answers(spark, str(tmp_path)).collect()] == [2.0]


def test_order_is_a_long_and_grows_within_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"k{i}": "x"}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = read_lines(spark, str(tmp_path)).orderBy("line_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == [f'{{"k{i}": "x"}}' for i in range(5000)]


def test_repeated_keys_of_a_line_leave_the_last(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2", "a": "3"}', 7)], "line string, line_order long")
    assert [(r.video, r.response, r.line_order) for r in parse_keyed_lines(df).collect()] == [("b", "2", 7), ("a", "3", 7)]


def test_fixed_width_last_wins_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([("k", 1, 2.0, True), ("k", 3, None, False), ("j", 2, 1.0, None)], "k string, o long, v double, b boolean")
    out = last_wins(df, ["k"], "o", ["v", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert {r.k: (r.v, r.b, r.n_versions) for r in out.collect()} == {"k": (None, False, 2), "j": (1.0, None, 1)}


def test_flagship_plan_has_no_sort_aggregate_and_no_slice_test_above_the_truth(spark, sf_dir):
    plan = catalog.QUERIES["sliced_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("Contains(category") == len(CATEGORIES) or plan.count("Contains") <= len(CATEGORIES) + 1


def test_masks_of_many_slices(spark):
    n = MASK_BITS + 9
    slices = [(f"s{i}", f"v % {i + 2} = 0", True) for i in range(n)]
    df = spark.range(500).selectExpr("'m' AS model", "'z' AS method", "id AS v", "CAST(id % 2 AS INT) AS true_label", "CAST(id % 3 AS INT) AS predicted_label")
    got = {r["slice"]: (r["n"], r["tp"], r["n_other"]) for r in sliced_metrics(df, slices=slices).collect()}
    for i in range(n):
        ids = [v for v in range(500) if v % (i + 2) == 0]
        assert got[f"s{i}"] == (len(ids), sum(v % 2 == 1 and v % 3 == 1 for v in ids), sum(v % 3 == 2 for v in ids))
    assert {"slice_mask_0", "slice_mask_1"} <= set(with_slice_masks(df, slices).columns)
