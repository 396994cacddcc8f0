"""The model x method grid: scans per run, the matrix as given, runs it doesn't list."""

import json

import pytest
from pyspark.sql import functions as F

from verdikt.config import RUN_MATRIX, run_matrix
from verdikt.plans.evaluate import evaluate_grid, extract_grid, unknown_runs

LINES = "model string, method string, line string, line_order long"
TRUTH = "title string, category string, label string, true_label int"


def lines(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LINES)


def keyed(video, text):
    return json.dumps({video: text})


def test_each_run_is_read_by_its_scan(spark):
    rows = [
        ("Flash", "zeroshot", keyed("a.mp4", '{"result": 1}')),
        ("Flash", "icl", '{"b.mp4": "broken \\"anomaly\\": 0, and no end'),
        ("VILA", "zeroshot", json.dumps({"id": "c.mp4", "truth": 1, "pred": '{"result": 0}'})),
        ("VILA", "cot", json.dumps({"id": "d.mp4", "pred": "I think anomaly: 1"})),
        ("VILA", "cot", json.dumps({"id": "e.mp4", "pred": ""})),
        ("VILA", "zeroshot", json.dumps({"pred": '{"result": 1}'})),
        ("GPT", "cot", "no json"),
    ]
    got = {(r.model, r.video): (r.raw_value, r.line_status) for r in extract_grid(lines(spark, rows)).collect()}
    assert got == {
        ("Flash", "a.mp4"): ("1", "ok"),
        ("Flash", "b.mp4"): ("0", "ok"),
        ("VILA", "c.mp4"): ("0", "ok"),
        ("VILA", "d.mp4"): ("1", "ok"),
        ("VILA", "NAN"): ("1", "ok"),
        ("GPT", None): (None, "bad_line"),
    }


def test_unknown_runs_are_not_dropped_silently(spark):
    df = lines(spark, [("Flash", "zeroshot", keyed("a", '{"result": 1}')), ("Other", "zeroshot", keyed("a", '{"result": 1}'))])
    with pytest.raises(Exception, match="run not in the matrix: Other / zeroshot"):
        extract_grid(df).collect()
    got = {r.model: r.line_status for r in extract_grid(df, unknown="report").collect()}
    assert got == {"Flash": "ok", "Other": "unknown_run"}
    assert [(r.model, r.lines) for r in unknown_runs(df).collect()] == [("Other", 1)]


def test_a_given_matrix_decides_dialects_keys_and_coercion(spark):
    m = run_matrix(spark, [("A", "zeroshot", "regex", False, "wrong")]).withColumn("answer_key", F.lit("verdict"))
    m = m.unionByName(run_matrix(spark, [("B", "zeroshot", "greedy", True, "wrong"), ("C", "zeroshot", "greedy", False, "wrong")]))
    truth = spark.createDataFrame([("v", "Security", "Normal", 0)], TRUTH)
    df = lines(spark, [("A", "zeroshot", keyed("v", "verdict: 0")), ("B", "zeroshot", keyed("v", '{"result": 0.9}')), ("C", "zeroshot", keyed("v", '{"result": 0.9}'))])
    got = {r.model: (r.pred_number, r.predicted_label, r.accuracy) for r in evaluate_grid(df, truth, m).collect()}
    # a fraction is read as 0 with coercion and is invalid (wrong) without it
    assert got == {"A": (0.0, 0, 1), "B": (0.9, 0, 1), "C": (None, 1, 0)}


def test_all_runs_of_the_matrix_have_a_scan(spark):
    rows = run_matrix(spark).collect()
    assert len(rows) == len(RUN_MATRIX) == 29
    assert {r.scan for r in rows} == {"keyed", "raw", "idpred", "idpred_drop"}
    assert all((r.scan == "raw") == (r.dialect == "rawline") for r in rows)


def test_vote_for_other_labels_is_not_a_vote_for_one(spark):
    from verdikt.operators.metrics import majority_vote

    rows = [("z", "v", 2, 0), ("z", "v", 0, 0), ("z", "v", 0, 0)]
    r = majority_vote(spark.createDataFrame(rows, "method string, video_name string, predicted_label int, true_label int")).first()
    assert (r.votes_abnormal, r.vote, r.accuracy) == (0, 0, 1)


def test_explicit_null_is_not_a_missing_member(spark):
    from verdikt.functions.dialects import with_chain_record

    rows = [('{"anomaly": null}',), ('{"video_description": null}',), ("{}",), ("broken",), (None,)]
    got = [tuple(r.record) for r in with_chain_record(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == [("NAN", "NAN", None, True), (None, "NAN", "0", True), ("NAN", "NAN", "0", True), ("NAN", "NAN", "0", False), ("NAN", "NAN", "0", False)]
