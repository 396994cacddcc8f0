"""Plan guards for the flagship (S1 -> A8): shuffles, broadcast, no Python."""

import re

from verdikt.plans import catalog

SMALL = "/root/testdata/sf0.001"


def _final_plan(df):
    df.collect()  # run it so the adaptive plan is final
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_flagship_plan(spark):
    plan = _final_plan(catalog.QUERIES["sliced_metrics"](spark, SMALL))
    hash_exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # dedup on (model, method, video), the histogram on (model, method, mask,
    # truth, prediction) and the sums over its few rows on (model, method)
    assert len(hash_exchanges) == 3, hash_exchanges
    assert "SortAggregate" not in plan
    assert any("video" in e for e in hash_exchanges)
    assert "BroadcastHashJoin" in plan  # truth (and the labels dimension) broadcast
    assert "SortMergeJoin" not in plan
    for python_node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF"):
        assert python_node not in plan
    # the answer text does not cross the dedup shuffle
    dedup_in = plan.split("Exchange hashpartitioning(model")[1].split("\n")[0]
    assert "response" not in dedup_in


def test_leaderboard_one_pass(spark):
    plan = _final_plan(catalog.QUERIES["leaderboard"](spark, SMALL))
    # one scan of the documents for all 29 runs
    assert plan.count("documents.parquet") == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3


def test_idpred_lines_are_parsed_once(spark):
    plan = _final_plan(catalog.QUERIES["idpred_metrics"](spark, SMALL))
    # one parse of the line and one of the strict answer
    assert plan.count("from_json") <= 4


def test_frames_are_chosen_before_they_are_encoded(spark):
    plan = _final_plan(catalog.QUERIES["request_blocks"](spark, SMALL))
    below = plan.split("Exchange hashpartitioning(video")[1:]
    assert below and all("base64" not in line for p in below for line in p.split("\n")[0:1])
    uri = _final_plan(catalog.QUERIES["prompts"](spark, SMALL))
    assert "Join" not in uri
