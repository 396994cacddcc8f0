"""Batched scoring, failure policy, resume and replay."""

import pandas as pd
from pyspark.sql import functions as F

import pytest

from verdikt.operators.inference import latency_stats, pending, replay, score_batches
from verdikt.plans.fixtures import keyword_scorer


def _requests(spark, n=25):
    rows = [("m", "zeroshot", f"v{i}.mp4", "the cat" if i % 2 else "a dog") for i in range(n)]
    return spark.createDataFrame(rows, "model string, method string, video string, prompt string")


def test_score_batches(spark):
    out = score_batches(_requests(spark), keyword_scorer(["cat"]), batch_size=4, partitions=3).collect()
    assert len(out) == 25
    got = {r.video: r.response for r in out}
    assert got["v1.mp4"] == '{"result": 1}' and got["v0.mp4"] == '{"result": 0}'
    assert all(r.error is None and r.latency_s >= 0 for r in out)


def test_failure_policy(spark):
    def boom(pdf: pd.DataFrame):
        if (pdf["video"] == "v3.mp4").any():
            raise RuntimeError("rate limited")
        return ['{"result": 0}'] * len(pdf)

    out = score_batches(_requests(spark, 8), boom, batch_size=2).collect()
    failed = [r for r in out if r.error]
    assert failed and all(r.response is None for r in failed)
    assert any(r.video == "v3.mp4" for r in failed)


def test_resume_and_replay(spark):
    req = _requests(spark, 6)
    log = score_batches(req.where(F.col("video").isin("v0.mp4", "v1.mp4")), keyword_scorer(["cat"]))
    todo = pending(req, log)
    assert sorted(r.video for r in todo.collect()) == ["v2.mp4", "v3.mp4", "v4.mp4", "v5.mp4"]
    full = log.unionByName(score_batches(todo, keyword_scorer(["cat"])))
    assert pending(req, full).count() == 0  # a second run scores nothing
    r = replay(req, log).collect()
    assert sum(x.answered for x in r) == 2


def test_rate_limit_holds_over_all_tasks(spark):
    import time

    req = _requests(spark, 32)
    t0 = time.time()
    out = score_batches(req, keyword_scorer(["cat"]), batch_size=1, partitions=4, max_rps=8.0).collect()
    # 32 requests at 8 a second: 4 s, less the call each task starts with.
    assert len(out) == 32 and time.time() - t0 >= 3.0
    with pytest.raises(ValueError, match="partitions"):
        score_batches(req, keyword_scorer(["cat"]), max_rps=8.0)


def test_failure_policies(spark):
    def boom(pdf: pd.DataFrame):
        if (pdf["video"] == "v3.mp4").any():
            raise RuntimeError("rate limited")
        return ['{"result": 0}'] * len(pdf)

    req = _requests(spark, 8).coalesce(1)
    null = {r.video: r for r in score_batches(req, boom, per_request=True).collect()}
    assert [v for v, r in null.items() if r.error] == ["v3.mp4"] and null["v3.mp4"].response is None
    text = {r.video: r for r in score_batches(req, boom, per_request=True, on_error="text").collect()}
    assert text["v3.mp4"].response == text["v3.mp4"].error == "RuntimeError: rate limited"
    with pytest.raises(Exception, match="rate limited"):
        score_batches(req, boom, on_error="raise").collect()
    with pytest.raises(ValueError):
        score_batches(req, boom, on_error="ignore")


def test_latency_is_timed_per_request(spark):
    import time

    def slow(pdf: pd.DataFrame):
        time.sleep(0.2 if (pdf["video"] == "v1.mp4").any() else 0.0)
        return ["x"] * len(pdf)

    got = {r.video: r.latency_s for r in score_batches(_requests(spark, 4).coalesce(1), slow, per_request=True).collect()}
    assert got["v1.mp4"] >= 0.2 and max(v for k, v in got.items() if k != "v1.mp4") < 0.1


def test_latency_quantiles_on_the_grid(spark):
    rows = [("m", i / 1000.0) for i in range(1, 101)] + [("n", 5.0004)] * 7 + [("o", None)]
    got = {r.model: r for r in latency_stats(spark.createDataFrame(rows, "model string, latency_s double"), ["model"]).collect()}
    assert (got["m"].n, got["m"].p50_s, got["m"].p90_s, got["m"].max_s) == (100, 0.05, 0.09, 0.1)
    assert (got["n"].p50_s, got["n"].p90_s, got["n"].avg_s) == (5.0, 5.0, 5.0004) and "o" not in got


def test_failed_calls_are_pending(spark):
    log = spark.createDataFrame([("m", "zeroshot", "v0.mp4", None, "TimeoutError"), ("m", "zeroshot", "v1.mp4", "x", None)], "model string, method string, video string, response string, error string")
    assert [r.video for r in pending(_requests(spark, 2), log).collect()] == ["v0.mp4"]


def test_shared_rate_of_skewed_tasks(spark):
    """One task has nearly all requests: it gets the rate of those that are done."""
    from verdikt.operators.inference import score_batches

    rows = [("hot" if i % 20 else f"cold{i}", "z", f"v{i}", "x") for i in range(240)]
    req = spark.createDataFrame(rows, "model string, method string, video string, prompt string")
    # Timed by the calls themselves: what Spark needs to start is no part of the rate.
    out = score_batches(req, lambda pdf: ["y"] * len(pdf), batch_size=1, partitions=4, max_rps=20.0, deal_by=["model"]).collect()
    at = sorted(r.scored_at for r in out)
    assert len(out) == 240
    # Within 20 %; a quarter of the rate, which is what the task had before, would take 46 s.
    assert 11.95 * 0.8 <= at[-1] - at[0] <= 11.95 * 1.25
    # No second has more than the rate allows, but for each task's first call.
    assert all(sum(a <= t < a + 1 for t in at) <= 24 for a in at)


def test_shared_rate_with_empty_tasks(spark):
    from verdikt.operators.inference import score_batches

    req = spark.createDataFrame([("m", "z", "v", "x")], "model string, method string, video string, prompt string")
    assert score_batches(req, lambda pdf: ["y"] * len(pdf), partitions=5, max_rps=100.0).count() == 1
    assert score_batches(req.limit(0), lambda pdf: ["y"] * len(pdf), partitions=3, max_rps=100.0).count() == 0
