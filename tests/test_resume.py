"""The resume store: what is stored stays where it lies."""

import re

import pytest
from pyspark.sql import functions as F

from verdikt.operators.inference import score_batches
from verdikt.plans.resume import ResumeStore

KEYS = ["model", "method", "video"]


def requests(spark, n, start=0):
    return spark.range(start, n).select(F.lit("m").alias("model"), F.lit("z").alias("method"), F.concat(F.lit("v"), "id").alias("video"), F.col("id").cast("string").alias("prompt"))


def failing(every):
    def score(pdf):
        if (pdf["prompt"].astype(int) % every == 0).any():
            raise ValueError("no")
        return [f"{every}:{p}" for p in pdf["prompt"]]

    return score


def run(store, req, every):
    todo = store.pending(req)
    store.add(score_batches(todo, failing(every), key_cols=KEYS, isolate=True), F.col("scored_at"))
    return todo


def test_reruns_score_what_failed_and_shuffle_no_history(spark, tmp_path):
    path = str(tmp_path / "store")
    store = ResumeStore(spark, path, KEYS)
    run(store, requests(spark, 60), 3)
    assert store.answers().where("error is not null").count() == 20
    todo = run(ResumeStore(spark, path, KEYS), requests(spark, 80), 5)  # another session's store
    got = {r.video: r.response for r in store.answers().collect()}
    assert got == {f"v{i}": f"3:{i}" if i < 60 and i % 3 else None if i % 5 == 0 else f"5:{i}" for i in range(80)}
    # A third run: only its requests are shuffled.
    plan = ResumeStore(spark, path, KEYS).pending(requests(spark, 80))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and plan.count("SelectedBucketsCount: 8 out of 8") == 2
    assert todo.columns == ["model", "method", "video", "prompt"]


def test_store_keeps_its_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    run(ResumeStore(spark, path, KEYS, buckets=3), requests(spark, 30), 7)
    other = ResumeStore(spark, path, KEYS, buckets=11)
    todo = other.pending(requests(spark, 30))
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(_key_digest#\d+, (\d+)\)", plan) == ["3"]
    assert other.buckets == 3 and todo.count() == 5


def test_a_run_that_died_is_no_run(spark, tmp_path, monkeypatch):
    from verdikt.plans import resume

    path = str(tmp_path / "store")
    store = ResumeStore(spark, path, KEYS)
    monkeypatch.setattr(resume, "create_file", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        run(store, requests(spark, 9), 100)
    monkeypatch.undo()
    assert store.runs() == [] and store.answers().count() == 0 and store.pending(requests(spark, 9)).count() == 9


def test_repeated_rows_of_a_key_leave_the_last_answer(spark, tmp_path):
    store = ResumeStore(spark, str(tmp_path / "store"), KEYS)
    rows = [("m", "z", "v", "old", None, 0.1, 1.0), ("m", "z", "v", "new", None, 0.1, 2.0), ("m", "z", "v", None, "late failure", 0.1, 3.0), ("m", "z", "w", None, "e1", 0.1, 1.0), ("m", "z", "w", None, "e2", 0.1, 2.0)]
    store.add(spark.createDataFrame(rows, "model string, method string, video string, response string, error string, latency_s double, scored_at double"), F.col("scored_at"))
    assert {(r.video, r.response, r.error) for r in store.answers().collect()} == {("v", "new", None), ("w", None, "e2")}
