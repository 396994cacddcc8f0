"""Metrics by retraction, append exactly once, whole records, isolated failures."""

import os

import pytest
from pyspark.sql import functions as F

from verdikt.operators.inference import score_batches
from verdikt.operators.metrics import sliced_metrics
from verdikt.operators.scoring import attach_truth, score_rows
from verdikt.plans.evaluate import evaluate_lines
from verdikt.sources import sinks
from verdikt.streaming.ingest import write_log_files
from verdikt.streaming.running import ingest_running, metrics_after

TRUTH = [(f"v{i}", ["Security", "Wildlife, Security"][i % 2], ["Normal", "Abnormal", "Vague Abnormal"][i % 3], int(i % 3 > 0)) for i in range(30)]


def truth(spark):
    return spark.createDataFrame(TRUTH, "title string, category string, label string, true_label int")


def log(spark, answers):
    rows = [(m, "zeroshot", f'{{"{v}.mp4": "{{\\"result\\": {a}}}"}}', i) for i, (m, v, a) in enumerate(answers)]
    return spark.createDataFrame(rows, "model string, method string, line string, line_order long")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


DROPS = [
    [("m", f"v{i}", i % 2) for i in range(20)] + [("m", "v1", 0), ("n", "v3", 2)],
    [("m", f"v{i}", 1) for i in range(10, 34)] + [("n", "v3", '\\"?\\"')],
    [("m", "v5", 1), ("m", "v5", 0)],
]


def test_metrics_after_every_drop_equal_a_batch_over_all(spark, tmp_path):
    drop, table, point = (str(tmp_path / x) for x in ("drop", "table", "point"))
    so_far = []
    for d in DROPS:
        so_far += d
        write_log_files(log(spark, d).coalesce(1), drop)
        ingest_running(spark, drop, table, point, truth(spark))
        want = sliced_metrics(evaluate_lines(log(spark, so_far), truth(spark)))
        assert rows_of(metrics_after(spark, table, point)) == rows_of(want)
    # Two histograms stay: the last, and what a retry of it would start from.
    assert len([x for x in os.listdir(f"{table}/counts")]) == 2
    # The last drop changed one answer: it was written as a change of two rows, not as a log.
    sizes = [spark.read.parquet(f"{table}/counts/{x}").count() for x in sorted(os.listdir(f"{table}/counts"))]
    assert all(n <= 40 for n in sizes)


def test_late_file_replaces_nothing(spark, tmp_path):
    drop, table, point, other = (str(tmp_path / x) for x in ("drop", "table", "point", "other"))
    write_log_files(log(spark, [("m", "v1", 0), ("m", "v2", 0)]).coalesce(1), other)
    write_log_files(log(spark, [("m", "v1", 1)]).coalesce(1), other)
    os.makedirs(drop)
    for commit in ("commit=000000001", "commit=000000000"):
        os.rename(f"{other}/{commit}", f"{drop}/{commit}")
        ingest_running(spark, drop, table, point, truth(spark))
    want = evaluate_lines(log(spark, [("m", "v1", 1), ("m", "v2", 0)]), truth(spark))
    assert rows_of(metrics_after(spark, table, point)) == rows_of(sliced_metrics(want))


def test_one_call_takes_the_videos_of_a_bucket():
    """Python is called for a run's bucket, not for every video (some
    milliseconds each); state is read and written for the videos given, alone."""
    import pandas as pd

    from verdikt.streaming.running import ORDER, _replace

    class Entries(dict):
        def getMapState(self, *_):
            return self

        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    def answers(*rows):
        return pd.DataFrame([(v, n, 0, "p", 0, 0, 1, 1, p) for v, n, p in rows], columns=["video", *ORDER, "slice_mask_0", "truth", "prediction"])

    state = Entries()
    processor = _replace(["slice_mask_0"], ["model", "method"])
    processor.init(state)
    key = ("m", "z", 7)
    first = list(processor.handleInputRows(key, iter([answers(*((f"v{i}", 1, 0) for i in range(1000)))]), None))
    assert len(first) == 1 and len(state) == 1000 and first[0]["_n"].sum() == 1000
    # A replaced answer is taken out, a late one changes nothing, of two in a batch the last counts.
    again = list(processor.handleInputRows(key, iter([answers(("v1", 2, 1), ("v2", 0, 1), ("v3", 3, 1), ("v3", 2, 0))]), None))
    assert sorted(map(tuple, again[0].values.tolist())) == sorted([("m", "z", 1, 1, 0, -1), ("m", "z", 1, 1, 1, 1)] * 2)
    assert state[("v2",)][0] == 1 and state[("v3",)][0] == 3


def test_ingest_leaves_the_session_as_it_was(spark, tmp_path):
    from verdikt.streaming.running import STATE_CONF

    drop, table, point = (str(tmp_path / x) for x in ("drop", "table", "point"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    write_log_files(log(spark, DROPS[0]).coalesce(1), drop)
    ingest_running(spark, drop, table, point, truth(spark))
    assert {k: spark.conf.get(k, None) for k in STATE_CONF} == before


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("m", "z", "v1", "a"), ("m", "z", "v2", None)], "model string, method string, video string, response string")
    assert rows_of(sinks.read_appended(spark, path, df.schema)) == []
    assert sinks.append_once(df, path, "m/z") is True
    assert sinks.append_once(df, path, "m/z") is False
    assert sinks.append_once(df.limit(1), path, "m/z", attempt=1) is True
    got = sinks.read_appended(spark, path, df.schema)
    assert got.columns == df.columns and got.count() == 3


def test_racing_append_leaves_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("m", "z", "v1")], "model string, method string, video string")
    assert sinks.append_once(df, path, "r")
    monkeypatch.setattr(sinks, "child_files", lambda *_: [])  # as if both had looked before either wrote
    assert sinks.append_once(df, path, "r") is False
    monkeypatch.undo()
    assert sinks.read_appended(spark, path, df.schema).count() == 1
    assert len(os.listdir(f"{path}/data")) == 1


def test_unpublished_rows_are_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("m", "z", "v1")], "model string, method string, video string")
    sinks.append_once(df, path, "r")
    df.write.parquet(f"{path}/data/died")
    assert sinks.read_appended(spark, path, df.schema).count() == 1


def test_records_keep_whole_texts(spark, tmp_path):
    texts = ['say "hi", twice', "two\nlines", "", None, " padded ", "back\\slash \\", '"', "NULL", "tab\tand,comma", "\n"]
    df = spark.createDataFrame([(f"v{i}", t, "r", 1) for i, t in enumerate(texts)], "video string, video_description string, reasoning string, anomaly int").coalesce(1)
    path = str(tmp_path / "records")
    sinks.dump_records(df, path)
    got = sinks.read_records(spark, path, df.schema)
    assert rows_of(got.na.fill("<null>")) == rows_of(df.na.fill("<null>"))


def failing(pdf):
    if (pdf["prompt"] == "bad").any():
        raise ValueError("no")
    return list(pdf["prompt"].str.upper())


@pytest.mark.parametrize("policy", ["null", "text"])
def test_isolated_failures(spark, policy):
    rows = [(str(i), "bad" if i % 9 == 0 else "ok") for i in range(95)]
    df = spark.createDataFrame(rows, "video string, prompt string").coalesce(1)
    out = score_batches(df, failing, batch_size=10, key_cols=["video"], isolate=True, on_error=policy).collect()
    bad = {r.video for r in out if r.error}
    assert len(out) == 95 and bad == {str(i) for i in range(0, 95, 9)}
    assert {r.response for r in out if r.error} == ({None} if policy == "null" else {"ValueError: no"})
    assert {r.response for r in out if not r.error} == {"OK"}


def test_isolated_raise(spark):
    df = spark.createDataFrame([("1", "ok"), ("2", "bad")], "video string, prompt string").coalesce(1)
    with pytest.raises(Exception, match="ValueError: no"):
        score_batches(df, failing, key_cols=["video"], isolate=True, on_error="raise").collect()


def test_scored_rows_take_numbers_or_texts(spark):
    t = spark.createDataFrame([("v0", "x", "Normal", 0)], "title string, category string, label string, true_label int")
    texts = spark.createDataFrame([("v0.mp4", "0.9")], "video string, raw_value string")
    numbers = spark.createDataFrame([("v0.mp4", 0.9)], "video string, number double")
    for coerce, label in ((True, 0), (False, 1)):
        for df in (texts, numbers):
            assert [r.predicted_label for r in score_rows(attach_truth(df, t), "wrong", coerce=coerce).collect()] == [label]
