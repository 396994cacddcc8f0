"""Scoring policies, name normalisation, join semantics and last-wins."""

from pyspark.sql import functions as F

from verdikt.functions.labels import label_number, predicted_label, strip_media_suffix
from verdikt.operators.dedup import last_wins
from verdikt.operators.scoring import attach_truth, score_rows
from verdikt.plans.evaluate import extract_from_lines, latest_answers
from verdikt.sources.logs import read_keyed_log
from verdikt.sources.truth import with_truth_label


def test_policies(spark):
    # (truth, raw label) -> (accuracy, predicted) for 'wrong' and 'negative'
    cases = [(1, "1"), (0, "1"), (1, None), (0, None), (1, "1.7"), (1, "2")]
    df = spark.createDataFrame(cases, "t int, v string")
    num = label_number(F.col("v"))
    out = df.select(
        "t", "v",
        predicted_label(num, F.col("t"), "wrong").alias("pw"),
        predicted_label(num, F.col("t"), "negative").alias("pn"),
    ).collect()
    got = [((r.pw == r.t) * 1, r.pw, (r.pn == r.t) * 1, r.pn) for r in out]
    assert got == [
        (1, 1, 1, 1),
        (0, 1, 0, 1),
        (0, 0, 0, 0),
        (0, 1, 1, 0),
        (1, 1, 1, 1),
        (0, 2, 1, 1),
    ]


def test_name_normalisation(spark):
    df = spark.createDataFrame([("a.mp4",), ("xmp4.mp4",), ("a.mp4.mp4",), ("zmp4b",), ("b.avi",)], "n string")
    assert [r[0] for r in df.select(strip_media_suffix(F.col("n"))).collect()] == ["a", "xmp4", "a", "zmp4b", "b.avi"]


def test_join_drops_unmatched_and_multiplies_duplicates(spark):
    preds = spark.createDataFrame(
        [("m", "z", "a.mp4", "1", "ok"), ("m", "z", "b.mp4", "0", "ok"), ("m", "z", "zz.mp4", "1", "ok")],
        "model string, method string, video string, raw_value string, parse_status string",
    )
    truth = with_truth_label(
        spark.createDataFrame(
            [("a", "Security", "Abnormal"), ("a", "Security", "Abnormal"), ("b", "Wildlife", "Normal"), ("c", "x", "Normal"),
             ("b2", "x", "Weird")],
            "title string, category string, label string",
        )
    )
    scored = score_rows(attach_truth(preds, truth)).collect()
    assert sorted(r.video_name for r in scored) == ["a", "a", "b"]
    assert all(r.accuracy == 1 for r in scored)


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_last_wins_across_files(spark, tmp_path):
    d = tmp_path / "log"
    d.mkdir()
    _write(d / "a.jsonl", ['{"v1.mp4": "{\\"result\\": 0}"}', '{"v1.mp4": "{\\"result\\": 1}"}', "not json", "",
                           '{"v2.mp4": "{\\"result\\": 0}", "v3.mp4": null}'])
    import os
    import time
    time.sleep(0.05)
    _write(d / "b.jsonl", ['{"v2.mp4": "{\\"result\\": 1}"}'])
    os.utime(d / "b.jsonl", (time.time() + 5, time.time() + 5))
    lines = read_keyed_log(spark, str(d))
    bad = lines.where("line_status = 'bad_line'").count()
    assert bad == 2  # 'not json' and the blank line stay countable
    lines_df = lines.sparkSession.read.text(str(d))  # noqa: F841
    from verdikt.sources.logs import read_lines

    raw = read_lines(spark, str(d)).withColumn("model", F.lit("m")).withColumn("method", F.lit("z"))
    latest = latest_answers(extract_from_lines(raw, "greedy", "result"))
    got = {r.video: r.raw_value for r in latest.collect()}
    assert got == {"v1.mp4": "1", "v2.mp4": "1", "v3.mp4": None}


def test_reingest_is_noop(spark):
    df = spark.createDataFrame(
        [("m", "v1", 1, "0"), ("m", "v1", 2, "1"), ("m", "v2", 1, "0")], "model string, video string, ord int, val string"
    )
    once = last_wins(df, ["model", "video"], "ord", ["val"]).drop("n_versions")
    twice = last_wins(df.unionByName(df), ["model", "video"], "ord", ["val"]).drop("n_versions")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_truth_quality(spark):
    from verdikt.operators.metrics import truth_quality

    truth = with_truth_label(
        spark.createDataFrame(
            [("a", "x", "Normal"), ("a", "x", "Abnormal"), ("b", "x", "Odd"), ("c", "x", "Vague Abnormal")],
            "title string, category string, label string",
        )
    )
    r = truth_quality(truth).collect()[0]
    assert (r.rows, r.titles, r.duplicate_titles, r.unlabelled_rows) == (4, 3, 1, 1)
