"""Label extraction, case by case (cases restated from the dialect rules)."""

import pytest
from pyspark.sql import functions as F

from verdikt.functions.dialects import chain_record, extract_labels
from verdikt.functions.labels import label_int, label_number

NL = "\n"
FENCE = "```"


def case_texts(k):
    return {
        1: '{"%s": 1}' % k,
        2: FENCE + "json" + NL + '{"%s": 1}' % k + NL + FENCE,
        3: '{"%s": 1 // note' % k + NL + "}",
        4: '{"%s": 1, // note' % k + NL + "}",
        5: '{"%s": "1"}' % k,
        6: 'text {"%s": 1} text' % k,
        7: '{"%s": 1} or {"%s": 0}' % (k, k),
        8: '{"a": "b"' + NL + '"%s": 1' % k + NL + "}",
        9: '{"%s": 1,' % k + NL + '"a": "b"' + NL + "}",
        10: '{"a": "http://x",' + NL + '"%s": 1}' % k,
        11: "{'%s': 1}" % k,
        12: '{"a": {"b": 2}, "%s": 1}' % k,
        13: '{"other": 1}',
        14: "no answer",
        15: None,
        16: '{"%s": "NAN"}' % k,
        17: '{"%s": null}' % k,
        18: '{"%s": 0, "%s": 1}' % (k, k),
    }


# expected label per case; None = invalid
EXPECTED = {
    "greedy": {1: 1, 2: 1, 3: 1, 4: None, 5: 1, 6: 1, 7: None, 8: None, 9: 1, 10: None, 11: None, 12: 1,
               13: None, 14: None, 15: None, 16: None, 17: None, 18: 1},
    "greedy_raw": {1: 1, 2: 1, 3: None, 4: None, 5: 1, 6: 1, 7: None, 8: None, 9: 1, 10: 1, 11: None, 12: 1,
                   13: None, 14: None, 15: None, 16: None, 17: None, 18: 1},
    "regex": {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1,
              13: None, 14: None, 15: None, 16: None, 17: None, 18: 0},
    "loose": {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1,
              13: None, 14: None, 15: None, 16: None, 17: None, 18: 0},
    "flat": {1: 1, 2: 1, 3: None, 4: None, 5: 1, 6: 1, 7: 1, 8: None, 9: 1, 10: None, 11: None, 12: None,
             13: None, 14: None, 15: None, 16: None, 17: None, 18: 1},
    "repair": {1: 1, 2: 1, 3: None, 4: None, 5: 1, 6: 1, 7: 1, 8: 1, 9: None, 10: 1, 11: None, 12: None,
               13: None, 14: None, 15: None, 16: None, 17: None, 18: 1},
    "rawline": {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: None, 12: 1,
                13: None, 14: None, 15: None, 16: None, 17: None, 18: 0},
    "strict": {1: 1, 2: None, 3: None, 4: None, 5: 1, 6: None, 7: None, 8: None, 9: 1, 10: 1, 11: None, 12: 1,
               13: None, 14: None, 15: None, 16: None, 17: None, 18: 1},
}


@pytest.mark.parametrize("dialect", sorted(EXPECTED))
def test_dialect_cases(spark, dialect):
    key = "anomaly"
    rows = [(f"v{i}.mp4", i, t) for i, t in case_texts(key).items()]
    df = spark.createDataFrame(rows, "video string, case int, response string")
    out = extract_labels(df, dialect, key).withColumn("label", label_int(label_number(F.col("raw_value"))))
    got = {r["case"]: r["label"] for r in out.select("case", "label").collect()}
    assert got == EXPECTED[dialect]


def test_per_row_dialect_matches_single(spark):
    key = "anomaly"
    rows = []
    for d in EXPECTED:
        rows += [(f"v{i}.mp4", i, t, d) for i, t in case_texts(key).items()]
    df = spark.createDataFrame(rows, "video string, case int, response string, dialect string")
    combos = [(d, key) for d in EXPECTED]
    out = extract_labels(df, F.col("dialect"), key, combos=combos)
    out = out.withColumn("label", label_int(label_number(F.col("raw_value"))))
    for r in out.collect():
        assert r["label"] == EXPECTED[r["dialect"]][r["case"]], (r["dialect"], r["case"])


def test_status_values(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", "no braces"), ("c", "{bad}"), ("d", '{"x": 1}'), ("e", '{"result": 0}')],
        "video string, response string",
    )
    got = {r["video"]: r["parse_status"] for r in extract_labels(df, "greedy", "result").collect()}
    assert got == {"a": "null_response", "b": "no_block", "c": "bad_json", "d": "no_value", "e": "ok"}


def test_label_rule(spark):
    vals = ["1", "0", " 1 ", "1.7", "0.9", "true", "false", "NaN", "1d", "x", None, "-1", "1e0", "99999999999"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(label_int(label_number(F.col("v")))).collect()]
    assert got == [1, 0, 1, 1, 0, 1, 0, None, None, None, None, -1, 1, None]


def test_chain_record(spark):
    good = '{"video_description": "d", "reasoning": "r", "anomaly": 1}'
    rows = [
        ("plain", good),
        ("fenced", FENCE + "json" + NL + good + NL + FENCE),
        ("missing", '{"video_description": "d"}'),
        ("broken", '{"video_description": "d",'),
        ("null", None),
        ("space_before_fence", " " + FENCE + "json" + NL + good + NL + FENCE + "x"),
        ("blank_lines", "{" + NL + NL + '"video_description": "d", "reasoning": "r", "anomaly": 1}'),
    ]
    df = spark.createDataFrame(rows, "name string, t string")
    got = {r["name"]: tuple(r["c"][:3]) for r in df.select("name", chain_record("t").alias("c")).collect()}
    assert got["plain"] == ("d", "r", "1")
    assert got["fenced"] == ("d", "r", "1")
    assert got["missing"] == ("d", "NAN", "0")
    assert got["broken"] == ("NAN", "NAN", "0")
    assert got["null"] == ("NAN", "NAN", "0")
    assert got["blank_lines"] == ("d", "r", "1")
