"""Property test: every dialect against a plain-Python statement of its rule.

The rules (SURVEY §2.5) restated with Python's ``re`` and ``json``; texts are
generated from an alphabet rich in braces, quotes, newlines, carriage
returns, comment slashes and brackets.
"""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdikt.functions.dialects import extract_labels, raw_line
from verdikt.functions.labels import label_int, label_number

KEY = "anomaly"
PIECES = ['{', '}', '"', '"anomaly"', ': ', '1', '0', '12', ',', '\n', '\r', ' ', '//', 'x', '[', ']', 'true', 'null',
          '\\n', '{"anomaly": 1}', '{"anomaly": 0}', "'", 'anomaly', '"a": "b"']
texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=14).map("".join)


def as_text(v):
    """A decoded JSON value as Spark's string reading renders it."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return json.dumps(v)
    if isinstance(v, str):
        return v
    return json.dumps(v, separators=(",", ":"))


def label_of(text_value):
    if text_value is None:
        return None
    if text_value == "true":
        return 1
    if text_value == "false":
        return 0
    if re.fullmatch(r"\s*[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*", text_value, re.ASCII):
        v = int(float(text_value))
        return v if -(2**31) <= v < 2**31 else None
    return None


def loads_member(doc):
    try:
        obj = json.loads(doc)
    except ValueError:
        return None
    if not isinstance(obj, dict):
        return None
    return as_text(obj.get(KEY))


def rule(dialect, t, line):
    if t is None and dialect != "rawline":
        return None
    if dialect == "greedy":
        m = re.search(r"{.*}", t, re.S)
        return label_of(loads_member(re.sub(r"//[^\n]*", "", m.group()))) if m else None
    if dialect == "greedy_raw":
        m = re.search(r"{.*}", t, re.S)
        return label_of(loads_member(m.group())) if m else None
    if dialect == "flat":
        f = t.replace("\n", " ").replace("\r", "")
        m = re.search(r"{.*?}", f, re.S)
        if not m:
            return None
        b = re.sub(r"\\n", "", m.group())
        return label_of(loads_member(re.sub(r"//.*", "", b)))
    if dialect == "repair":
        r = re.sub(r'"([ \t\n\r\f\v]*\n)', '",\\1', t)
        m = re.search(r"{.*?}", r, re.S)
        return label_of(loads_member(m.group())) if m else None
    if dialect == "strict":
        return label_of(loads_member(t))
    if dialect == "regex":
        m = re.search(r"[\"']?anomaly[\"']?[ \t\n\r\f\v]*:[ \t\n\r\f\v]*[\"']?([0-9]+)", t)
        return label_of(m.group(1)) if m else None
    if dialect == "loose":
        m = re.search(r"[\"']?anomaly[\"']?[ \t\n\r\f\v]*:[ \t\n\r\f\v]*([0-9]+)", t)
        return label_of(m.group(1)) if m else None
    if dialect == "rawline":
        m = re.search(r'\\"anomaly\\"[ \t\n\r\f\v]*:[ \t\n\r\f\v]*([0-9]+)', line)
        return label_of(m.group(1)) if m else None
    raise ValueError(dialect)


DIALECTS = ["greedy", "greedy_raw", "flat", "repair", "strict", "regex", "loose", "rawline"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), texts), min_size=40, max_size=40))
def test_dialects_follow_rules(spark, batch):
    rows = [(f"v{i}.mp4", i, t) for i, t in enumerate(batch)]
    df = spark.createDataFrame(rows, "video string, i int, response string").withColumn(
        "line", raw_line(F.col("video"), F.col("response"))
    )
    lines = {r.i: r.line for r in df.select("i", "line").collect()}
    for d in DIALECTS:
        out = extract_labels(df, d, KEY, line_col="line").select("i", label_int(label_number(F.col("raw_value"))).alias("l"))
        got = {r.i: r.l for r in out.collect()}
        for i, t in enumerate(batch):
            assert got[i] == rule(d, t, lines[i]), (d, t)


def test_sentinel_blocks_early_close(spark):
    df = spark.createDataFrame(
        [('[{"anomaly": 1}] and [{"anomaly": 0}]',), ('{"anomaly": 1}],[{"x": 0}',), ('{"anomaly": 1}',)], "response string"
    ).withColumn("video", F.lit("v"))
    got = [r.raw_value for r in extract_labels(df, "greedy", KEY).collect()]
    assert got == [None, None, "1"]
