"""Source scans on small files written to a temp folder."""

from pyspark.sql import functions as F

from verdikt.functions.dialects import extract_labels
from verdikt.sources.logs import parse_idpred_lines, parse_raw_lines, read_keyed_log, read_lines
from verdikt.sources.media import list_media
from verdikt.sources.truth import read_ground_truth, read_rules, read_trim_list, rules_block


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_keyed_log_list_value_and_bad_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    _write(p, '{"a.mp4": ["{\\"updated_anomaly\\": 1}", null]}\n[1, 2]\n{"b.mp4": "x", "c.mp4": "y"}\n')
    df = read_keyed_log(spark, str(p))
    rows = {r.video: (r.response, r.line_status) for r in df.collect()}
    assert rows["a.mp4"][0].startswith("[")  # list value comes through as raw JSON text
    assert rows[None] == (None, "bad_line")
    assert rows["b.mp4"] == ("x", "ok") and rows["c.mp4"] == ("y", "ok")
    # the raw-line dialect reads the list value's label
    ex = extract_labels(df.where("video = 'a.mp4'"), "rawline", "updated_anomaly", line_col="line").collect()[0]
    assert ex.raw_value == "1"


def test_idpred_lines(spark):
    lines = spark.createDataFrame(
        [('{"id": "v1", "truth": 1, "pred": "{\\"result\\": 1}"}',), ('{"id": "", "pred": "x"}',), ('{"pred": "y"}',), ("junk",)],
        "line string",
    )
    keep = {r.video: r.response for r in parse_idpred_lines(lines).where("line_status = 'ok'").collect()}
    assert keep == {"v1": '{"result": 1}', "": "x", "NAN": "y"}
    dropped = parse_idpred_lines(lines, drop_empty=True).collect()
    assert [r.video for r in dropped] == ["v1"]
    assert dropped[0].claimed_truth == 1


def test_raw_lines_key(spark):
    lines = spark.createDataFrame([('{"v1.mp4": "{\\"anomaly\\": 1}"}',), ("garbage",)], "line string")
    got = [r.video for r in parse_raw_lines(lines).collect()]
    assert got == ["v1.mp4", "unknown"]


def test_truth_rules_trim(spark, tmp_path):
    gt = tmp_path / "gt.csv"
    _write(gt, "Title,Category,Label,Extra\nv1,Security,Abnormal,x\nv2,\"Security, Wildlife\",Vague Abnormal,y\nv3,Wildlife,Normal,z\nv4,x,Odd,w\n")
    t = {r.title: (r.category, r.true_label) for r in read_ground_truth(spark, str(gt)).collect()}
    assert t == {"v1": ("Security", 1), "v2": ("Security, Wildlife", 1), "v3": ("Wildlife", 0), "v4": ("x", None)}
    rules = tmp_path / "rules.json"
    _write(rules, '{\n  "rules": ["Rule 1: a", "Rule 2: b"]\n}\n')
    assert rules_block(read_rules(spark, str(rules))).collect()[0][0] == "Rule 1: a\nRule 2: b"
    empty = tmp_path / "empty.json"
    _write(empty, "{}\n")
    assert read_rules(spark, str(empty)).collect()[0][0] == []
    trim = tmp_path / "trim.csv"
    _write(trim, "No.,Title,Time\n1,a,0\n2,b,-5\n3,c,\n")
    got = [(r.no, r.title, r.time) for r in read_trim_list(spark, str(trim)).collect()]
    assert got == [(1, "a", 0.0), (2, "b", -5.0), (3, "c", None)]


def test_media_inventory(spark, tmp_path):
    root = tmp_path / "media"
    (root / "sub").mkdir(parents=True)
    for n in ["a.mp4", "b.avi", "c.MP4", "d.txt"]:
        _write(root / n, "xx")
    _write(root / "sub" / "e.mov", "xyz")
    flat = sorted(r.name for r in list_media(spark, str(root)).collect())
    assert flat == ["a.mp4", "b.avi"]
    rec = {r.rel_path: r.length for r in list_media(spark, str(root), recursive=True).collect()}
    assert rec == {"a.mp4": 2, "b.avi": 2, "sub/e.mov": 3}
    plan = list_media(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0] if "ReadSchema" in plan else True
