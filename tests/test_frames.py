"""The frame store: payloads stay where they lie, requests come in bounded parts."""

import re

import pytest
from pyspark.sql import functions as F

from verdikt.plans import catalog
from verdikt.sources.frames import request_parts, sample_choice, store_frames, stored_frames, stride_choice

SMALL = "/root/testdata/sf0.001"


def videos(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "video string, n_frames long")


def frames(spark, sizes):
    x = videos(spark, sizes).select("video", F.explode(F.expr("sequence(0L, n_frames - 1)")).alias("frame_idx"))
    return x.select("video", "frame_idx", F.encode(F.concat_ws("/", "video", "frame_idx"), "UTF-8").alias("payload"))


def by_plain_rule(sizes, step, most=None):
    """Parts by walking each video's frames."""
    want = {}
    for video, n in sizes.items():
        chosen = [i for i in range(n) if i % step(n) == 0][:most]
        for rank, i in enumerate(chosen):
            want.setdefault((video, i // 1000, rank // 20), []).append((rank, i))
    return {(v, p[0][0]): ([f"{v}/{i}".encode() for _, i in p], len(range(0, sizes[v], step(sizes[v]))[:most])) for (v, _, _), p in want.items()}


def got(parts):
    return {(r.video, r.first_rank): ([bytes(x) for x in r.frames], r.n_request) for r in parts.collect()}


SIZES = {"long": 100_000, "a": 1, "b": 19, "c": 20, "d": 39, "e": 999, "f": 1000, "g": 1001, "h": 2050, "i": 7777}


def test_parts_equal_the_plain_rule_and_are_bounded(spark, tmp_path):
    stored = store_frames(frames(spark, SIZES), str(tmp_path / "s"), buckets=5)
    asked = videos(spark, {**SIZES, "absent": 500})
    every = got(request_parts(stored, stride_choice(asked)))
    assert every == by_plain_rule(SIZES, lambda n: 50)
    assert sum(v == "long" for v, _ in every) == 100 and max(len(x) for x, _ in every.values()) == 20
    assert got(request_parts(stored, stride_choice(asked, 1), 7)).keys() >= {("long", 0), ("long", 99_995)}
    sampled = got(request_parts(stored_frames(spark, str(tmp_path / "s")), sample_choice(asked)))
    assert sampled == by_plain_rule(SIZES, lambda n: max(n // 20, 1), 20)


def test_a_long_video_lies_in_many_buckets(spark, tmp_path):
    stored = store_frames(frames(spark, {"long": 100_000}), str(tmp_path / "s"), buckets=8)
    files = [r[0] for r in stored.groupBy(F.regexp_extract(F.input_file_name(), r"_(\d{5})\.", 1)).count().collect()]
    assert len(files) == 8


def test_no_payload_in_a_shuffle(spark, tmp_path):
    stored = store_frames(frames(spark, SIZES), str(tmp_path / "s"), buckets=6)
    for choice in (stride_choice, sample_choice):
        df = request_parts(stored, choice(videos(spark, SIZES)))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # One exchange, of the choice's segments; joined and grouped in the buckets.
        assert re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) and plan.count("Exchange hashpartitioning") == 1
        assert "SelectedBucketsCount: 6 out of 6" in plan and "BroadcastExchange" not in plan
        below = plan.split("Exchange hashpartitioning")[1]
        assert "payload" not in below
    plan = catalog.QUERIES["request_parts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "payload" not in plan.split("Exchange hashpartitioning")[1]


def test_defined_cases(spark, tmp_path):
    odd = frames(spark, {"a": 3}).unionAll(spark.createDataFrame([(None, 0, b"x"), ("a", None, b"y"), ("a", 0, b"z")], "video string, frame_idx long, payload binary"))
    stored = store_frames(odd.withColumn("segment", F.lit("clash")), str(tmp_path / "s"))
    asked = spark.createDataFrame([("a", 3), (None, 5), ("b", 0), ("c", None)], "video string, n_frames long")
    rows = request_parts(stored, stride_choice(asked, 2)).collect()
    assert [(r.video, r.first_rank, r.n_frames, r.n_request) for r in rows] == [("a", 0, 3, 2)]
    assert [bytes(x) for x in rows[0].frames] == [b"a/0", b"z", b"a/2"]
    empty = store_frames(frames(spark, {"a": 1}).limit(0), str(tmp_path / "e"))
    assert request_parts(empty, stride_choice(asked)).collect() == []


def test_a_write_that_broke_off_is_not_read(spark, tmp_path, monkeypatch):
    from verdikt.sources import frames as module

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(module, "create_file", die)
    with pytest.raises(OSError):
        store_frames(frames(spark, {"a": 3}), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)path"):
        stored_frames(spark, str(tmp_path / "s"))
