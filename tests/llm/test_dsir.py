import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, frame, prose
from verdikt.llm import dsir as d


def slow_tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x09-\x0d\x20]+", (text or b"").lower())


def test_ngrams_follow_the_tokens():
    texts = [r[1] and r[1].encode() for r in awkward()] + [b"a--b c", b"--", b"x", b"A a", None, b""]
    g, o = d.ngrams(texts)
    for i, t in enumerate(texts):
        tokens = slow_tokens(t)
        own = g[o == i]
        assert len(own) == len(tokens) + max(0, len(tokens) - 1)
        one = own[own < 1 << d.BITS]
        assert len({*tokens}) >= len(set(one.tolist())) >= 0.9 * len({*tokens})
        by_token = {}
        assert all(by_token.setdefault(w, k) == k for w, k in zip(tokens, one.tolist()))
    alone = [d.ngrams([t])[0].tolist() for t in texts]
    assert [g[o == i][: len(a)].tolist() for i, a in enumerate(alone)] and all(sorted(g[o == i].tolist()) == sorted(a) for i, a in enumerate(alone))


def test_pieces_keep_every_text():
    texts = [b"x" * n for n in (0, 5, 100, 3, 0, 7, 50)] + [None]
    parts = list(d.pieces(texts, 20))
    assert [x for _, p in parts for x in p] == texts and [f for f, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]


@pytest.mark.parametrize("seed", range(6))
def test_kth_largest_equals_sorting(spark, seed):
    r = random.Random(seed)
    keys = [r.choice([r.randrange(-(10**12), 10**12), 5, 5, -7]) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 150, 299, 300):
        assert d.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert d.kth_largest(df, 0) is None and d.kth_largest(df.limit(0), 3) is None


def test_model_equals_plain_counts(spark):
    rows = [r for r in awkward() if r[0] is not None]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    model, share = d.fitted(frame(spark, rows, extra=True).repartition(5), labels)
    g, o = d.ngrams([r[1] and r[1].encode() for r in rows])
    good = np.array([10 <= r[0] < 40 and r[0] % 2 == 1 for r in rows])
    raw, hit = np.bincount(g, minlength=2 << d.BITS), np.bincount(g[good[o]], minlength=2 << d.BITS)
    half = 1 << d.BITS
    assert np.allclose(model, np.r_[d.log_ratio(raw[:half], hit[:half]), d.log_ratio(raw[half:], hit[half:])])
    assert share == 0.5 + d.MARGIN


def test_verdicts_equal_brute_force(spark):
    rows = awkward() + [(100 + i, prose(100, 50 + i) + " vile rotten words" * 9, "en", "a", 0) for i in range(8)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 40)] + [(100 + i, 1, 1) for i in range(8)] + [(None, 1, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows, extra=True)
    got = d.importance_resample(df, labels)
    out = got.select("_row.doc_id", "_row.text", "log_weight", "key", "kept").collect()
    keys = [r["key"] for r in out if r["key"] is not None]
    share = 30 / 38 + d.MARGIN
    cut = sorted(keys, reverse=True)[int(np.ceil(share * len(keys))) - 1]
    assert all(r["kept"] == (r["key"] is not None and r["key"] >= cut) for r in out)
    assert all((r["log_weight"] is None) == (not slow_tokens((r["text"] or "").encode())) for r in out)
    assert not any(r["kept"] for r in out if r["doc_id"] in range(100, 108))
    assert got.where("kept").select("_row.*").columns == df.columns
    noise = spark.range(20_000).select(d.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(noise[0] - 0.5772) < 0.03 and abs(noise[1] - 1.2825) < 0.03


def test_held_out_labels(spark):
    """Fitted on the labels of even ids, judged on those of odd ids."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    got = d.importance_resample(docs, labels.where("doc_id % 2 = 0")).select("_row.doc_id", "kept")
    x = got.join(labels.where("doc_id % 2 = 1"), "doc_id").agg(
        F.avg(F.when(F.expr("quality = 1 and toxic = 0"), F.col("kept").cast("int"))),
        F.avg(F.when(F.expr("quality = 0"), F.col("kept").cast("int"))),
        F.avg(F.when(F.expr("toxic = 1"), F.col("kept").cast("int"))),
    ).first()
    assert x[0] > 0.93 and x[1] < 0.1 and x[2] < 0.5, x


def test_held_out_toxic_texts_are_caught(spark):
    """As above with closer bounds: k has no room beside the good share."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    got = d.importance_resample(docs, labels.where("doc_id % 2 = 0")).select("_row.doc_id", "kept")
    x = got.join(labels.where("doc_id % 2 = 1"), "doc_id").agg(
        F.avg(F.when(F.expr("quality = 1 and toxic = 0"), F.col("kept").cast("int"))),
        F.avg(F.when(F.expr("toxic = 1"), F.col("kept").cast("int"))),
    ).first()
    assert x[0] > 0.94 and x[1] < 0.2, x


@pytest.mark.parametrize("words", [50, 500, 5000])
def test_a_long_text_does_not_dilute_a_passage(words):
    clean, vile = prose(words, 1).encode(), b" you vile rotten things"
    model = np.zeros(2 << d.BITS)
    bad = d.ngrams([vile])[0]
    model[bad[bad < 1 << d.BITS]] = -4.0
    a, b = d.log_weights([clean, clean[: len(clean) // 2] + vile + clean[len(clean) // 2 :]], model)
    assert d.STRENGTH * (a - b) > 40


def test_worst_passage_equals_definition():
    r = random.Random(3)
    texts = [[r.uniform(-3, 2) for _ in range(n)] for n in (0, 1, 7, 8, 9, 40, 0, 3)]
    ratio, owner = np.array([x for t in texts for x in t]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    want = [min((sum(t[max(0, i + 1 - d.PASSAGE) : i + 1]) / d.PASSAGE for i in range(len(t))), default=0.0) for t in texts]
    assert np.allclose(d.worst_passage(ratio, owner, len(texts)), want)
    assert d.worst_passage(np.zeros(0), np.zeros(0, int), 2).tolist() == [0, 0]


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = d.importance_resample(frame(spark, awkward()), none).collect()
    assert all(r["kept"] == (r["log_weight"] is not None) for r in out)
    assert d.importance_resample(frame(spark, []), none).count() == 0
