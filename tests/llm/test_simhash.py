import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import awkward, frame, prose
from verdikt.llm import simhash as s


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """(id, print, component) by comparing all pairs."""
    prints = [slow_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[top(i)] = top(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[top(i)] = min(d, names.get(top(i), d))
    return Counter((rows[i][0], prints[i], names.get(top(i))) for i in range(len(rows)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\nÀ\x1c ", max_size=60))
def test_fingerprint_equals_definition(text):
    assert s.fingerprint(text.encode()) == slow_print(text)


def test_spark_hash_is_the_contracts(spark):
    assert spark.sql("select xxhash64('ein wort hier')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"ein wort hier", 42)


def near_rows():
    r = random.Random(5)
    rows = [(d[0], d[1]) for d in awkward()]
    for k in range(25):
        words = prose(400, 200 + k).split(" ")
        for c in range(r.choice([1, 2, 8])):
            w = list(words)
            for _ in range(c):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            rows.append((1000 * k + 500 + c, " ".join(w)))
    return rows


def test_masks_keep_every_close_pair():
    r = random.Random(4)
    for blocks in (4, 5, 6):
        masks = s.block_masks(3, blocks)
        for _ in range(300):
            x, flips = r.getrandbits(64), sum(1 << b for b in r.sample(range(64), 3))
            assert any((x & m) == ((x ^ flips) & m) for m in masks)


@pytest.mark.parametrize("tile, blocks", [(s.TILE, s.BLOCKS), (4, 5), (4, 4), (64, 6)])
def test_components_equal_all_pairs(spark, tile, blocks, monkeypatch):
    monkeypatch.setattr(s.fingerprint_links, "__defaults__", (3, tile, blocks))
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in s.simhash_components(df).collect())
    assert got == slow_components(rows)


@pytest.mark.parametrize("strip", [4, 512])
def test_tiles_find_all_close_pairs(strip, monkeypatch):
    monkeypatch.setattr(s, "STRIP", strip)
    g = np.random.default_rng(1)
    base = g.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(7 << 30), g.integers(0, 2**63, 200, dtype=np.uint64)])
    group = g.integers(0, 5, len(fp))
    u, v = s.close_pairs(fp, group, 3)
    label = s.stars(len(fp), u, v)
    want = np.array([(fp[i] ^ fp[j]).bit_count() <= 3 and group[i] == group[j] for i in range(len(fp)) for j in range(len(fp))]).reshape(len(fp), -1)
    i, j = np.nonzero(want)
    assert (label[i] == label[j]).all()
    assert (np.bitwise_count(fp[u] ^ fp[v]) <= 3).all() or strip == 4
    whole = s.stars(len(fp), i, j)
    assert (whole == label).all()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in s.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 901: 900}


def test_one_of_each_group_stays(spark):
    rows = awkward() + [(d, t, "en", "z", 0) for d, t in near_rows()[len(awkward()) :]]
    df = frame(spark, rows, extra=True)
    kept = s.near_dedup(df)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = {d for d, _, c in slow_components([(r[0], r[1]) for r in rows]) if d is not None and d == c}
    assert {d for d in ids if d is not None} == want
    # Rows without an id: one of two equal ones, and no other row is near them.
    assert all(n == 1 for n in ids.values()) and ids[None] == 1


def test_an_id_may_stand_for_several_texts(spark):
    one, two, three = (prose(90, 900 + i) for i in range(3))
    rows = [(1, one), (5, one), (5, two), (7, three), (7, prose(90, 950)), (8, three), (None, one)]
    kept = s.near_dedup(frame(spark, [(d, t, "en", "a", 0) for d, t in rows])).collect()
    want = [(1, one), (5, two), (7, three), (7, prose(90, 950))]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want)


def test_near_dedup_of_files_moves_no_text(spark, tmp_path):
    rows = [(i % 40 if i % 9 else None, prose(60 + i % 40, i % 50), "en", "a", 0) for i in range(400)]
    path = str(tmp_path / "docs")
    frame(spark, rows).repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = s.near_dedup(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert kept.columns == docs.columns
    roots = {c for *_, c in slow_components([(n, r[1]) for n, r in enumerate(rows)])}
    assert kept.count() == len(roots) and {r["text"] for r in kept.collect()} <= {r[1] for r in rows}


def test_empty_table(spark):
    assert s.simhash_components(frame(spark, [])).count() == 0
    assert s.near_dedup(frame(spark, [])).count() == 0
