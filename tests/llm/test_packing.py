import random
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import awkward, frame, prose
from verdikt.llm import packing as p


def slow_best_fit(lengths, clusters, sources, capacity, per_source):
    """Every open bin is looked at for every piece."""
    bins, out = [], []
    for n, c, s in zip(lengths, clusters, sources):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and c not in b["clusters"] and b["sources"].count(s) < per_source]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": []})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= n
        bins[k]["clusters"].add(c)
        bins[k]["sources"].append(s)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_successor_search_equals_brute_force(seed):
    r = random.Random(seed)
    n = 300
    lengths = sorted((r.choice([0, 1, 5, r.randrange(100)]) for _ in range(n)), reverse=True)
    clusters = [r.choice([1, 2, r.randrange(10**6)]) for _ in range(n)]
    sources = [r.choice([0, 0, r.randrange(9)]) for _ in range(n)]
    assert p.best_fit(lengths, clusters, sources, 100, 1 + seed % 3) == slow_best_fit(lengths, clusters, sources, 100, 1 + seed % 3)


def check(rows, placed, capacity, per_source):
    total = defaultdict(int)
    for d in placed:
        total[d["doc_id"]] += d["n_words"]
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len((r[1] or "").encode().split())
    assert dict(total) == dict(want)
    bins = defaultdict(list)
    for d in placed:
        bins[d["block"], d["bin"]].append(d)
    for members in bins.values():
        assert sum(d["n_words"] for d in members) <= capacity
        clusters = [d["cluster"] for d in members]
        assert len(set(clusters)) == len(clusters)
        assert max([d["source"] for d in members].count(s) for s in {d["source"] for d in members}) <= per_source
        at = 0
        for d in sorted(members, key=lambda d: (d["start"], d["n_words"])):
            assert d["start"] == at
            at += d["n_words"]


@pytest.mark.parametrize("block", [p.BLOCK, 16])
def test_all_words_are_placed_without_conflict(spark, block):
    rows = awkward() + [(5000 + i, prose(80, 77), "en", "hot", 0) for i in range(40)]
    placed = p.pack(frame(spark, rows, extra=True), capacity=512, per_source=3, block=block).collect()
    check(rows, placed, 512, 3)


def test_blocks_equal_brute_force(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] >= 10]
    placed = sorted(p.pack(frame(spark, rows), capacity=200, per_source=2).collect(), key=lambda d: (-d["n_words"], d["doc_id"], d["piece"]))
    want = slow_best_fit([d["n_words"] for d in placed], [d["cluster"] for d in placed], [d["source"] for d in placed], 200, 2)
    assert [(d["bin"], d["start"]) for d in placed] == want


@pytest.mark.parametrize("doc_id", [7, None])
def test_a_repeated_or_missing_id_is_dealt_over_blocks(spark, doc_id):
    rows = [(doc_id, f"{prose(20, 5)} {i % 50}", "en", f"s{i % 3}", 0) for i in range(20_000)] + [(100 + i, prose(30, i), "en", "other", 0) for i in range(500)]
    found = p.pack(frame(spark, rows), capacity=512, per_source=8, block=1000)
    placed = found.collect()
    check(rows, placed, 512, 8)
    sizes = Counter(d["block"] for d in placed)
    assert len(placed) == len(rows) and len(sizes) == 21 and max(sizes.values()) < 1300
    # Ids that stand once are dealt by themselves, whatever is around them.
    alone = lambda x: {d["doc_id"]: d["block"] for d in x if d["doc_id"] != doc_id}
    assert alone(placed) == alone(p.pack(frame(spark, rows[::-1]), capacity=512, per_source=8, block=1000).collect())


def test_empty_table(spark):
    assert p.pack(frame(spark, [])).count() == 0
