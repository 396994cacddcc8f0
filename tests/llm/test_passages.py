"""Repeated passages against a brute-force version."""

import hashlib
import random

import pytest

from tests.llm.cases import DOCS, awkward, frame, prose
from verdikt.llm.common import table
from verdikt.llm.passages import Shard, anchor_runs, op13, repeated_passages


def brute(rows, window=20):
    """rows (id, text) -> sorted (id, n_words, n_removed, sha) by the rule itself."""
    import xxhash

    items = []
    for i, t in rows:
        w = (t or "").encode().split()
        d = xxhash.xxh3_128_intdigest(b" ".join(w))
        s1, s2 = [x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & (1 << 64) - 1)]
        items.append(((i is None, i or 0, s1, s2), i, w))
    items.sort(key=lambda x: x[0])
    seen, out = set(), []
    for _, i, w in items:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = b" ".join([x for x, g in zip(w, gone) if not g])
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()], key=str)


def planted(seed=5, n=60):
    r = random.Random(seed)
    passage = prose(55, 999).split()
    line = prose(11, 998).split()  # shorter than a window: common, in changing contexts
    rows = []
    for i in range(n):
        words = prose(r.randint(0, 90), 100 + i).split()
        for part in (passage, line):
            if r.random() < 0.5:
                at = r.randint(0, len(words))
                words[at:at] = part
        rows.append((i * 7 - 50, " ".join(words)))
    rows += [(1000 + i, rows[3][1]) for i in range(20)]  # exact copies
    near = rows[5][1].split()
    for i in range(20):  # near copies
        w = list(near)
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((2000 + i, "\n".join(w)))
    rows.append((3000, " ".join(["tick", "tock", "tack"] * 40)))  # periodic
    rows.append((3001, " ".join(["tick", "tock", "tack"] * 9)))
    rows.append((3002, " ".join(["one"] * 70)))
    rows.append((3003, " ".join(passage[10:35])))
    rows.append((3004, " ".join(passage[10:29])))
    return rows


@pytest.mark.parametrize("hot", [100_000, 3])
def test_planted_passages(spark, hot):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(repeated_passages(df, shard_words=300, hot=hot)) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward()
    pairs = [(r[0], r[1]) for r in rows]
    assert result(repeated_passages(frame(spark, rows, extra=True))) == brute(pairs)


def test_repeated_ids_and_equal_rows(spark):
    same = prose(40, 1)
    rows = [(1, prose(30, 7) + " " + same)] * 3 + [(1, prose(25, i) + " " + same) for i in range(30)] + [(None, same)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeated_passages(df)) == brute(rows)


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_other_lengths(spark):
    rows = planted(seed=8, n=25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeated_passages(df, window=7, gram=3)) == brute(rows, 7)


def test_spans_cover_removed_words(spark):
    rows = planted(seed=9, n=20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in repeated_passages(df).collect():
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]
        assert all(a["to"] < b["from"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_equal_windows_have_equal_anchors():
    r = random.Random(1)
    words = [r.choice("abcd").encode() for _ in range(4000)]
    (a, first, n), = anchor_runs([words], 6, 3)
    of = {}
    for anchor, s, k in zip(a.tolist(), first.tolist(), n.tolist()):
        for i in range(s, s + k):
            assert of.setdefault(tuple(words[i : i + 6]), anchor) == anchor
    assert n.sum() == len(words) - 5 and n.max() <= 4


def test_shard_finds_first_place():
    s = Shard(3)
    s.add(b"a b c d", 2, (0, 5, 0, 0, 10), ("x",))
    s.add(b"b c d e", 1, (0, 4, 0, 0, 0), ("y",))
    found = {k[0]: (hits, firsts) for k, _, hits, firsts in s.matches()}
    assert found == {"x": ([0, 1], [0]), "y": ([0], [0])}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").collect()]
    got = sorted([tuple(r) for r in op13(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)
    assert got == brute(rows)
