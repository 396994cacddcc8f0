import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import awkward, frame, prose
from verdikt.llm import lcp


def slow_labels(z):
    """Labels of one text by the definition, symbol by symbol."""
    def toss(a):
        out = [a[0] & 1]
        for l, x in zip(a, a[1:]):
            k = ((l ^ x) & -(l ^ x)).bit_length() - 1
            out.append(2 * k + (x >> k & 1))
        return out

    a = z
    for _ in range(4):
        a = toss(a)
    for v in (5, 4, 3):
        b = list(a)
        for i, x in enumerate(a):
            if x == v:
                b[i] = min({0, 1, 2} - {a[j] for j in (i - 1, i + 1) if 0 <= j < len(a)})
        a = b
    return a


def slow_starts(a):
    n = len(a)
    around = lambda i: [a[j] for j in (i - 1, i + 1) if 0 <= j < n]
    top = [all(a[i] > x for x in around(i)) for i in range(n)]
    low = [all(a[i] < x for x in around(i)) and not any(top[j] for j in (i - 1, i + 1) if 0 <= j < n) for i in range(n)]
    return [i for i in range(n) if i == 0 or top[i] or low[i]]


@pytest.mark.parametrize("seed", range(20))
def test_labels_and_phrases_equal_definition(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        t = [r.randrange(1, 5000)]
        for _ in range(r.randrange(0, 60)):
            t.append(r.choice([x for x in (r.randrange(1, 40), r.randrange(1, 5000), t[-1] + 1) if x != t[-1]]))
        texts.append(t)
    z = np.array([x for t in texts for x in t], np.uint32)
    first = np.cumsum([0, *map(len, texts)])[:-1]
    a = lcp.labels(z, first)
    starts = lcp.phrase_starts(a, first)
    for f, t in zip(first, texts):
        want = slow_labels(t)
        assert a[f : f + len(t)].tolist() == want and set(want) <= {0, 1, 2}
        assert all(x != y for x, y in zip(want, want[1:]))
        assert [s - f for s in starts if f <= s < f + len(t)] == slow_starts(want)
    assert max(np.diff(np.r_[starts, len(z)])) <= 4


def test_equal_substrings_share_interior_names():
    shared = prose(400, 4)
    for level, margin in ((2, 40), (4, 400)):
        names = []
        for before, after in (("", "tail"), ("another beginning of 37 odd characters", ""), ("zz", "end" * 50)):
            text = before + shared + after
            one, first = [np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0])]
            names.append(_names(text, level))
        common = names[0] & names[1] & names[2]
        assert len(common) >= 0.8 * min(map(len, names)) - margin / 30


def _names(text, level):
    x, first = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0])
    for _ in range(level):
        x, first = lcp.level_up(x, first)
    return set(x.tolist())


def test_texts_do_not_influence_each_other():
    texts = [prose(n, n) for n in (1, 2, 3, 50, 300)] + ["", "a", "aaaa", "ab", "abab" * 9, "\U0001f600é▁"]
    whole = lcp.sketches(texts)
    for t, s in zip(texts, whole):
        assert lcp.as_text(lcp.sketches([t])[0]) == lcp.as_text(s)
    assert lcp.as_text(lcp.sketches([""])[0]) == "-"


def slow(rows):
    """Results by the contract, one row after the other."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = (lcp.sketches([x])[0] for x in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), lcp.as_text(a), lcp.as_text(b), lcp.likeness(a, b), lcp.likeness(a, c)))
    return out


@pytest.mark.parametrize("shard", [lcp.IDS_PER_SHARD, 4])
def test_results_equal_brute_force(spark, shard):
    rows = awkward()
    got = [tuple(r) for r in lcp.fingerprints(frame(spark, rows, extra=True), ids_per_shard=shard).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(slow([(r[0], r[1]) for r in rows]), key=key)


def test_chunks_do_not_matter(spark, monkeypatch):
    rows = [(i, prose(30, i), "en", "a", 0) for i in range(50)]
    fields = lambda b: [tuple(r.values()) for x in b for r in x.to_pylist()]
    import pyarrow as pa

    batch = lambda: iter([pa.RecordBatch.from_pydict({"shard": [i // 20 for i in range(k, k + 10)], "doc_id": list(range(k, k + 10)), "text": [rows[i][1] for i in range(k, k + 10)]}) for k in range(0, 50, 10)])
    whole = fields(lcp.shard_pass(batch()))
    monkeypatch.setattr(lcp, "CHUNK", 300)
    key = lambda r: str(r)
    assert sorted(fields(lcp.shard_pass(batch())), key=key) == sorted(whole, key=key)


def test_likeness():
    a, b = prose(500, 1), prose(500, 2, 300)
    s = lambda t: lcp.sketches([t])[0]
    assert lcp.likeness(s(a), s(a)) == 1 and lcp.likeness(s(""), s("")) == 1 and lcp.likeness(s(a), s("")) == 0
    near = a[:1500] + "X" + a[1501:]
    assert lcp.likeness(s(a), s(near)) > 0.7 > lcp.likeness(s(a), s(lcp.edited(a, b))) > lcp.likeness(s(a), s(b))


def test_a_word_changed_in_a_long_text_shows():
    text = prose(20_000, 1, 3000)
    words = text.split(" ")
    whole = lcp.sketches([text])[0]
    for k in range(1000, 20_000, 1500):
        other = lcp.sketches([" ".join([*words[:k], "changed", *words[k + 1 :]])])[0]
        assert lcp.as_text(whole) != lcp.as_text(other) and 0.98 < lcp.likeness(whole, other) < 1


def test_a_shared_passage_shows_in_long_texts():
    """The names that two texts share through 100 words of 10,000, beside those they share anyway."""
    found = 0
    for seed in range(10):
        a, b = prose(10_000, 100 + seed, 3000), prose(10_000, 200 + seed, 2000)
        shared = prose(100, 300 + seed, 2500)
        x, y, z = lcp.sketches([a + shared + a[::-1], b[::-1] + shared + b, b[::-1] + b])
        found += any(len(np.setdiff1d(np.intersect1d(p, q), r)) for p, q, r in zip(x[1:], y[1:], z[1:]))
    assert found >= 8


def test_names_follow_the_length_and_tell_texts_apart():
    texts = [prose(n, 7, 3000) for n in (100, 1000, 10_000)]
    count = [sum(map(len, x)) for x in lcp.sketches(texts)]
    assert count[1] > 2 * count[0] and count[2] > 7 * count[1]
    short = ["a", "aa", "aaa", "ab", "ba", "abab", "ababab", "b"]
    assert len({lcp.as_text(x) for x in lcp.sketches(short)}) == len(short)


def test_one_row_and_empty_table(spark):
    r = lcp.fingerprints(frame(spark, [(4, "abcdef", "en", "a", 1)])).collect()
    assert len(r) == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r[0]["near_next"] == 1
    assert lcp.fingerprints(frame(spark, [])).count() == 0


def slow_any_ids(rows):
    """As ``slow``, rows of one id ordered by their text's hash."""
    import xxhash

    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    nexts = [r[1] for r in rows[1:] + rows[:1]]
    edits = [lcp.edited(t, n) for (_, t), n in zip(rows, nexts)]
    a, b, c = (lcp.sketches(x) for x in ([t for _, t in rows], edits, nexts))
    return [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), lcp.as_text(p), lcp.as_text(q), lcp.likeness(p, q), lcp.likeness(p, r)) for (d, t), e, p, q, r in zip(rows, edits, a, b, c)]


@pytest.mark.parametrize("id_of", [lambda i: i * 1_000_003, lambda i: None, lambda i: 7, lambda i: [None, 7, i][i % 3]])
def test_any_ids_equal_brute_force(spark, id_of):
    """Sparse ids, none at all, one id for all rows, and all of these."""
    rows = [(id_of(i), None if i % 97 == 0 else prose(5 + i % 30, i % 250), "en", "a", 0) for i in range(600)]
    found = lcp.fingerprints(frame(spark, rows), ids_per_shard=50)
    got = [tuple(r) for r in found.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(slow_any_ids([(r[0], r[1]) for r in rows]), key=key)
