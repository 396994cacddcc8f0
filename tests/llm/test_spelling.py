"""Spelling groups against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.cases import DOCS, awkward, frame
from verdikt.llm.common import saved, table
from verdikt.llm.spelling import affected, decompose, listed, near_pairs, op12, spelling_groups


def brute_words(rows, min_chars=6, min_count=5):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= min_chars and n >= min_count}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, **how):
    words = brute_words(rows, **how)
    near = {w: [] for w in words}
    alphabet = sorted({c for w in words for c in w})
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in alphabet for k in (0, 1) if i + k <= len(w)}
        near[w] = [x for x in edits if x in words and x != w]
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=str)


def corpus(seed, n=400, letters="abcé"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 12))) for _ in range(120)]
    base += ["long" * 20, "long" * 20 + "x", "y" + "long" * 20, "a" * 63, "a" * 64, "a" * 65, "a" * 66, "a" * 300, "a" * 299]
    rows = []
    for i in range(n):
        words = [r.choice(base) for _ in range(60)]
        for k in range(len(words)):
            if r.random() < 0.2:
                w = words[k]
                p = r.randrange(len(w))
                words[k] = [w[:p] + w[p + 1 :], w[:p] + r.choice(letters) + w[p:], w[:p] + r.choice(letters) + w[p + 1 :]][r.randrange(3)]
        rows.append((i if i % 50 else None, " ".join(words).title() if i % 3 else ", ".join(words)))
    return rows


@pytest.mark.parametrize("frequent", [5000, 40])
def test_variants_of_few_letters(spark, frequent):
    rows = corpus(frequent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows)
    assert sum(r[1] is not None for r in expected) > 20
    assert result(spelling_groups(df, frequent=frequent)) == expected


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward() * 3
    assert result(spelling_groups(frame(spark, rows, extra=True))) == brute([(r[0], r[1]) for r in rows])


def test_ties_and_chains(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdhh": 125, "zzzzzz": 5, "zzzzzzz": 24}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = {r[0]: r for r in result(spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), noise=10**12))}
    assert got["abcdef"][1:3] == ("abcdeg", "abcdeg") and got["abcdef"][4] == 2
    assert got["abcdeh"][1:3] == ("abcdhh", "abcdhh")
    assert got["zzzzzz"][1:] == (None, "zzzzzz", 5, 1, None)


def test_empty_table(spark):
    assert spelling_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_many_words_of_one_stem(spark):
    r = random.Random(2)
    words = sorted({"inter" + "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(1500)})
    df = saved(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), "w")
    got = {(r["a"], r["b"]) for r in near_pairs(df, frequent=50).collect()}
    want = {(a, b) for a in words for b in words if is_near(a, b) and (len(a) < len(b) or len(a) == len(b) and a < b)}
    assert got == want and len(want) > 500


def test_bound_holds_for_every_edit():
    r = random.Random(3)
    for _ in range(3000):
        w = "".join(r.choice("ab") for _ in range(r.randint(6, 14)))
        frequent = {g: r.randint(1, 3) for g in {w[p : p + q] for q in range(2, 7) for p in range(len(w) - q + 1)} if r.random() < 0.6}
        p = r.randrange(len(w) + 1)
        other = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("abc") + w[p:], w[:p] + r.choice("abc") + w[p + 1 :]])
        if len(other) < 6 or other == w:
            continue
        size = min(len(w), len(other))
        longest = min(8, size - 2)
        grams = decompose(w, frequent, 2, longest)
        b = affected(grams, len(w))
        assert len(grams) - b >= 1
        kept = Counter(g for _, g, _ in grams) & Counter(g for _, g, _ in decompose(other, frequent, 2, longest))
        assert kept.total() >= len(grams) - b
        assert listed(w, size, frequent, 2, 8, 64) & listed(other, size, frequent, 2, 8, 64)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").collect()]
    assert result(op12(spark, d)) == brute(rows)
