import random

import pytest

from tests.llm.cases import awkward, frame, prose
from verdikt.llm import license_scan as s

SCAN = s.Scanner(s.TEMPLATES)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("name", sorted(s.TEMPLATES))
def test_templates_are_found_in_long_texts(name):
    text = prose(5000, 1) + "\n" + s.TEMPLATES[name] + ".\n" + prose(5000, 2)
    found = SCAN.scan(text.encode())
    assert [(f[0], f[3]) for f in found] == [(name, 1.0)]
    words = s.words_of(text.encode())
    assert words[found[0][1] : found[0][2]] == s.words_of(s.TEMPLATES[name].encode())


def test_copies_edits_and_near_misses():
    mit = s.TEMPLATES["MIT permission"]
    words = mit.split(" ")
    edited = " ".join(w if i % 8 else "changed" for i, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    text = f"{mit} {mit}\n{prose(300, 5)} {edited} {prose(300, 6)} {half}"
    found = [(f[0], round(f[3], 2)) for f in SCAN.scan(text.encode())]
    assert [f[0] for f in found] == ["MIT permission"] * 3
    assert found[0][1] == found[1][1] == 1 and 0.8 <= found[2][1] < 0.95


DUAL = [
    ("Licensed under the MIT License or licensed under the Apache License, Version 2.0", "Apache-2.0 notice"),
    ("Licensed under CC BY 4.0. Licensed under the Apache License, Version 2.0", "Apache-2.0 notice"),
    ("Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0", "CC-BY-4.0 notice"),
    ("Released under the MIT License. Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 notice"),
]


@pytest.mark.parametrize("offset", range(16))
@pytest.mark.parametrize("line, name", DUAL)
def test_both_licenses_of_a_line_are_found(line, name, offset):
    whole = s.words_of(s.TEMPLATES[name].encode())
    text = ("x " * offset + line + " y" * 9).encode()
    words = s.words_of(text)
    found = SCAN.scan(text)
    assert any(f[0] == name and f[3] == 1 and words[f[1] : f[2]] == whole for f in found) and len(found) == 2


@pytest.mark.parametrize("name", ["Apache-2.0 notice", "CC-BY-4.0 notice", "MIT notice", "GPL-3.0 header"])
@pytest.mark.parametrize("copies", [2, 3, 5])
def test_adjacent_copies_are_found_at_every_offset(name, copies):
    size = len(s.words_of(s.TEMPLATES[name].encode()))
    for offset in range(size if size < 20 else 4):
        found = SCAN.scan(("x " * offset + f"{s.TEMPLATES[name]}. " * copies).encode())
        assert found == [(name, offset + k * size, offset + (k + 1) * size, 1.0) for k in range(copies)]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_against_longest_common_subsequence(seed):
    r = random.Random(seed)
    b = [f"{i if r.random() < 0.8 else r.randrange(5)}" for i in range(40)]
    a = [w for w in b if r.random() < 0.9]
    for _ in range(5):
        a.insert(r.randrange(len(a)), r.choice("xyz"))
    pairs = s.align(a, 0, len(a), b, 0, len(b))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b) and len(pairs) >= 0.9 * lcs(a, b)


def test_increasing():
    for seed in range(50):
        v = random.Random(seed).sample(range(30), 12)
        got = s.increasing(v)
        assert all(i < j and v[i] < v[j] for i, j in zip(got, got[1:]))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best)


def test_lines_of_the_documents_are_found(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: (r["n_finds"], r["finds"]) for r in s.op3(spark, d).collect()}
    lines = {"Released under the MIT License": "MIT notice", "Licensed under the Apache License, Version 2.0": "Apache-2.0 notice", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0 notice", "GNU General Public License, version 3": "GPL-3.0 notice"}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    for r in docs:
        want = [n for x, n in lines.items() if x in r["text"]]
        assert got[r["doc_id"]][0] >= len(want) and all(f'"{n}"' in got[r["doc_id"]][1] for n in want)
    assert sum(n for n, _ in got.values()) < 0.1 * len(docs)


def test_awkward_rows_and_empty_table(spark):
    rows = awkward() + [(99, s.TEMPLATES["MIT notice"] * 2, "en", "a", 0)]
    got = frame(spark, rows, extra=True).withColumn("finds", s.finds_udf()("text")).collect()
    for r in got:
        assert [tuple(f) for f in r["finds"]] == SCAN.scan((r["text"] or "").encode())
    assert frame(spark, []).withColumn("finds", s.finds_udf()("text")).count() == 0


@pytest.mark.parametrize(("name", "less", "copies"), [("BSD conditions", 2, 2), ("MIT permission", 4, 6), ("Apache-2.0 header", 2, 6), ("ISC permission", 5, 9), ("GPL-3.0 header", 1, 3)])
def test_copies_side_by_side_that_lack_their_last_words(name, less, copies):
    words = s.words_of(s.TEMPLATES[name].encode())
    copy = words[: len(words) - less]
    found = [f for f in s.Scanner(s.TEMPLATES).scan(b" ".join(copy * copies)) if f[0] == name]
    assert len(found) == copies
    for i, (_, start, end, _) in enumerate(found):  # each is its copy, but for words at the edges
        own = min(end, (i + 1) * len(copy)) - max(start, i * len(copy))
        assert own >= 0.85 * len(copy) and end - start - own <= less


def test_disjoint_finds_against_every_choice():
    import itertools
    import random

    r = random.Random(7)
    for _ in range(300):
        found = []
        for i in range(r.randint(0, 7)):
            a = r.randint(0, 20)
            n = r.randint(1, 8)
            found.append((f"t{i}", a, a + n, round(r.random(), 2), r.randint(1, n)))
        got = s.disjoint(found)
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))
        best = max(
            (sum(f[4] for f in c), -sum(f[2] - f[1] for f in c))
            for k in range(len(found) + 1)
            for c in itertools.combinations(found, k)
            if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(c, 2))
        )
        assert (sum(f[4] for f in got), -sum(f[2] - f[1] for f in got)) == best
