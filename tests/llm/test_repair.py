"""Conversation repair against a plain search over every edit."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from verdikt.llm.common import table
from verdikt.llm.repair import GONE, Rope, cheapest, matrices, op11, product, repair, repair_grammar

ROWS = "conv_id long, turn long, role string, text string"


def digest(text):
    """Spark's xxhash64 of a text, with and without a second value: only for order."""
    s = lambda v: v - (1 << 64) if v >> 63 else v
    return s(xxhash.xxh64_intdigest(text.encode(), 42))


def search(rows):
    """rows (role, text, must_go, cut_off) -> cost, audit, lines: least by (cost,
    audit) over states reached, tried edit by edit."""
    # state: last role initial kept ('' start)
    best = {"": (0, "", [])}

    def inserted(b):
        for _ in range(3):
            for st, (c, a, lines) in list(b.items()):
                new = "a" if st == "u" else "u"
                e = (c + 5, a + "I", [*lines, ("assistant" if new == "a" else "user") + ":"])
                if new not in b or e[:2] < b[new][:2]:
                    b[new] = e
        return b

    for role, text, must_go, cut in rows:
        best = inserted(best)
        new = {}

        def offer(st, e):
            if st not in new or e[:2] < new[st][:2]:
                new[st] = e

        for st, (c, a, lines) in best.items():
            offer(st, (c + 2, a + "D", lines))
            if must_go:
                continue
            nxt = "a" if st == "u" else "u"
            more = 5 if cut else 0
            i = role[:1]
            if i == nxt or (st == "" and i == "s"):
                offer(i, (c + more, a + "K", [*lines, f"{role}:{text}"]))
            offer(nxt, (c + more + 1, a + "R", [*lines, ("assistant" if nxt == "a" else "user") + f":{text}"]))
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda e: e[:2])


def brute(rows, convs=()):
    """rows (conv, turn, role, text) -> {conv: result}."""
    by = defaultdict(list)
    for c in convs:
        by[c]
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, items in by.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
        seen, states = set(), []
        n = dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in items:
            solid = text.strip(" \t\n\x0b\x0c\r")
            f = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            if f:
                n[f] += 1
            seen.add((role, text))
            states.append((role, text, f in ("blank", "duplicate"), f == "truncated"))
        ini = [(s[0][:1] or " ") for s in states]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        turns = {t for t, *_ in items if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = search(states)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def result(df, conv="conv"):
    return {r[conv]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def awkward(seed=1, n=150):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        conv = None if c == 7 else c * 1_000_003
        for t in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"])
            text = r.choice(["Yes.", "No!", "So?", "cut off", "", None, " \t\n\x0b\x0c\r", "Yes. ", "end\n", f"{t}.", "a ", "x" * 5000 + "."])
            rows.append((conv, None if r.random() < 0.05 else t + r.randint(0, 2) * (r.random() < 0.2), role, text))
        if c % 10 == 0:
            rows += rows[-2:]
    return rows


@pytest.mark.parametrize("piece", [4096, 3])
def test_awkward_conversations(spark, piece):
    rows = awkward()
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    assert result(repair(df, piece=piece)) == brute(rows)


def test_one_long_conversation(spark):
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant", "tool"]), r.choice(["Yes.", f"{t}.", "cut", f"{t}", ""])) for t in range(6000)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(40)]
    df = spark.createDataFrame(rows, ROWS)
    assert result(repair(df, piece=500)) == brute(rows)


def test_clashing_columns_and_emptied_conversations(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, ROWS)
    for c in ("conv", "kind", "d1", "later", "audit", "whole"):
        df = df.withColumn(c, F.lit("theirs"))
    convs = spark.createDataFrame([(1,), (5,), (None,), (None,)], "conv_id long")
    got = result(repair(df, convs=convs))
    assert got == brute(rows, convs=[1, 5, None])
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert repair(spark.createDataFrame([], ROWS)).count() == 0


def test_matrices_against_search():
    r = random.Random(2)
    seqs = ["".join(r.choice(GONE + "suaoSUAO") for _ in range(r.randint(1, 12))) for _ in range(800)]
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for s, m in zip(seqs, matrices(seqs)):
        states = [("x", "", True, False) if c == GONE else (role[c.lower()], "", False, c.isupper()) for c in s]
        assert cheapest(m) == search(states)[:2]


def test_grammar_restores_its_sequences_and_shares_rules():
    r = random.Random(3)
    seqs = ["".join(r.choice("uaS") for _ in range(r.randint(0, 60))) for _ in range(60)] + ["ua" * 512, "u" * 100, ""]
    short, rules = repair_grammar(seqs)

    def grown(x):
        return x if isinstance(x, str) else "".join(map(grown, rules[x]))

    assert ["".join(map(grown, s)) for s in short] == seqs
    assert sum(map(len, short)) + 2 * len(rules) < 0.8 * sum(map(len, seqs))
    left = [(a, b) for s in short for a, b in zip(s, s[1:]) if a != b]
    assert len(left) == len(set(left))


def test_ropes_compare_as_texts():
    r = random.Random(5)
    made = [Rope(c) for c in "DIKR"] + [Rope("")]
    for _ in range(500):
        a, b = r.choice(made), r.choice(made)
        if a.size + b.size < 4000:
            made.append(a + b)
    for _ in range(3000):
        a, b = r.choice(made), r.choice(made)
        assert (a < b) == (str(a) < str(b))


def test_product_is_associative():
    (a,), (b,), (c,) = matrices(["uaSo"]), matrices(["aDu"]), matrices(["UUa"])
    flat = lambda m: [[e and (e[0], str(e[1])) for e in line] for line in m]
    assert flat(product(product(a, b), c)) == flat(product(a, product(b, c)))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(op11(spark, d), "conv_id") == brute(brute_damage(rows), convs=[r[0] for r in rows])
