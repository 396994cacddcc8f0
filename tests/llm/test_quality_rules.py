import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import awkward, frame
from verdikt.llm import quality_rules as q
from verdikt.llm.common import unpacked

WORD = r"[^\x20\x09-\x0D]+"


def slow_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\r\x0b\x1c #|", max_size=80))
def test_counts_equal_plain_rules(text):
    assert q.base_counts(text.encode()) == slow_counts(text)


def slow_verdicts(rows):
    """kept for (text, lang, source) rows, with exact fractions and full sorts."""
    facts = [slow_counts(r[0]) for r in rows]
    failed = [c[0] < 50 or 100 * c[5] > 50 * c[0] for c in facts]
    rate = lambda c: {
        "symbol_rate": c[2] * 10**6 // max(c[1], 1),
        "dup_line_rate": c[4] * 10**6 // max(c[3], 1),
        "repeat_rate": c[5] * 10**6 // max(c[0], 1),
        "word_length": c[1] * 1000 // max(c[0], 1),
    }
    rates = [rate(c) for c in facts]
    low = lambda v: v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6)

    def fence(group, m):
        v = sorted(low(rates[i][m]) for i in group)
        at = lambda k: v[-(-k * len(v) // 4) - 1]
        spread = q.SPREAD * (at(3) - at(1))
        _, up, down = q.MEASURES[m]
        return at(3) + spread + up, at(1) - spread - (down or 0)

    out = []
    for i, r in enumerate(rows):
        own = [j for j, s in enumerate(rows) if s[1:] == r[1:] and not failed[j]]
        pool = [j for j, s in enumerate(rows) if s[1] == r[1] and not failed[j]]
        good = not failed[i]
        for m in q.MEASURES if good else ():
            (h1, l1), (h2, l2) = fence(own, m), fence(pool, m)
            mix = lambda a, b: floor(Fraction(len(own) * a + q.PRIOR * b, len(own) + q.PRIOR))
            good &= rates[i][m] <= mix(h1, h2) and (q.MEASURES[m][2] is None or rates[i][m] >= mix(l1, l2))
        out.append(good)
    return out


def test_verdicts_equal_brute_force(spark):
    rows = awkward()
    rows += [(100 + i, " ".join(f"w{j}%%%" for j in range(80)), "en", "a", 1) for i in range(2)]
    rows += [(110, "\n".join(f"a line of words that repeats {i % 2} and so on" for i in range(40)), "de", "b", 1)]
    got = q.quality_rules(frame(spark, rows, extra=True)).select("_row.doc_id", "_row.text", "_row.lang", "_row.source", "kept").collect()
    want = slow_verdicts([(r[1], r[2], r[3]) for r in rows])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=key) == sorted(((r[0], r[1], r[2], r[3], w) for r, w in zip(rows, want)), key=key)
    by_id = {r[0]: r[4] for r in got}
    assert by_id[1] and not by_id[100] and not by_id[110] and not by_id[3]


def test_columns_come_back_and_empty_table(spark):
    df = frame(spark, awkward(), extra=True)
    assert unpacked(q.quality_rules(df).where("kept")).columns == df.columns
    assert q.quality_rules(frame(spark, [])).count() == 0


@pytest.mark.parametrize("v", [0, 1, 63, 64, 65, 127, 128, 999_999, 10**12])
def test_bucket_holds_its_value(spark, v):
    low, nxt = spark.range(1).selectExpr(f"cast({v} as bigint) as v").selectExpr(f"{q.bucket('v')} as b").selectExpr(q.bucket_floor("b"), q.bucket_floor("(b + 1)")).first()
    assert low <= v < nxt and (v - low) * 32 <= v
