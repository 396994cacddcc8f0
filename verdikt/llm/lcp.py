"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. At each level runs of one symbol
become one symbol, deterministic coin tossing gives every symbol one of three
labels that differs from its neighbours' (four rounds of "lowest bit in which I
differ from my left neighbour", then 6 -> 3), and phrases start at local maxima
of the labels and at minima that touch no maximum, so they hold 2 or 3 symbols.
A phrase's name is a hash of its symbols and becomes a symbol of the next
level. A phrase depends only on a bounded neighbourhood, so equal substrings
get the same names inside, whatever their offset.

A text is parsed up to the level where it is one phrase. The fingerprint keeps
names in proportion to the text's length: for each level of ``LEVELS`` all
distinct 32-bit names in the lowest 1 / ``RATES`` of their range (the ``KEEP``
smallest at least), all names from level ``UPPER`` on, and the 64-bit name of the
whole text, which tells texts apart. Likeness is the mean of two estimated
Jaccard shares, that of the names of the first level and that of the second
level's and all upper names (1 only if no upper name differs).

Several texts are parsed together in numpy.

Defined cases: a null text is empty; an empty text has the fingerprint "-"
and likeness 1 to other empty texts, 0 to all else. Rows are ordered by id
(null ids first), rows without an id and rows that repeat one by a hash of the
text; a row's next document is the following row, the first row's after the
last. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import col, prepare, saved, table
from verdikt.llm.ranges import shard_of, shards

LEVELS = (2, 4)
RATES = (32, 4)
KEEP = 16
UPPER = 7
IDS_PER_SHARD = 4096
CHUNK = 1 << 20  # code points held at once
TOGETHER = 1 << 16  # code points parsed at once

U = np.uint64
_K = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _toss_table(size: int) -> np.ndarray:
    """label of (left, own): twice the lowest differing bit plus own's bit there."""
    left, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = left ^ own
    k = np.zeros_like(differ)
    odd = differ > 0
    k[odd] = np.log2(differ[odd] & -differ[odd]).astype(int)
    return (2 * k + ((own >> k) & 1)).astype(np.uint8).ravel()


_TOSS = [(7, _toss_table(128)), (4, _toss_table(16)), (3, _toss_table(8))]
# The smallest of 0, 1, 2 that neither neighbour has (7: no neighbour).
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(8)] for a in range(8)], np.uint8)


def labels(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each symbol, differing from its neighbours in its text.
    Neighbouring symbols differ; ``first`` has the places of texts' first
    symbols, which have no left neighbour and are tossed on their lowest bit."""
    a = np.empty(len(z), np.uint8)
    one = z.dtype.type(1)
    low = z[1:] ^ z[:-1]
    low &= ~low + one
    a[1:] = np.bitwise_count(low - one) * np.uint8(2) + ((z[1:] & low) != 0)
    a[first] = z[first] & one
    for bits, toss in _TOSS:
        alone = a[first] & 1
        pair = a[:-1].astype(np.uint16)
        pair <<= bits
        pair |= a[1:]
        toss.take(pair, out=a[1:], mode="clip")
        a[first] = alone
    last = np.r_[first[1:] - 1, len(z) - 1]
    starts, ends = np.zeros(len(z), bool), np.zeros(len(z), bool)
    starts[first], ends[last] = True, True
    for v in (5, 4, 3):
        at = np.flatnonzero(a == v)
        l, r = a[at - 1], a[np.minimum(at + 1, len(a) - 1)]
        l[starts[at]], r[ends[at]] = 7, 7
        a[at] = _FREE[l, r]
    return a


def phrase_starts(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where a phrase starts: texts' first symbols and landmarks."""
    last = np.r_[first[1:] - 1, len(a) - 1]
    rise = np.empty(len(a) + 1, bool)  # place i is above place i - 1; across texts: both sides count as above
    rise[1:-1] = a[1:] > a[:-1]
    rise[0] = rise[-1] = True
    top = rise[:-1] & ~rise[1:]
    low = ~rise[:-1] & rise[1:]
    # Beyond a text's edge lies nothing, which is below a maximum and above a minimum.
    right = a[first + 1 - (first == last)]
    top[first], low[first] = a[first] > right, a[first] < right
    left = a[last - 1 + (first == last)]
    top[last], low[last] = a[last] > left, a[last] < left
    near = top.copy()
    near[1:] |= top[:-1]
    near[:-1] |= top[1:]
    edge = first[1:]
    near[edge] = top[edge] | top[np.minimum(edge + 1, len(a) - 1)]
    near[edge - 1] = top[edge - 1] | top[np.maximum(edge - 2, 0)]
    low &= ~near
    low |= top
    low[first] = True
    return np.flatnonzero(low)


def level_up(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first) of the next level; ``first`` has the places of texts' first symbols."""
    new = np.empty(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    if not new.all():
        head = np.flatnonzero(new)
        run = np.diff(head, append=len(x))
        x, first = x[head], np.searchsorted(head, first)
        # A run is one symbol; runs of different symbols stay different.
        long = np.flatnonzero(run > 1)
        runs = mix(x[long].astype(U) * _K + run[long].astype(U))
        x[long] = runs if x.dtype == U else (runs >> U(32)).astype(np.uint32) | np.uint32(1 << 31)
    start = phrase_starts(labels(x, first), first)
    size = np.diff(start, append=len(x))
    name = x[start].astype(U) + _K
    name *= _K
    for j in range(1, int(size.max())):
        at = np.flatnonzero(size > j)
        name[at] = mix(name[at] + x[start[at] + j]) * _K
    return mix(name), np.searchsorted(start, first)


def parse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, places of texts' first names) of each level up to the last of ``LEVELS`` for texts that aren't empty."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    first = np.cumsum([0, *(len(p) for p in points)])[:-1]
    x = np.concatenate(points)  # runs are named above all code points
    found = []
    for _ in range(max(LEVELS)):
        x, first = level_up(x, first)
        found.append((x, first))
    return found


def sizes(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(first, append=len(x))


def upper(x: np.ndarray, first: np.ndarray, roots: np.ndarray) -> list[np.ndarray]:
    """The distinct 32-bit names from ``UPPER`` on for texts parsed up to the
    last of ``LEVELS``. ``roots`` has the names of texts that are one phrase, or 0;
    the others' are written to it."""
    n, own = len(first), np.flatnonzero(roots == 0)
    # Texts that are one phrase are parsed no further.
    going = np.repeat(roots == 0, sizes(x, first))
    size = sizes(x, first)[own]
    x, first = x[going], np.cumsum(size) - size
    level, found = max(LEVELS), [np.zeros(0, U)]
    while len(own):
        x, first = level_up(x, first)
        level += 1
        size = sizes(x, first)
        if level >= UPPER:
            found.append(np.repeat(own, size).astype(U) << U(32) | x >> U(32))
        whole = size == 1
        if whole.any():
            roots[own[whole]] = x[first[whole]]
            x, own, size = x[~np.repeat(whole, size)], own[~whole], size[~whole]
            first = np.cumsum(size) - size
    both = np.unique(np.concatenate(found))
    return np.split(both.astype(np.uint32), np.searchsorted(both, np.arange(1, n).astype(U) << U(32)))


def groups(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts to parse together: small arrays stay in the CPU's cache."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if t:
            part.append(i)
            size += len(t)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """For each text, its names kept: one array per level of ``LEVELS``, the upper names, the whole text's."""
    none = [np.zeros(0, np.uint32) for _ in range(len(LEVELS) + 1)] + [np.zeros(0, U)]
    out = [none for _ in texts]
    places: list[int] = []
    last: list[np.ndarray] = []
    length: list[np.ndarray] = []
    roots: list[np.ndarray] = []
    for part in groups(texts):
        levels = parse([texts[i] for i in part])
        kept: list[list[np.ndarray]] = [[] for _ in part]
        root = np.zeros(len(part), U)
        for level, (names, first) in enumerate(levels, 1):
            one = (sizes(names, first) == 1) & (root == 0)
            root[one] = names[first[one]]
            if level not in LEVELS:
                continue
            rate = RATES[LEVELS.index(level)]
            short = (names >> U(32)).astype(np.uint32)
            for k, (a, b) in enumerate(zip(first, [*first[1:], len(short)])):
                own = np.unique(short[a:b])
                kept[k].append(own[: max(KEEP, int(np.searchsorted(own, (1 << 32) // rate)))])
        for i, sketch in zip(part, kept):
            out[i] = sketch
        places += part
        last.append(levels[-1][0])
        length.append(sizes(*levels[-1]))
        roots.append(root)
    if places:
        # Few names are left, so all groups go on together.
        size, root = np.concatenate(length), np.concatenate(roots)
        for i, names, r in zip(places, upper(np.concatenate(last), np.cumsum(size) - size, root), root[:, None]):
            out[i] += [names, r]
    return out


def as_text(sketch: list[np.ndarray]) -> str:
    return "-".join(s.astype(s.dtype.newbyteorder(">")).tobytes().hex() for s in sketch) if len(sketch[-1]) else "-"


def shares(x: np.ndarray, y: np.ndarray, rate: int) -> tuple[float, float]:
    """Estimated numbers of names in both sketches of a level and in either."""
    union = np.union1d(x, y)
    below = int(np.searchsorted(union, (1 << 32) // rate))
    # Both sketches are complete up to there.
    low = union[: max(KEEP, below)]
    scale = rate if below >= KEEP else (1 << 32) / (int(low[-1]) + 1) if len(union) > KEEP else 1.0
    both = np.isin(low, np.intersect1d(x, y, assume_unique=True)).sum()
    return float(both * scale), float(len(low) * scale)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Mean of the shares of names that both hold, at the first level and above it."""
    if not len(a[-1]) and not len(b[-1]):
        return 1.0
    fine, coarse = (shares(x, y, r) for x, y, r in zip(a, b, RATES))
    x, y = a[len(LEVELS)], b[len(LEVELS)]
    both = len(np.intersect1d(x, y, assume_unique=True))
    coarse = coarse[0] + both, coarse[1] + len(x) + len(y) - both
    return (fine[0] / fine[1] + coarse[0] / coarse[1]) / 2


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the next text's first as many."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
# kind 0: a result; 1: the first text of a shard; 2: the last text of a shard, still without its next.
PASS = [("kind", pa.int32()), ("shard", pa.int64()), ("text", pa.string()), *RESULT]
PASS_DDL = f"kind int, shard long, text string, {RESULT_DDL}"


def results(ids: list, texts: list[str], nexts: list[str], prints: list, next_prints: list) -> list[tuple]:
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    out = []
    for i, t, c, p, q, e in zip(ids, texts, changed, prints, next_prints, sketches(changed)):
        out.append((i, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), as_text(p), as_text(e), likeness(p, e), likeness(p, q)))
    return out


def to_batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def shard_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, doc_id, text) in order: results of all but each shard's last row."""
    held: list[tuple] = []  # rows whose next isn't known yet or that wait for a full chunk
    shard = None

    def flush(rows: list[tuple]) -> list[tuple]:
        prints = sketches([r[2] for r in rows])
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
        done = results([rows[i][1] for i in pairs], [rows[i][2] for i in pairs], [rows[i + 1][2] for i in pairs], [prints[i] for i in pairs], [prints[i + 1] for i in pairs])
        return [(0, rows[i][0], None, *d) for i, d in zip(pairs, done)]

    bare = (None,) * (len(RESULT) - 1)
    size = 0
    for b in batches:
        out = []
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if row[0] != shard:
                if held:
                    out.append((2, held[-1][0], held[-1][2], held[-1][1], *bare))
                out.append((1, row[0], row[2], row[1], *bare))
                shard = row[0]
            held.append(row)
            size += len(row[2])
            if size >= CHUNK:
                out += flush(held)
                held, size = held[-1:], 0
        if out:
            yield to_batch(out, PASS)
    if held:
        yield to_batch([*flush(held), (2, held[-1][0], held[-1][2], held[-1][1], *bare)], PASS)


def pair_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, next_text) -> results."""
    for b in batches:
        ids, texts, nexts = (b.column(i).to_pylist() for i in range(3))
        for i in range(0, len(ids), 16):
            part = slice(i, i + 16)
            yield to_batch(results(ids[part], texts[part], nexts[part], sketches(texts[part]), sketches(nexts[part])), RESULT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """One result row per row of ``docs``. Texts are shuffled once, into shards
    of adjacent ids, ``ids_per_shard`` rows or so each; only the texts at the
    shards' edges are moved again."""
    prepare(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    found = shards(rows.groupBy(F.col("doc_id").alias("id"), hashed.alias("h")).agg(F.count("*").alias("n")), ids_per_shard)
    rows = rows.select(shard_of(found, F.col("doc_id"), hashed).alias("shard"), "doc_id", "text")
    rows = rows.repartitionById(found.count, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", hashed, "text")
    x = saved(rows.mapInArrow(shard_pass, PASS_DDL), "phrases")
    # No shard is empty, so the next one is the next number, round to the first.
    before = F.pmod(F.col("shard") - 1, F.lit(found.count))
    firsts = x.where("kind = 1").select(before.alias("shard"), F.col("text").alias("next_text"))
    lasts = x.where("kind = 2").select("shard", "doc_id", "text").join(firsts, "shard")
    rest = lasts.select("doc_id", "text", "next_text").mapInArrow(pair_pass, RESULT_DDL)
    return x.where("kind = 0").select(*[n for n, _ in RESULT]).unionByName(rest)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
