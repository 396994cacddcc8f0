"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one text. A word goes if a window
that covers it also starts earlier: in a row of smaller id, or earlier in the
same text. Windows are judged on the input.

1. One pass signs every text: digests of its word sequence, and the anchors of
   its windows. An anchor is the least of the hashes of a window's ``GRAM``-word
   phrases, so equal windows have equal anchors; neighbouring windows share one,
   which leaves about one anchor in seven words.
2. Texts with the same words fold to the one that comes first; in its copies
   every window repeats, which needs no search.
3. Only windows whose anchor occurs at two places can repeat. Texts that hold
   such anchors are joined to them, and the run of windows of an anchor (at most
   32 words) is cut out. Anchors so frequent that one of them could fill a task
   (at most ``HOT`` of them, by their very frequency) only serve windows that
   have no other, so a common line does not gather all its contexts.
4. Equal runs fold (a passage of millions of texts is one row a map task) and
   are dealt to tasks by anchor. A task confirms windows that occur at two
   places, on the words themselves, compiles an automaton of them every
   ``SHARD_WORDS`` words, and streams the runs through it: each hit is an
   occurrence of a repeated window. A shard holds all windows of its anchors,
   so no text is read by a second shard.
5. Hits go back to every place of the run they were found in, less the place
   where each window starts first.

Defined cases: a null or empty text has no words. Rows are ordered by id, null
ids last; rows of one id by the digest of their words. Of rows with the same
words the first keeps them (of rows that also share the id and text, any one);
the others lose all if they have a window. Words are maximal runs of anything
but ASCII white space and stay as they are. An empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import arrow_udf, col, discard, partitions, prepare, salted_lookup, saved, table, utf8

WINDOW, GRAM = 20, 8
HOT = 100_000
SHARD_WORDS = 200_000
RUN_STEP = 1 << 32

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LATE = np.uint64(1 << 63)


def phrase_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """63-bit hashes of every ``gram`` consecutive word hashes."""
    n = len(words) - gram + 1
    out = words[:n].copy()
    for j in range(1, gram):
        out *= _BASE
        out += words[j : n + j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out & ~_LATE


def anchor_runs(texts: list[list[bytes]], window: int, gram: int, late: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (as words): the anchors of its windows, each with the first
    window of its run and the number of windows. The leftmost least phrase of a
    window is its anchor, so a phrase that comes twice starts a second run.
    Phrases in ``late`` (sorted) rank behind all others."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = sum(map(len, texts))
    if total < window:
        yield from (none for _ in texts)
        return
    h = xxhash.xxh3_64_intdigest
    words = np.fromiter((h(w) for t in texts for w in t), np.uint64, total)
    rank = phrase_hashes(words, gram)
    if late is not None and len(late):
        at = np.minimum(np.searchsorted(late, rank), len(late) - 1)
        rank = np.where(late[at] == rank, rank | _LATE, rank)
    least, span, want = np.arange(len(rank)), 1, window - gram + 1
    while span < want:  # least phrase of every 2, 4, ... and at last `want`
        step = min(span, want - span)
        a, b = least[:-step], least[step:]
        least, span = np.where(rank[b] < rank[a], b, a), span + step
    start = 0
    for t in texts:
        n = len(t) - window + 1
        if n <= 0:
            yield none
        else:
            own = least[start : start + n]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield rank[own[first]] & ~_LATE, first, np.diff(np.r_[first, n])
        start += len(t)


def _split(texts: pa.Array) -> list[list[bytes]]:
    return [t.split() if t else [] for t in utf8(texts)]


def _signed(high: int) -> int:
    return high - (1 << 64) if high >> 63 else high


def signatures(window: int, gram: int):
    """text -> digests of the word sequence, number of words, its SHA-256, anchors."""
    kind = "s1 long, s2 long, n long, sha string, anchors array<long>"

    def sign(texts: pa.Array) -> pa.Array:
        words = _split(texts)
        lines = [b" ".join(w) for w in words]
        prints = [xxhash.xxh3_128_intdigest(x) for x in lines]
        runs = [r[0] for r in anchor_runs(words, window, gram)]
        ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        flat = np.concatenate([*runs, np.zeros(0, np.uint64)]).astype(np.int64)
        return pa.StructArray.from_arrays(
            [
                pa.array([_signed(p >> 64) for p in prints], pa.int64()),
                pa.array([_signed(p & (1 << 64) - 1) for p in prints], pa.int64()),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            names=["s1", "s2", "n", "sha", "anchors"],
        )

    return arrow_udf(sign, kind)


RUN = pa.schema([("a", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("run", pa.binary()), ("num", pa.int64()), ("start", pa.int64())])


def cut_runs(window: int, gram: int, late: np.ndarray):
    """(num, text, anchors) -> the runs of windows of those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _split(b.column("text"))
            wanted = b.column("anchors").to_pylist()
            out = [[] for _ in RUN.names]
            plain = anchor_runs(words, window, gram)
            ranked = anchor_runs(words, window, gram, late) if len(late) else plain
            for num, text, want, own in zip(b.column("num").to_pylist(), words, wanted, plain):
                a, first, n = own
                new_a, new_first, new_n = next(ranked) if ranked is not plain else own
                # Windows whose plain anchor repeats, as stretches ...
                hit = np.isin(a.astype(np.int64), np.array(want, np.int64))
                chosen = np.repeat(hit, n)
                # ... cut at the runs of the ranked anchors.
                label = np.repeat(np.arange(len(new_a)), new_n)
                edge = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (chosen[1:] != chosen[:-1])]) if len(label) else np.zeros(0, int)
                for s, e in zip(edge, np.r_[edge[1:], len(label)]):
                    if chosen[s]:
                        line = b" ".join(text[s : e + window - 1])
                        d = xxhash.xxh3_128_intdigest(line)
                        row = int(new_a[label[s]]), _signed(d >> 64), _signed(d & (1 << 64) - 1), line, num, int(s)
                        for values, v in zip(out, row):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, RUN)], schema=RUN)

    return run


class Shard:
    """Runs of whole anchors: confirm their repeated windows, compile, stream."""

    def __init__(self, window: int):
        self.window, self.runs, self.words = window, [], 0

    def add(self, line: bytes, n: int, place: tuple, key: tuple) -> None:
        words = line.split()
        self.runs.append((words, n, place, key))
        self.words += len(words)

    def matches(self) -> Iterator[tuple[tuple, tuple, list[int], list[int]]]:
        """(key, place, hits, firsts) for each run: the offsets of its repeated
        windows, and of those that at ``place`` are the first occurrence."""
        code: dict[bytes, int] = {}
        # In the order of places, so that what comes first is met first.
        runs = sorted(self.runs, key=lambda r: r[2])
        # One character a word, past the surrogates: equal strings, equal words.
        text = ["".join([chr(i + 0x800 * (i >= 0xD800)) for i in [code.setdefault(w, len(code)) for w in words]]) for words, *_ in runs]
        k = self.window
        first: dict[str, int] = {}  # window -> run * RUN_STEP + offset
        repeated = set()
        for r, (t, run) in enumerate(zip(text, runs)):
            base, copies = r * RUN_STEP, run[1] > 1
            for i in range(len(t) - k + 1):
                w = t[i : i + k]
                if first.setdefault(w, base + i) != base + i or copies:
                    repeated.add(w)
        if not repeated:
            return
        automaton = ahocorasick.Automaton()
        for w in repeated:
            automaton.add_word(w, first[w])
        automaton.make_automaton()
        for r, (t, (_, _, place, key)) in enumerate(zip(text, runs)):
            hits, firsts = [], []
            for end, at in automaton.iter(t):
                i = end - k + 1
                hits.append(i)
                if at == r * RUN_STEP + i:
                    firsts.append(i)
            if hits:
                yield key, place, hits, firsts


def locate(window: int, shard_words: int):
    """Distinct runs ordered by anchor -> rows (d1, d2, num, start, offsets):
    hits of a run (num null), or first places in a text (d1 null)."""
    schema = pa.schema([("a", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("num", pa.int64()), ("start", pa.int64()), ("offsets", pa.list_(pa.int32()))])

    def flush(shard: Shard) -> pa.RecordBatch:
        rows = []
        for key, place, hits, firsts in shard.matches():
            rows.append((*key[:3], None, None, hits))
            if firsts:
                rows.append((None, None, None, key[3], place[-1], firsts))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(window), None
        for b in batches:
            names = ("a", "d1", "d2", "run", "count", "no_id", "id", "s1", "s2", "start", "num")
            for a, d1, d2, line, n, no_id, i, s1, s2, start, num in zip(*(b.column(c).to_pylist() for c in names)):
                if a != last and shard.words >= shard_words:
                    yield flush(shard)
                    shard = Shard(window)
                last = a
                shard.add(line, n, (no_id, i, s1, s2, start), (a, d1, d2, num))
        yield flush(shard)

    return run


def removal(window: int):
    """(text, places) -> spans of removed words, their number, SHA-256 of the rest."""
    kind = "spans array<struct<from: long, to: long>>, n_removed long, kept_sha256 string"

    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        words = _split(texts)
        base = np.r_[0, np.cumsum([len(w) for w in words])]
        # All windows of the batch at once, numbered by the word they start at.
        flat = places.flatten()
        start, offsets, is_first = (flat.field(c) for c in ("start", "offsets", "first"))
        rows = np.repeat(np.arange(len(words)), places.value_lengths().to_numpy(zero_copy_only=False))
        n = offsets.value_lengths().to_numpy(zero_copy_only=False)
        at = np.repeat(base[rows] + start.to_numpy(zero_copy_only=False), n) + offsets.flatten().to_numpy(zero_copy_only=False)
        hit, spare = np.zeros(base[-1], bool), np.zeros(base[-1], bool)
        own = np.repeat(is_first.to_numpy(zero_copy_only=False), n).astype(bool)
        hit[at[~own]] = True
        spare[at[own]] = True
        at = np.flatnonzero(hit & ~spare)
        edge = np.zeros(base[-1] + 1, np.int64)  # no window reaches past its text
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for w, a, b in zip(words, base, base[1:]):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).tolist()
            ranges = list(zip(edges[::2], edges[1::2]))
            kept, last = [], 0
            for x, y in ranges:
                kept += w[last:x]
                last = y
            kept += w[last:]
            out.append({"spans": [{"from": x, "to": y} for x, y in ranges], "n_removed": len(w) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()})
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.array(out, pa.struct([("spans", span), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return arrow_udf(cut, kind)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_sha256) for every row: ``spans`` are
    the removed words as ranges [from, to)."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = prepare(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text)).alias("raw"), col(text).alias("text"))
    signed = saved(rows.withColumn("_s", signatures(window, gram)(F.col("text"))).select("id", "raw", "_s.*"), "signed")

    # The first row of every word sequence.
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")).alias("best")
    folded = signed.groupBy("s1", "s2").agg(best, F.first("n").alias("n"), F.first("sha").alias("sha"), F.first("anchors").alias("anchors"))
    firsts = saved(folded.select("best.*", "s1", "s2", "n", "sha", "anchors", F.monotonically_increasing_id().alias("num")), "firsts")

    # Anchors at two places, and the texts that hold them.
    each = firsts.select("num", F.explode("anchors").alias("a"))
    twice = saved(each.groupBy("a").agg(F.count("*").alias("count")).where("count > 1"), "anchors")
    limit = (twice.agg(F.sum("count")).first()[0] or 0) / hot
    late = np.sort(np.array([r[0] for r in twice.where(F.col("count") > limit).select("a").collect()], np.int64)).astype(np.uint64) if limit > 1 else np.zeros(0, np.uint64)
    held = each.join(twice.select("a").hint("shuffle_hash"), "a", "left_semi").groupBy("num").agg(F.collect_set("a").alias("anchors"))
    wanted = firsts.drop("anchors").join(held.hint("shuffle_hash"), "num")
    same = F.col("w.raw").eqNullSafe(F.col("r.raw")) & F.col("w.id").eqNullSafe(F.col("r.id"))
    found = rows.alias("r").join(wanted.alias("w").hint("shuffle_hash"), same).select("w.*", "r.text")
    found = saved(found, "found")

    # Runs of windows, folded, dealt by anchor, and streamed through the automata.
    runs = found.select("num", "text", "anchors").mapInArrow(cut_runs(window, gram, late), "a long, d1 long, d2 long, run binary, num long, start long")
    runs = saved(runs, "runs")
    order = found.select("num", "no_id", "id", "s1", "s2").distinct()
    placed = runs.join(order.hint("shuffle_hash"), "num")
    place = F.min(F.struct("no_id", "id", "s1", "s2", "start", "num")).alias("place")
    distinct = placed.groupBy("a", "d1", "d2").agg(F.count("*").alias("count"), place, F.first("run").alias("run"))
    distinct = distinct.select("a", "d1", "d2", "run", "count", "place.*").repartition(partitions(spark), "a").sortWithinPartitions("a")
    matches = saved(distinct.mapInArrow(locate(window, shard_words), "a long, d1 long, d2 long, num long, start long, offsets array<int>"), "matches")

    # Back to every place of a run, and to the texts.
    hits = runs.select("a", "d1", "d2", "num", "start").join(matches.where("num is null").select("a", "d1", "d2", "offsets").hint("shuffle_hash"), ["a", "d1", "d2"])
    hits = hits.select("num", F.struct("start", "offsets", F.lit(False).alias("first")).alias("p"))
    spare = matches.where("num is not null").select("num", F.struct("start", "offsets", F.lit(True).alias("first")).alias("p"))
    places = hits.unionByName(spare).groupBy("num").agg(F.collect_list("p").alias("places"))
    one = found.select("num", "text").join(places.hint("shuffle_hash"), "num").select("num", removal(window)(F.col("text"), F.col("places")).alias("_r"))
    cut = saved(one.select("num", "_r.*").dropDuplicates(["num"]), "cut")
    discard(found, runs, matches, twice)

    first = firsts.select("id", "n", "sha", "num").join(cut.hint("shuffle_hash"), "num", "left")
    none = F.array().cast("array<struct<from: bigint, to: bigint>>")
    first = first.select(
        "id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
    # Copies: all rows but one of those equal to the first.
    copies = signed.groupBy("s1", "s2", "id", "raw").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("sha").alias("sha"))
    copies = salted_lookup(copies, firsts.select("s1", "s2", F.col("id").alias("_id"), F.col("raw").alias("_raw")), ["s1", "s2"])
    own = F.col("id").eqNullSafe(F.col("_id")) & F.col("raw").eqNullSafe(F.col("_raw"))
    copies = copies.withColumn("m", F.col("m") - own.cast("long")).where("m > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    whole = F.col("n") >= window
    copies = copies.select(
        "id",
        F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))).otherwise(none).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return first.unionByName(copies)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = repeated_passages(table(spark, sf_dir, "documents"))
    return x.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
