"""Groups of spelling variants by an index of variable-length grams.

Words are near if one inserted, deleted or replaced code point turns one into
the other. A word's form is its most frequent near word, if that is at least
``RATIO`` times as frequent; its root is where forms lead.

1. Words are counted in one pass; a task adds up what it reads before it sends.
2. Gram dictionary: of the grams of the distinct words, those in more than
   1 / ``FREQUENT`` of all positions are frequent; there are at most ``FREQUENT``
   of a length, whatever the input. A gram grows while it is frequent, so the
   dictionary is the frequent grams and their one-step extensions.
3. Every position of a word starts one gram: the shortest extension that is not
   frequent, up to ``longest`` or the word's end. An edit affects only the grams
   that read the edited place, so a word with g grams of which one place touches
   at most b keeps g - b of them in any near word (its bound). By the pigeonhole
   principle the b + 1 rarest grams of two near words have one in common: only
   those lists are merged, the frequent ones beyond are never read.
4. Lists are keyed by the gram, its position and the shorter word's length (the
   longer word stands in at both positions an edit allows). ``longest`` is that
   length less 2, so every bound is at least 1 and no word needs a fallback.
   Words over ``LONG`` code points are decomposed into two halves, of which one
   edit leaves one whole.
5. Words that share a list are verified by their edit distance inside the join,
   so only near pairs leave it. Forms are followed by pointer doubling: a form
   is ``RATIO`` times as frequent, so few rounds reach every root.

Defined cases: a null or empty text has no words; a null id counts as the empty
string in the hash. Ties go to the smallest word in code-point order. Repeated
rows count each. Other columns play no part. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import col, discard, prepare, saved, table

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
NOISE = 199
SHORTEST, LONGEST, LONG = 2, 8, 64
FREQUENT = 5_000
# Distinct entries a task adds up before it passes them on.
HELD = 200_000

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _flush(counts: Counter, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=list(names))


def count_words(min_chars: int, noise: int):
    """(id, text) batches -> (word, n), added up within a task. If ``noise``
    divides the CRC-32 of ``<id>:<run>``, one code point of the run goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(_RUNS.findall(text)).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    h = zlib.crc32(word.encode(), before)
                    if h % noise == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= min_chars:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield _flush(counts, ("word", "n"))
                    counts.clear()
        yield _flush(counts, ("word", "n"))

    return run


def count_grams(shortest: int, longest: int, long: int):
    """(word) batches -> (gram, n) of lengths shortest to longest - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                if len(w) > long + 1:
                    continue
                counts.update([w[p : p + q] for q in range(shortest, longest) for p in range(len(w) - q + 1)])
                if len(counts) >= HELD:
                    yield _flush(counts, ("gram", "n"))
                    counts.clear()
        yield _flush(counts, ("gram", "n"))

    return run


def decompose(word: str, frequent: dict[str, int], shortest: int, longest: int) -> list[tuple[int, str, bool]]:
    """(position, gram, open) for every position; an open gram ended only
    because the word did, so a longer word could extend it."""
    out, end = [], len(word)
    for p in range(end - shortest + 1):
        q = p + shortest
        while q < end and q - p < longest and word[p:q] in frequent:
            q += 1
        out.append((p, word[p:q], q == end and q - p < longest and word[p:q] in frequent))
    return out


def affected(grams: list[tuple[int, str, bool]], size: int) -> int:
    """The most grams that one edit can change: those that read its place."""
    change = [0] * (size + 2)
    for p, g, is_open in grams:
        change[p] += 1  # a place beyond the last stands for an appended code point
        change[p + len(g) + is_open] -= 1
    most = now = 0
    for c in change:
        now += c
        most = max(most, now)
    return most


def listed(word: str, size: int, frequent: dict[str, int], shortest: int, longest: int, long: int) -> set[tuple[int, str]]:
    """The (position, gram) lists in which ``word`` stands for pairs whose
    shorter word has ``size`` code points."""
    extra = len(word) - size  # 1 for the longer word of a pair
    if size > long:
        h = size // 2
        return {(0, word[:h]), (h, word[h + extra :])}
    grams = decompose(word, frequent, shortest, min(longest, size - shortest))
    rank = sorted((frequent.get(g, 0), g) for _, g, _ in grams)
    last = rank[min(affected(grams, len(word)), len(rank) - 1)]
    kept = {(p, g) for p, g, _ in grams if (frequent.get(g, 0), g) <= last}
    return kept | {(p - 1, g) for p, g in kept if p} if extra else kept


def postings(frequent: dict[str, int], shortest: int, longest: int, long: int, min_chars: int):
    """(word, n) batches -> (key, word, n, longer)."""
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("longer", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for size in (len(w) - 1, len(w)):
                    if size >= min_chars:
                        for p, g in listed(w, size, frequent, shortest, longest, long):
                            k = h(f"{size} {p} {g}")
                            rows.append((k - (1 << 64) if k >> 63 else k, w, n, len(w) > size))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, frequent: int = FREQUENT, shortest: int = SHORTEST, longest: int = LONGEST, long: int = LONG) -> DataFrame:
    """Distinct (a, a_n, b, b_n) of the near words of a written table (word, n)
    of distinct words; each pair comes once."""
    if min_chars < 2 * shortest or min_chars > long:
        raise ValueError("min_chars must be at least twice the shortest gram, and no more than long")
    grams = words.select("word").mapInArrow(count_grams(shortest, longest, long), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = words.where(F.length("word") <= long + 1).agg(F.sum(F.length("word"))).first()[0] or 0
    # At most `frequent` grams of a length can exceed this share of all positions.
    dictionary = {r["gram"]: r["n"] for r in grams.where(F.col("n") > math.ceil(total / frequent)).collect()}
    lists = words.mapInArrow(postings(dictionary, shortest, longest, long, min_chars), "key long, word string, n long, longer boolean")
    lists = saved(lists, "lists")
    a = lists.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = lists.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    near = F.expr("(longer or a < b) and levenshtein(a, b, 1) = 1")
    pairs = a.hint("merge").join(b, "key").where(near).select("a", "a_n", "b", "b_n").distinct()
    pairs = saved(pairs, "pairs")
    discard(lists)
    return pairs


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) from a written table (word, n, form, form_n): pointer doubling, as many
    rounds as the longest chain of growing counts can need."""
    top = forms.agg(F.max("n")).first()[0] or 1
    depth = 1 + math.floor(math.log(max(top, 1)) / math.log(ratio))
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(depth + 1)))):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # Few words stand at one root: as many as are an edit from it, and theirs.
        new = saved(at.join(step.hint("shuffle_hash"), "root").select("word", F.col("next").alias("root")), "roots")
        if hasattr(at, "_saved_at"):
            discard(at)
        at = new
    return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the texts."""
    prepare(docs.sparkSession)
    read = docs.select(col(id_col).alias("id"), col(text).alias("text"))
    words = read.mapInArrow(count_words(min_chars, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = saved(words.where(F.col("n") >= min_count), "words")
    pairs = near_pairs(words, min_chars, frequent)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), "b"))
    near = both.groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    forms = words.join(near.withColumnRenamed("a", "word").hint("shuffle_hash"), "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    forms = saved(
        forms.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    discard(pairs, words)
    return forms.join(roots(forms, ratio).hint("shuffle_hash"), "word")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
