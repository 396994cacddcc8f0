"""Quality classifier by importance resampling.

Texts are bags of hashed n-grams: tokens (runs of letters and digits, runs of
punctuation) and pairs of neighbours, in ``2**BITS`` buckets an order. Two
generative models are fitted for each order: p over the target (labelled good
texts) and q over all texts. A text's log importance weight is the mean of
log p - log q over its tokens plus ``PAIRS`` times that over its pairs plus
``WORST`` times that of its worst passage of ``PASSAGE`` tokens (which a long text
doesn't dilute), times ``STRENGTH`` (the text is weighed as if it were that long,
so that length alone decides nothing). Adding Gumbel noise to the log weights and taking the k
largest draws k texts without replacement in proportion to their weights.

* q counts every n-gram of every text. The target is a documented bounded
  sample of the labelled good rows: at most ``LABEL_ROWS``, by hash order.
* k is the share of good rows among those labels of all texts (``MARGIN`` more: none).
* The k-th largest value is found by counting in ever finer ranges (at most
  ``FAN`` counts come to the driver each time); no sort and no collected rows.

Defined cases: a text without n-grams (null, empty, white space) has weight 0
for every model and is rejected. Rows that tie with the k-th value all stay,
so repeated rows are treated alike. Without any labels nothing is rejected but
texts without n-grams. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import arrow_udf, col, packed, prepare, saved, table, utf8

BITS = 18
LABEL_ROWS = 20_000
STRENGTH = 400.0
SMOOTH = 1.0
PAIRS = 0.15
PASSAGE = 8
WORST = 0.1
MARGIN = 0.0
SEED = 20240607
FAN = 4096
SCALE = 1 << 20
GRAIN = 64

_CLASS = np.full(256, 1, np.uint8)  # letters, digits and all non-ASCII bytes
_CLASS[[b for b in range(128) if not chr(b).isalnum()]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngrams(texts: list[bytes | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every n-gram of the texts. Tokens have the
    buckets below 2**bits, pairs those from there on."""
    lower = [(x or b"").lower() for x in texts]
    a = np.frombuffer(b" ".join(lower) + b" ", np.uint8)
    kind = _CLASS[a]
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    start = edge[kind[edge] > 0]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.repeat(edge, np.diff(np.r_[edge, len(a)]))
    place = np.arange(len(a)) - run
    power = np.full(int(place.max()) + 1, _BASE | np.uint64(1), np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value = (a.astype(np.uint64) + np.uint64(1)) * power[place]
    value[kind == 0] = 0
    h = _mix(np.add.reduceat(value, start))
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in lower]), start, side="right")
    two = np.flatnonzero(owner[1:] == owner[:-1])
    pair = _mix(h[two] * np.uint64(0xA24BAED4963EE407) + h[two + 1])
    shift = np.uint64(64 - bits)
    return np.r_[h >> shift, (pair >> shift) + np.uint64(1 << bits)].astype(np.int64), np.r_[owner, owner[two]]


def pieces(texts: list[bytes | None], limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of texts of about ``limit`` bytes (a longer text is a run of its own)."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if i > first and size + len(x or b"") > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(x or b"")
    if first < len(texts):
        yield first, texts[first:]


def counting(bits: int):
    """(text, target) batches -> count blocks (block, raw counts, target counts) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(2 << bits, np.int64), np.zeros(2 << bits, np.int64)
        for b in batches:
            mark = np.asarray(b.column(1).to_pylist(), bool)
            for first, run_ in pieces(utf8(b.column(0))):
                g, o = ngrams(run_, bits)
                raw += np.bincount(g, minlength=2 << bits)
                good += np.bincount(g[mark[first + o]], minlength=2 << bits)
        if raw.any():
            split = lambda x: pa.array(x.reshape(GRAIN, -1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(GRAIN), pa.int32()), split(raw), split(good)], names=["block", "raw", "good"])

    return run


def summing(bits: int):
    """Rows of one block from all tasks -> their sum, read batch by batch."""
    size = (2 << bits) // GRAIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros((2, size), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                k = b.column(0)[r].as_py()
                if block is not None and k != block:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in total)], names=["block", "raw", "good"])
                    total = np.zeros((2, size), np.int64)
                block = k
                total += np.array([b.column(1)[r].values.to_numpy(), b.column(2)[r].values.to_numpy()])
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in total)], names=["block", "raw", "good"])

    return run


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p - log q per bucket of one order. ``SMOOTH`` n-grams a bucket are
    added on both sides, so a bucket the target never saw stays finite and a
    rare one stays near 0."""
    expected = raw * (good.sum() / max(raw.sum(), 1))
    return np.log((good + SMOOTH) / (expected + SMOOTH))


def label_sample(labels: DataFrame, id_col: str, good: Column, rows: int = LABEL_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids by hash order, with ``good``."""
    x = labels.where(col(id_col).isNotNull()).select(col(id_col).alias("_id"), F.coalesce(good, F.lit(False)).alias("_good"))
    return x.orderBy(F.xxhash64("_id", F.lit(SEED)), "_good").limit(rows).groupBy("_id").agg(F.min("_good").alias("_good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, bits: int = BITS) -> tuple[np.ndarray, float]:
    """The log ratio per bucket and the share of good rows in the labels met."""
    spark = docs.sparkSession
    # The sample has at most LABEL_ROWS rows, so it may be broadcast.
    x = docs.select(col(id_col).alias("_id"), col(text).alias("_text")).join(F.broadcast(labels), "_id", "left")
    blocks = x.select("_text", F.coalesce("_good", F.lit(False)).alias("_good")).mapInArrow(counting(bits), "block int, raw array<long>, good array<long>")
    blocks = blocks.repartition(GRAIN, "block").sortWithinPartitions("block")
    rows = blocks.mapInArrow(summing(bits), "block int, raw array<long>, good array<long>").collect()  # 2 << bits numbers twice, whatever the input
    share = docs.select(col(id_col).alias("_id")).join(F.broadcast(labels), "_id").agg(F.avg(F.col("_good").cast("int"))).first()[0]
    if not rows:
        return np.zeros(2 << bits), 1.0
    rows.sort(key=lambda r: r["block"])
    raw, good = (np.concatenate([np.array(r[k], np.int64) for r in rows]) for k in ("raw", "good"))
    half = 1 << bits
    model = np.r_[log_ratio(raw[:half], good[:half]), log_ratio(raw[half:], good[half:])]
    return model, 1.0 if share is None else min(1.0, float(share) + MARGIN)


def worst_passage(ratio: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The least sum of ``PASSAGE`` neighbouring tokens' log ratios over PASSAGE
    (passages at a text's start are shorter); 0 without tokens. Tokens come by text."""
    total = np.cumsum(np.r_[0.0, ratio])
    count = np.bincount(owner, minlength=texts)
    first = np.cumsum(count) - count
    end = np.arange(1, len(ratio) + 1)
    passage = (total[end] - total[np.maximum(first[owner], end - PASSAGE)]) / PASSAGE
    out, some = np.zeros(texts), np.flatnonzero(count)
    if len(some):
        out[some] = np.minimum.reduceat(passage, first[some])
    return out


def log_weights(texts: list[bytes | None], model: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The log importance weights before ``STRENGTH``, nan without n-grams."""
    g, o = ngrams(texts, bits)
    total, pairs = np.zeros(len(texts)), g >= 1 << bits
    for order, factor in ((~pairs, 1.0), (pairs, PAIRS)):
        n = np.bincount(o[order], minlength=len(texts))
        total += factor * np.bincount(o[order], weights=model[g[order]], minlength=len(texts)) / np.maximum(n, 1)
    total += WORST * worst_passage(model[g[~pairs]], o[~pairs], len(texts))
    total[np.bincount(o, minlength=len(texts)) == 0] = np.nan
    return total


def weight_udf(spark: SparkSession, model: np.ndarray, bits: int = BITS):
    """text -> log weight, null without n-grams."""
    sent = spark.sparkContext.broadcast(model.astype(np.float32))

    def weights(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), np.nan)
        for first, run in pieces(utf8(texts)):
            out[first : first + len(run)] = log_weights(run, sent.value, bits)
        return pa.array(out, pa.float64(), from_pandas=True)

    return arrow_udf(weights, T.DoubleType())


def gumbel(id_col: Column) -> Column:
    """Gumbel noise from the row's id, the same in every run."""
    u = (F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``key``, by counting ranges: each
    round sends at most ``FAN`` counts to the driver."""
    if k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return None
    above = 0
    while low < high:
        width = -(-(high - low + 1) // FAN)
        x = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - {low}L) div {width}L").alias("r")).agg(F.count("*").alias("n"))
        for r in sorted(x.collect(), key=lambda r: -r["r"]):
            if above + r["n"] >= k:
                low, high = low + r["r"] * width, min(high, low + (r["r"] + 1) * width - 1)
                break
            above += r["n"]
        else:
            return low
    return low


def scored(docs: DataFrame, model: np.ndarray, id_col: str, text: str) -> DataFrame:
    """``_row`` with log_weight and key (perturbed weight as a scaled long)."""
    spark = docs.sparkSession
    x = packed(docs).withColumn("log_weight", weight_udf(spark, model)(F.col("_row").getField(text)))
    noisy = F.lit(STRENGTH) * F.col("log_weight") + gumbel(F.col("_row").getField(id_col))
    return x.withColumn("key", F.floor(noisy * SCALE).cast("long"))


def good_label() -> Column:
    return (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    sample = saved(label_sample(labels, id_col, good_label()), "labels")
    return fit(docs, sample, id_col, text)


def threshold(keys: DataFrame, share: float) -> int:
    keys = saved(keys.where("key is not null").select("key"), "keys")
    cut = kth_largest(keys, int(np.ceil(share * keys.count())))
    return 0 if cut is None else cut


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows as ``_row`` with log_weight, key and ``kept``. Texts are scored
    twice (for the threshold and for the rows), which moves no text."""
    prepare(docs.sparkSession)
    model, share = fitted(docs, labels, id_col, text)
    narrow = docs.select(col(id_col), col(text))
    cut = threshold(scored(narrow, model, id_col, text), share)
    return scored(docs, model, id_col, text).withColumn("kept", F.coalesce(F.col("key") >= F.lit(cut), F.lit(False)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, share = fitted(docs, table(spark, sf_dir, "labels"))
    x = saved(scored(docs, model, "doc_id", "text").select("_row.doc_id", "log_weight", "key"), "scores")
    cut = threshold(x, share)
    return x.select("doc_id", "log_weight", (F.col("key") / F.lit(float(SCALE))).alias("noisy_weight"), F.coalesce(F.col("key") >= F.lit(cut), F.lit(False)).alias("kept"))
