"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``CAPACITY`` words and packed into
bins of that capacity. A bin must not hold two pieces of one duplicate cluster,
nor more than ``PER_SOURCE`` pieces of one source. Every bin carries a bitmap
of its clusters and bitmaps of its sources (plane k: more than k pieces of that
source), so a conflict is one AND.

Open bins are ordered by residual. A piece looks for the successor of its
length in that order, the tightest bin that still holds it, and goes on to the
next residual until a bin without conflict is found; else it opens a bin.
Pieces come longest first.

At scale the pieces are dealt by hash into blocks of about ``BLOCK`` pieces,
and each block is packed by itself in one task: only lengths, ids, sources and
cluster hashes are moved, never texts, and a block is bounded whatever a
source, cluster or repeated id holds. Bins of different blocks don't mix; with ``BLOCK``
far over the pieces of a bin this costs at most one badly filled tail of bins
a block.

Defined cases: a null or empty text is a piece of no words that still gets a
place. Null sources are one source. Repeated rows are packed each on its own
(they share a cluster, so never a bin). An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import col, partitions, prepare, salted_lookup, saved, table

CAPACITY = 2048
PER_SOURCE = 4
BLOCK = 8192
WORD = r"[^\x20\x09-\x0D]+"

PLACES = "doc_id long, piece int, n_words int, cluster long, source string, block long, bin int, start int"


def best_fit(lengths: list[int], clusters: list[int], sources: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, words before it in the bin) of each piece, in the order given."""
    # Bits only for clusters that can conflict at all.
    bit = {c: 1 << i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    source_bit = {s: 1 << i for i, s in enumerate(sorted(set(sources)))}
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    bins: list[list[int]] = []  # cluster bitmap, then one source bitmap per plane
    out = []
    for n, c, s in zip(lengths, clusters, sources):
        cb, sb = bit.get(c, 0), source_bit[s]
        i = bisect_left(order, (n, -1))
        while i < len(order):
            b = bins[order[i][1]]
            if not (b[0] & cb) and not (b[per_source] & sb):
                break
            i += 1
        if i < len(order):
            left, k = order.pop(i)
        else:
            left, k = capacity, len(bins)
            bins.append([0] * (per_source + 1))
        b = bins[k]
        b[0] |= cb
        plane = 1
        while b[plane] & sb:
            plane += 1
        b[plane] |= sb
        insort(order, (left - n, k))
        out.append((k, capacity - left))
    return out


def pack_block(capacity: int, per_source: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        x = block.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
        codes = pd.factorize(x["source"], use_na_sentinel=False)[0].tolist()
        placed = best_fit(x["n_words"].tolist(), x["cluster"].tolist(), codes, capacity, per_source)
        x["bin"], x["start"] = [p[0] for p in placed], [p[1] for p in placed]
        return x[["doc_id", "piece", "n_words", "cluster", "source", "block", "bin", "start"]].astype({"doc_id": "Int64", "piece": "int32", "n_words": "int32", "bin": "int32", "start": "int32"})

    return run


def pieces(docs: DataFrame, capacity: int, id_col: str, source: str, text: str) -> DataFrame:
    """(doc_id, piece, n_words, cluster, source): the last piece holds the rest.
    The cluster is the hash of the lower-cased words."""
    words = F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    x = docs.select(col(id_col).cast("long").alias("doc_id"), words.alias("total"), F.xxhash64(plain).alias("cluster"), col(source).cast("string").alias("source"))
    last = F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0))
    x = x.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return x.select("doc_id", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("n_words"), "cluster", "source")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, block: int = BLOCK, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per piece with its block, bin and place. Pieces that fill a bin
    are alone in it in any packing and take part like the others."""
    spark = docs.sparkSession
    prepare(spark)
    # The row key is written with the pieces, so a task that is run again deals alike.
    x = saved(pieces(docs, capacity, id_col, source, text).withColumn("_key", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-x.count() // block))
    # Pieces are dealt by their id, so a packing depends on the rows alone. An id
    # that is missing or repeats tells its rows apart no more; their keys deal
    # them out, and which of them goes where is immaterial.
    repeated = x.where("doc_id IS NOT NULL").groupBy("doc_id", "piece").agg(F.count("*").alias("rows")).where("rows > 1")
    x = salted_lookup(x, repeated, ["doc_id", "piece"])
    salt = F.when(F.col("doc_id").isNull() | F.col("rows").isNotNull(), F.col("_key")).otherwise(F.lit(0))
    x = x.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", salt), F.lit(blocks))).drop("_key", "rows")
    return x.repartition(max(1, min(blocks, 4 * partitions(spark))), "block").groupBy("block").applyInPandas(pack_block(capacity, per_source), PLACES)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
