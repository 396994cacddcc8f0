"""Shards of adjacent ids, about equally many rows each, for any ids.

Rows are ranked by (id, hash), null ids first. A shard begins at the first key
at or past each multiple of ``step`` rows, so shards depend on the rows alone,
never on the cluster, whatever the ids are: dense, sparse, repeated or null.
Only keys are sorted; every row then finds its shard among the shards' first
keys. These are at most ``MAX_SHARDS``: past that many shards' rows, shards
grow instead.

Rows that agree in id and hash are counted before the sort and stay in one
shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import arrow_udf, discard, saved

MAX_SHARDS = 1 << 16

_SORTED = "part int, id long, h long, n long, before long"


class Shards(NamedTuple):
    """First keys of all shards but the first: hashes at null ids, then keys."""

    null_hashes: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray

    @property
    def count(self) -> int:
        return len(self.null_hashes) + len(self.ids) + 1


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``before``, the rows of the task that come before a key."""
    total = 0
    for b in batches:
        n = b.column(3).to_numpy()
        upto = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - n, pa.int64())], names=["part", "id", "h", "n", "before"])
        total = int(upto[-1]) if len(upto) else total


def shards(keys: DataFrame, rows_per_shard: int) -> Shards:
    """The shards of ``keys``: (id, h, n), a row per key with its number of rows."""
    x = keys.select("id", "h", "n").orderBy(F.col("id").asc_nulls_first(), "h")
    x = x.select(F.spark_partition_id().alias("part"), "id", "h", F.col("n").cast("long").alias("n"))
    x = saved(x.mapInArrow(_running, _SORTED), "ranks")
    parts = x.groupBy("part").agg(F.sum("n").alias("rows"))  # a row per task of the sort
    total = parts.agg(F.sum("rows")).first()[0] or 0
    step = max(rows_per_shard, -(-total // MAX_SHARDS))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("before")
    # The key's rows are the ranks from ``at`` on; it holds a multiple of step.
    holds = F.floor((at + F.col("n") - 1) / F.lit(step)) > F.floor((at - 1) / F.lit(step))
    first = x.join(F.broadcast(starts), "part").where((at > 0) & holds).select("id", "h").collect()
    discard(x)
    nulls = sorted(r["h"] for r in first if r["id"] is None)
    rest = sorted((r["id"], r["h"]) for r in first if r["id"] is not None)
    column = lambda v: np.array(v, dtype=np.int64)
    return Shards(column(nulls), column([i for i, _ in rest]), column([h for _, h in rest]))


def places(found: Shards, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """The shard of each key."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    i = ids.fill_null(0).to_numpy(zero_copy_only=False)
    h = hashes.to_numpy(zero_copy_only=False)
    low, out = np.searchsorted(found.ids, i, "left"), np.searchsorted(found.ids, i, "right")
    # Only where shards begin inside an id does the hash decide.
    inside = np.flatnonzero((low < out) & ~null)
    for a in np.unique(low[inside]):
        own = inside[low[inside] == a]
        out[own] = a + np.searchsorted(found.hashes[a : out[own[0]]], h[own], "right")
    return np.where(null, np.searchsorted(found.null_hashes, h, "right"), out + len(found.null_hashes))


def shard_of(found: Shards, id_: Column, h: Column) -> Column:
    def run(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(places(found, ids, hashes), pa.int64())

    return arrow_udf(run, "long")(id_, h)
