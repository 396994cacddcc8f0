"""J1 last-wins deduplication.

A rerun appends to the same log, so for each key the last written answer
counts. ``max_by`` over an ordering struct is a declarative aggregate: Spark
runs it partially on the map side, so a key that holds a large share of all
rows is reduced to one row per partition before the shuffle (no hot task).
Only the small extracted columns go into the aggregate buffer, not the text.

With values of fixed width and a 64-bit order the buffer is updated in place:
Spark plans a hash aggregate, without the sort that strings or structs need.

Where the answer texts themselves are wanted, :func:`last_in_place` finds the
place of each key's last row first, from keys and orders alone, and then keeps
the rows in those places where they are read: no text is sorted or shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, TimestampType

from verdikt.session import checkpoint_path


def _fixed(t: DataType) -> bool:
    return isinstance(t, (NumericType, BooleanType, DateType, TimestampType))


def last_wins(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the values of the row with the greatest ``order_col``
    (rows of a key that share it must be equal)."""
    if all(_fixed(df.schema[c].dataType) for c in (order_col, *value_cols)):
        last = [F.max_by(c, order_col).alias(c) for c in value_cols]
        return df.groupBy(*keys).agg(*last, F.count(F.lit(1)).alias("n_versions"))
    packed = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(*keys).agg(F.max_by(packed, F.col(order_col)).alias("_lw"), F.count(F.lit(1)).alias("n_versions"))
    return agg.select(*keys, *[F.col("_lw").getField(c).alias(c) for c in value_cols], "n_versions")


# Rows of a file whose places are listed together; tasks hold a few such lists.
SHARD_ROWS = 1 << 18
HELD_SHARDS = 32


def list_places(places: DataFrame, shard_rows: int = SHARD_ROWS) -> str:
    """Write places (``file``: text without slashes, ``at``: a number in that file,
    ``entry``: a number at it) by file to the shared folder; the lists' folder."""
    folder = checkpoint_path(places.sparkSession, f"places-{uuid.uuid4().hex}")
    sharded = places.withColumn("shard", F.floor(F.col("at") / F.lit(shard_rows)))
    sharded.repartition("file", "shard").write.partitionBy("file", "shard").parquet(folder)
    return folder


def is_listed(folder: str, file: Column, at: Column, entry: Column, shard_rows: int = SHARD_ROWS) -> Column:
    """Is a row's place among those that :func:`list_places` wrote? Tasks read the
    lists of their own files."""
    return _listed_udf(folder, shard_rows)(file, at.cast("long"), entry.cast("long"))


def last_in_place(df: DataFrame, keys: Sequence[str], order_col: str, file_col: str, at_col: str, entry_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``df`` with the greatest ``order_col`` of their ``keys``, one a
    key (of rows that share it the one whose place is last).

    ``file_col``, ``at_col`` and ``entry_col`` name each row's place (see
    :func:`list_places`). It must be the same whenever ``df`` is read, which happens
    twice: for the places of the last rows, and for the rows, of which tasks keep
    what the lists of their own files hold."""
    place = F.struct(F.col(file_col).alias("file"), F.col(at_col).cast("long").alias("at"), F.col(entry_col).cast("long").alias("entry"))
    last = df.select(*keys, F.struct(F.col(order_col).alias("order"), place.alias("place")).alias("_lw")).groupBy(*keys).agg(F.max("_lw").alias("_lw"))
    folder = list_places(last.select("_lw.place.*"), shard_rows)
    return df.where(is_listed(folder, F.col(file_col), F.col(at_col), F.col(entry_col), shard_rows))


def _listed_udf(folder: str, shard_rows: int):
    """(file, at, entry) -> is that place listed in ``folder``?"""
    held: dict[tuple[str, int], tuple[np.ndarray, int]] = {}
    limit = HELD_SHARDS

    def listed(file: str, shard: int) -> tuple[np.ndarray, int]:
        """Sorted numbers of the places, and how many entries a row has in them."""
        if (file, shard) not in held:
            if len(held) >= limit:
                held.clear()
            fs, root = pafs.FileSystem.from_uri(folder)
            at = entry = np.zeros(0, np.int64)
            if fs.get_file_info(path := f"{root}/file={file}/shard={shard}").type == pafs.FileType.Directory:
                t = pq.ParquetDataset(path, filesystem=fs, partitioning=None).read()
                at, entry = (t[c].to_numpy() for c in ("at", "entry"))
            width = int(entry.max(initial=0)) + 1
            held[file, shard] = np.sort((at - shard * shard_rows) * width + entry), width
        return held[file, shard]

    def kept(files: pa.Array, places: pa.Array, entries: pa.Array) -> pa.Array:
        names = files.dictionary_encode()
        code, at, entry = (x.to_numpy(zero_copy_only=False) for x in (names.indices, places, entries))
        shard, out = at // shard_rows, np.zeros(len(at), bool)
        for c, k in np.unique(np.stack([code, shard], 1), axis=0).tolist():
            numbers, width = listed(names.dictionary[c].as_py(), k)
            own = np.flatnonzero((code == c) & (shard == k) & (entry < width))
            wanted = (at[own] - k * shard_rows) * width + entry[own]
            found = np.searchsorted(numbers, wanted)
            hit = found < len(numbers)
            out[own[hit]] = numbers[found[hit]] == wanted[hit]
        return pa.array(out)

    kept.__annotations__ = {"files": pa.Array, "places": pa.Array, "entries": pa.Array, "return": pa.Array}
    return F.arrow_udf(kept, "boolean").asNondeterministic()
