"""SimHash near-dedup by tiled exact comparison.

A fingerprint bit is 1 when it is set in over half of the hashes of the
text's word shingles. Two fingerprints link when they differ in at most
``RADIUS`` bits; classes are the connected components.

1. Equal fingerprints collapse to one row (grouped, so a text copied a
   million times costs one row per map task).
2. The 64 bits are cut into ``BLOCKS`` blocks. A linking pair differs in at most
   RADIUS of them, so it agrees on some BLOCKS - RADIUS whole blocks, and only
   fingerprints that agree on such a choice are compared. This is exact, there
   are no caps. With 5 blocks a choice fixes 25 or 26 bits: 10 copies of each
   fingerprint are moved and the pairs compared are 10 of 2**25.6. A value
   shared by more than ``TILE`` fingerprints is dealt into tiles and every pair
   of tiles is a task group of its own.
3. Inside a group rows are ordered by population count and compared tile by
   tile with numpy exclusive-or and bit counts; tiles whose population counts
   differ by more than the radius are skipped. A group gives a spanning star
   per local component, never all its pairs.
4. The stars are joined to components by alternating large-star and small-star
   rounds on written tables.

Defined cases: null or empty texts (no words) have fingerprint zero and link
like any other. A text of fewer words than a shingle is one shingle. The
component id is the smallest doc_id; null ids take part but never name a
component unless it has no other id (then null). Repeated rows share a
component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import arrow_udf, col, discard, partitions, prepare, salted_lookup, saved, scratch, table, unpacked, utf8

SHINGLE, RADIUS, SEED = 3, 3, 42
BLOCKS = 5
TILE = 4096
STRIP = 512
BITMAP = 32_768  # bits of one of Spark's bitmaps


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_udf(shingle: int = SHINGLE):
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, shingle) for x in utf8(texts)], np.uint64).view(np.int64))

    return arrow_udf(prints, "long")


def stars(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component under the links u-v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Local links (as index pairs) between rows of equal ``group``. Rows come
    grouped. Links of a strip pair are reduced to stars as they are found."""
    pops = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((pops, group))
    f, g, p = fp[order], group[order], pops[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    end = np.r_[start[1:], len(g)]
    us, vs = [], []
    big = end - start > STRIP
    # Small groups, all at once: row i against row i + k, as long as the group
    # goes on and the population counts are within the radius.
    stop = np.repeat(end, end - start)
    i = np.flatnonzero(~np.repeat(big, end - start))
    k = 1
    while len(i):
        i = i[i + k < stop[i]]
        i = i[p[i + k] - p[i] <= radius]
        hit = i[np.bitwise_count(f[i] ^ f[i + k]) <= radius]
        us.append(hit)
        vs.append(hit + k)
        k += 1
    # Large groups: strips of rows against strips of rows.
    for a0, a1 in zip(start[big], end[big]):
        for s in range(a0, a1, STRIP):
            x = slice(s, min(s + STRIP, a1))
            for t in range(s, a1, STRIP):
                y = slice(t, min(t + STRIP, a1))
                if p[y.start] - p[x.stop - 1] > radius:
                    break
                m, n = np.nonzero(np.bitwise_count(f[x, None] ^ f[None, y]) <= radius)
                local = stars(x.stop - x.start + y.stop - y.start, m, n + (x.stop - x.start))
                at = np.r_[np.arange(x.start, x.stop), np.arange(y.start, y.stop)]
                moved = np.flatnonzero(local != np.arange(len(local)))
                us.append(at[moved])
                vs.append(at[local[moved]])
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    return order[u], order[v]


def tile_links(radius: int):
    """Arrow batches of (group key, fp), ordered by key -> edges (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = close_pairs(fp.view(np.uint64), keys, radius)
        # A bucket's links become stars; distances are exact, so this loses none.
        label = stars(len(fp), u, v)
        moved = np.flatnonzero(fp[label] != fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            fps.append(b.column(1).to_numpy(zero_copy_only=False))
            rows += b.num_rows
            if rows < 1 << 16 or keys[0][0] == keys[-1][-1]:
                continue
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
            yield links(k[:cut], f[:cut])
            keys, fps, rows = [k[cut:]], [f[cut:]], len(k) - cut
        if rows:
            yield links(np.concatenate(keys), np.concatenate(fps))

    return run


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the blocks, as signed longs."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within the
    radius of each other (directly or through stars of a tile)."""
    spark = nodes.sparkSession
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(radius, blocks)])
    x = nodes.select("fp", F.posexplode(values).alias("k", "v"))
    # Written, so that the planner knows how large it is: as a rule it is empty.
    sizes = saved(x.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > tile), "sizes")
    x = x.join(sizes, ["k", "v"], "left")
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(tile)), F.lit(1)).cast("long")
    x = x.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    # The key orders by block, value and tile pair; tile pairs of a value are
    # spread over tasks. (A pair of tiles also compares each tile with itself.)
    x = x.select(F.xxhash64("k", "v", pair).alias("key"), "fp")
    x = x.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return x.mapInArrow(tile_links(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node of its component. Alternating large-star and small-star on written
    tables until nothing changes (a round shortens every path, so it ends); a
    hub's edges are spread by salts."""
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    e = saved(edges.where("a != b").distinct(), "edges")
    now, seen = state(e), None
    while now["n"] and now != seen:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = salted_lookup(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_lookup(large, low, ["a"])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, e = e, saved(small.where("a != b").distinct(), "edges")
        discard(before)
        seen, now = now, state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def row_components(docs: DataFrame, id_col: str, text: str, shingle: int, radius: int, more: list[Column] = []) -> DataFrame:
    """(id, *more, fp, root, component_id) for every row of ``docs``; root is the
    component's smallest fingerprint."""
    prepare(docs.sparkSession)
    fps = saved(docs.select(col(id_col).alias("id"), *more, fingerprint_udf(shingle)(col(text)).alias("fp")), "prints")
    nodes = saved(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(fingerprint_links(nodes, radius))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = saved(linked.select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    discard(nodes)
    names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(salted_lookup(linked, names, ["root"]).select("fp", "root", "component_id"), "named")
    discard(linked)
    return fps.join(named, "fp", "left")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    return row_components(docs, id_col, text, shingle, radius).select("id", "fp", "component_id")


def _file_rows(docs: DataFrame) -> DataFrame:
    """(_row, _file, _at): every row with its file and its place there. A plain
    scan has both; what is computed is written first."""
    place = [F.md5(F.col("_metadata.file_path").cast("binary")).alias("_file"), F.col("_metadata.row_index").alias("_at")]
    row = F.struct(*[col(c) for c in docs.columns]).alias("_row")
    if "_metadata" not in docs.columns:
        try:
            return docs.select(row, *place)
        except AnalysisException:
            pass
    return saved(docs.select(row), "rows").select("_row", *place)


def _kept_udf(folder: str):
    """(file, place) -> is the place in the file's bitmaps? A task reads those of
    its own files: one bit a row, in the shared folder."""
    held: dict[str, np.ndarray] = {}

    def bits(file: str) -> np.ndarray:
        if file not in held:
            held.clear()
            fs, root = pafs.FileSystem.from_uri(folder)
            found = np.zeros(0, np.uint8)
            if fs.get_file_info(f"{root}/file={file}").type == pafs.FileType.Directory:
                t = pq.ParquetDataset(f"{root}/file={file}", filesystem=fs, partitioning=None).read()
                maps = dict(zip(t["bucket"].to_pylist(), t["bits"].to_pylist()))
                found = np.zeros(BITMAP * max(maps, default=0), np.uint8)
                for k, m in maps.items():
                    found[(k - 1) * BITMAP :][:BITMAP] = np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")
            held[file] = found
        return held[file]

    def kept(files: pa.Array, places: pa.Array) -> pa.Array:
        names = files.dictionary_encode()
        at = places.to_numpy(zero_copy_only=False)
        code = names.indices.to_numpy(zero_copy_only=False)
        out = np.zeros(len(at), bool)
        for c, name in enumerate(names.dictionary.to_pylist()):
            own, b = code == c, bits(name)
            inside = own & (at < len(b))
            out[inside] = b[at[inside]] == 1
        return pa.array(out)

    return arrow_udf(kept, "boolean")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id (a row without an
    id only if no other has one), of rows that repeat it the one with the
    smallest text hash, of equal rows the first. What is decided goes back as a
    bitmap a file, so no text is shuffled, and none is written if ``docs`` is a
    scan of files."""
    rows = _file_rows(docs)
    own = rows.select("_file", "_at", F.col("_row").getField(id_col).alias("_id"), F.col("_row").getField(text).alias("_text"))
    found = row_components(own, "_id", "_text", SHINGLE, RADIUS, [F.col("_file"), F.col("_at"), F.xxhash64("_text").alias("_hash")])
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_hash", "_file", "_at")).alias("_best")).select("_best.*")
    bitmaps = best.groupBy(F.col("_file").alias("file"), F.bitmap_bucket_number(F.col("_at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_at") + 1)).alias("bits"))
    folder = scratch(docs.sparkSession, "kept")
    bitmaps.repartition(partitions(docs.sparkSession), "file").write.partitionBy("file").parquet(folder)
    return unpacked(rows.where(_kept_udf(folder)(F.col("_file"), F.col("_at"))).select("_row"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash_components(table(spark, sf_dir, "documents"))
    return x.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
