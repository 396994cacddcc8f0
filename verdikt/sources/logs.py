"""Response-log scans.

Logs are JSONL text. The scan keeps every line countable: a line that is not
a JSON object becomes a row with ``parse_status = 'bad_line'`` instead of
being dropped, so parse quality can be reported (A11) without a second read.

Line order matters for last-wins deduplication; text files carry no line
number, so each row gets a 64-bit order: the rank of its file, then its place
there. Files rank by the commit they were written in (``commit=<n>`` in the
path, see :func:`verdikt.streaming.ingest.write_log_files`), without one by
modification time, then by path: modification times are too coarse to tell
passes apart (a second on some stores). The place is the start of the row's
split plus a per-task increasing number. A task that reads a whole split reads
nothing else, and a row is at least a byte, so places of a file never run into
those of its next split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from verdikt.config import LINE_KEY_PATTERN, SCANS
from verdikt.functions.sqltext import ident, lit

MISSING_ID = "NAN"

_SENTINEL = "~vk~"
_LINE_TAIL = ', {"' + _SENTINEL + '": 1}]'
KEYED_LINE_DDL = "ARRAY<MAP<STRING, STRING>>"
IDPRED_DDL = "ARRAY<STRUCT<id: STRING, truth: STRING, pred: STRING, `~vk~`: STRING>>"
_LINE_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


# Bits of a row's place in its file; the rank of the file lies above.
PLACE_BITS = 40
# Largest file dictionary that is broadcast (some 20 MB); beyond it, lines carry
# an order of the same sequence as a struct.
MAX_RANKED = 200_000


def commit_of(path: Column) -> Column:
    """The commit number in a path, -1 where there is none."""
    return F.coalesce(F.regexp_extract(path, r"/commit=(\d+)/", 1).try_cast("long"), F.lit(-1).cast("long"))


def _load(spark: SparkSession, fmt: str, paths: str | list[str], recursive: bool) -> DataFrame:
    reader = spark.read.format(fmt)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(paths if isinstance(paths, list) else [paths])


def file_ranks(spark: SparkSession, paths: str | list[str], recursive: bool = False, limit: int = MAX_RANKED) -> DataFrame | None:
    """(file_path, rank) of the files, or None if there are more than ``limit``.
    The contents stay unread; Spark's own file index holds as many paths."""
    meta = F.col("_metadata")
    path = meta.getField("file_path")
    files = _load(spark, "binaryFile", paths, recursive).select(path.alias("path"), commit_of(path).alias("commit"), meta.getField("file_modification_time").alias("mtime"))
    rows = files.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rows.sort(key=lambda r: (r["commit"], r["mtime"], r["path"]))
    return spark.createDataFrame([(r["path"], i) for i, r in enumerate(rows)], "file_path string, rank long")


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False, max_ranked: int = MAX_RANKED) -> DataFrame:
    """Raw lines of one or many log files with their file order.

    Columns: ``line``, ``file_path``, ``line_order`` (a long; a struct of the
    same sequence where there are more than ``max_ranked`` files).
    """
    df = _load(spark, "text", paths, recursive)
    meta = F.col("_metadata")
    path, block, row = meta.getField("file_path"), meta.getField("file_block_start"), F.monotonically_increasing_id()
    ranks = file_ranks(spark, paths, recursive, max_ranked)
    if ranks is None:
        order = F.struct(commit_of(path).alias("commit"), meta.getField("file_modification_time").alias("mtime"), path.alias("path"), block.alias("block"), row.alias("row"))
        return df.select(F.col("value").alias("line"), path.alias("file_path"), order.alias("line_order"))
    place = block + row.bitwiseAND(F.lit((1 << 33) - 1))
    lines = df.select(F.col("value").alias("line"), path.alias("file_path"), place.alias("_place"))
    # An inner join would drop the lines of a file that came after the listing.
    lines = lines.join(F.broadcast(ranks), "file_path", "left")
    known = F.coalesce("rank", F.raise_error(F.concat(F.lit("file not listed: "), "file_path")).cast("long"))
    return lines.select("line", "file_path", (F.shiftleft(known, PLACE_BITS) + F.col("_place")).alias("line_order"))


def run_from_path(path: Column, pattern: str, group: int = 1) -> Column:
    """Pull a run attribute (model, method) out of a log path by regex."""
    return F.regexp_extract(path, pattern, group)


def _entries_sql(scan: str, line: str, distinct: bool = False) -> str:
    """The (key, value, claimed) entries of one parsed line, as SQL over the
    staged columns ``_kl_map`` and ``_kl_ip``; of a key that an object repeats
    only the last, if ``distinct``."""
    entry = "named_struct('key', {k}, 'value', {v}, 'claimed', {t}, 'status', {s})"
    none = "CAST(NULL AS STRING)"
    one = lambda k, v, t=none, s="'ok'": "array(" + entry.format(k=k, v=v, t=t, s=s) + ")"
    bad = one(none, none, s="'bad_line'")
    if scan == "raw":
        return one(raw_line_key_sql(line), line)
    if scan == "keyed":
        entries = "map_entries(`_kl_map`)"
        if distinct:
            later = f"exists(slice({entries}, i + 2, size(`_kl_map`)), x -> x.key = e.key)"
            entries = f"CASE WHEN size(`_kl_map`) > 1 THEN filter({entries}, (e, i) -> NOT {later}) ELSE {entries} END"
        return (
            f"CASE WHEN `_kl_map` IS NULL THEN {bad} ELSE transform({entries}, e -> "
            + entry.format(k="e.key", v="e.value", t=none, s="'ok'")
            + ") END"
        )
    i, p, t = "`_kl_ip`.id", "`_kl_ip`.pred", "`_kl_ip`.truth"
    if scan == "idpred":
        return f"CASE WHEN `_kl_ip` IS NULL THEN {bad} ELSE {one(f"coalesce({i}, {lit(MISSING_ID)})", f"coalesce({p}, '')", t)} END"
    if scan == "idpred_drop":
        empty = f"coalesce({i}, '') = '' OR coalesce({p}, '') = ''"
        return f"CASE WHEN `_kl_ip` IS NULL THEN {bad} WHEN {empty} THEN array() ELSE {one(i, p, t)} END"
    raise ValueError(f"unknown scan {scan!r}")


def parse_lines(lines: DataFrame, scan: str | Column = "keyed", scans: Sequence[str] | None = None,
                line_col: str = "line", order_col: str = "line_order") -> DataFrame:
    """Log lines -> one row per answer.

    ``scan`` is one of :data:`verdikt.config.SCANS`, or a column holding one
    per row (``scans`` then lists those that occur):

    ``keyed``        every (key, value) pair of a JSON object; a list or
                     number comes through as its raw JSON text
    ``idpred``       one object with ``id``, ``pred`` and an unused ``truth``;
                     a missing id becomes 'NAN', a missing pred ''
    ``idpred_drop``  the same, but rows with an empty id or pred are dropped
    ``raw``          no decoding: the key is the line's first key ('unknown'
                     if it has none), the value is the line

    Adds ``video``, ``response``, ``line_status`` ('ok' / 'bad_line') and
    ``claimed_truth``. A long ``order_col`` stays as it is, and of a key that a
    line repeats only the last entry comes; another order is extended by the
    entry's position in its line. A line that is no JSON object keeps one row with a NULL video. Other
    columns are carried through. Each line is parsed once: the parse feeds a
    generator, and filters on its output stay above it.
    """
    packed = order_col in lines.columns and isinstance(lines.schema[order_col].dataType, LongType)
    if order_col not in lines.columns:
        lines = lines.withColumn(order_col, F.lit(None).cast("long"))
    many = not isinstance(scan, str)
    found = tuple(scans or SCANS) if many else (scan,)
    if many:
        lines = lines.withColumn("_kl_scan", scan)
    L = ident(line_col)
    when = lambda *names: " OR ".join(f"`_kl_scan` = {lit(n)}" for n in names) if many else "TRUE"
    opts = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in _LINE_OPTIONS.items())
    # Same sentinel wrapper as the strict reader: a line must be exactly one
    # JSON object.
    parse = lambda ddl, *names: (
        f"CASE WHEN {when(*names)} THEN from_json(concat('[', {L}, {lit(_LINE_TAIL)}), {lit(ddl)}, map({opts})) END"
    )
    keyed, idpred = [n for n in found if n == "keyed"], [n for n in found if n.startswith("idpred")]
    staged = lines
    if keyed:
        staged = staged.withColumn("_kl_arr", F.expr(parse(KEYED_LINE_DDL, *keyed)))
        intact = f"size(`_kl_arr`) = 2 AND try_element_at(get(`_kl_arr`, 1), {lit(_SENTINEL)}) = '1'"
        staged = staged.withColumn("_kl_map", F.expr(f"CASE WHEN {intact} THEN get(`_kl_arr`, 0) END"))
    if idpred:
        staged = staged.withColumn("_kl_iparr", F.expr(parse(IDPRED_DDL, *idpred)))
        intact = f"size(`_kl_iparr`) = 2 AND get(`_kl_iparr`, 1).{ident(_SENTINEL)} = '1'"
        staged = staged.withColumn("_kl_ip", F.expr(f"CASE WHEN {intact} THEN get(`_kl_iparr`, 0) END"))
    entries = "CASE " + " ".join(f"WHEN {when(n)} THEN {_entries_sql(n, L, packed)}" for n in found) + " END"
    keep = [ident(c) for c in lines.columns if c not in (line_col, order_col, "_kl_scan")]
    out = staged.selectExpr(*keep, L, ident(order_col), f"posexplode({entries}) AS (`_kl_pos`, `_kl_entry`)")
    return out.selectExpr(
        *keep,
        "`_kl_entry`.key AS video",
        "`_kl_entry`.value AS response",
        "TRY_CAST(`_kl_entry`.claimed AS INT) AS claimed_truth",
        L,
        "`_kl_entry`.status AS line_status",
        ident(order_col) if packed else f"named_struct('line', {ident(order_col)}, 'pos', `_kl_pos`) AS {ident(order_col)}",
    )


def parse_keyed_lines(lines: DataFrame, line_col: str = "line", order_col: str = "line_order") -> DataFrame:
    """Every (key, value) pair of a keyed JSONL line becomes a row."""
    return parse_lines(lines, "keyed", line_col=line_col, order_col=order_col).drop("claimed_truth")


def read_keyed_log(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """S1 end to end: files -> (video, response, line, line_status, line_order)."""
    return parse_keyed_lines(read_lines(spark, paths, recursive))


def parse_idpred_lines(lines: DataFrame, line_col: str = "line", drop_empty: bool = False, order_col: str = "line_order") -> DataFrame:
    """One object per line with ``id`` and ``pred`` (and an unused
    ``truth``). ``drop_empty`` leaves out rows with an empty id or pred, and bad
    lines with them; :func:`parse_lines` keeps those countable."""
    if drop_empty:
        return parse_lines(lines, "idpred_drop", line_col=line_col, order_col=order_col).where(F.col("line_status") == "ok")
    return parse_lines(lines, "idpred", line_col=line_col, order_col=order_col)


def raw_line_key_sql(line: str) -> str:
    return f"coalesce(nullif(regexp_extract({line}, {lit(LINE_KEY_PATTERN)}, 1), ''), 'unknown')"


def parse_raw_lines(lines: DataFrame, line_col: str = "line", order_col: str = "line_order") -> DataFrame:
    """S3: no JSON decoding; the video key comes from a regex on the line, and
    the line itself is the answer text."""
    return parse_lines(lines, "raw", line_col=line_col, order_col=order_col).drop("claimed_truth")
