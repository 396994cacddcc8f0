"""Label extraction from model text: the eight dialects plus chain records.

Every dialect is a composition of built-in string / regex / JSON expressions,
so it runs inside whole-stage codegen with no Python worker. A dialect turns
a response text into ``raw_value`` (the answer text, NULL when unreadable)
and ``parse_status``; :mod:`verdikt.functions.labels` turns the text into a
number with one rule for all dialects.

Dialects
--------
greedy      first '{' to last '}' (across lines), '//' to end of line removed,
            strict JSON, read the answer key
greedy_raw  greedy without removing comments
regex       first  ["']?anomaly["']? : ["']?<digits>  anywhere in the text
flat        newlines turned into spaces, CR dropped, first '{' to the first
            '}' after it, literal backslash-n removed, comments removed,
            strict JSON
repair      a comma put after every quote that is followed by optional white
            space and a newline, then the first block, strict JSON
rawline     regex on the still-escaped JSONL line: \\"key\\" : <digits>
strict      the whole text must be one JSON object
loose       like regex, but no quote allowed before the digits

The expressions are written as Spark SQL text (see
:mod:`verdikt.functions.sqltext`) and staged in projections by
:func:`extract_labels`; public helpers take column names and return Columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.config import CHAIN_DEFAULT_ANOMALY, CHAIN_DEFAULT_TEXT
from verdikt.functions.sqltext import case, ident, lit
from verdikt.functions.strict_json import single_sql, strict_array_sql, with_strict_object

JSON_DIALECTS = ("greedy", "greedy_raw", "flat", "repair", "strict")
REGEX_DIALECTS = ("regex", "loose", "rawline")
DIALECTS = JSON_DIALECTS + REGEX_DIALECTS
GREEDY_DIALECTS = ("greedy", "greedy_raw")
LAZY_DIALECTS = ("flat", "repair")

# ASCII white space stripped by Python's str.strip() (Unicode spaces beyond
# ASCII are not stripped here; documented difference).
WHITESPACE = " \t\n\r\x0b\x0c"


# --- SQL text builders ------------------------------------------------------


def after_first_brace_sql(text: str) -> str:
    """Text after the first '{' (NULL when there is none).

    ``split`` on an escaped single character takes Java's fast path (a plain
    character search: no regex engine, no per-character position counting).
    """
    return f"get(split({text}, {lit(chr(92) + '{')}, 2), 1)"


def greedy_keep_sql(rest: str) -> str:
    """Characters of ``rest`` up to and including its last '}' (0 if none);
    ``substring_index`` with a negative count scans from the end."""
    return f"length({rest}) - length(substring_index({rest}, '}}', -1))"


def lazy_keep_sql(rest: str) -> str:
    """Characters of ``rest`` up to and including its first '}' (0 if none)."""
    return f"instr({rest}, '}}')"


def block_sql(rest: str, keep: str) -> str:
    return f"CASE WHEN {keep} > 0 THEN concat('{{', substring({rest}, 1, {keep})) END"


def strip_comments_sql(block: str) -> str:
    """Delete '//' up to the end of each line (also inside strings)."""
    pattern = lit("//[^" + chr(92) + "n]*")
    return f"CASE WHEN instr({block}, '//') > 0 THEN regexp_replace({block}, {pattern}, '') ELSE {block} END"


def block_transform_sql(block: str, dialect: str) -> str:
    """What a JSON dialect does to its block before the strict parse.

    ``flat`` and ``repair`` are defined on the whole answer (flatten the
    text, or add commas, then cut the first block), but neither step adds,
    removes or moves a brace relative to the others, so cutting the block
    from the original text first and transforming only the block gives the
    same document while touching a few bytes instead of the whole answer.
    """
    if dialect == "greedy":
        return strip_comments_sql(block)
    if dialect in ("greedy_raw", "strict"):
        return block
    if dialect == "flat":
        flat = f"translate({block}, {lit(chr(10) + chr(13))}, ' ')"
        return strip_comments_sql(f"replace({flat}, {lit(chr(92) + 'n')}, '')")
    if dialect == "repair":
        return f"regexp_replace({block}, {lit(chr(34) + '(' + chr(92) + 's*' + chr(92) + 'n)')}, {lit(chr(34) + ',$1')})"
    raise ValueError(f"not a JSON dialect: {dialect}")


def regex_pattern(dialect: str, key: str) -> str:
    """Search patterns of the regex dialects.

    The rules allow an optional quote before the key (``["']?key``). That
    prefix never changes the captured digits: every match contains the key,
    the optional quote only moves the match start one character left, and
    matches at different key occurrences cannot overlap. So the pattern
    starts with the literal key, which lets Java search it with Boyer-Moore
    instead of trying a match at every position.
    """
    if dialect == "regex":
        return key + "[\"']?\\s*:\\s*[\"']?([0-9]+)"
    if dialect == "loose":
        return key + "[\"']?\\s*:\\s*([0-9]+)"
    if dialect == "rawline":
        return '\\\\"' + key + '\\\\"\\s*:\\s*([0-9]+)'
    raise ValueError(f"not a regex dialect: {dialect}")


def regex_value_sql(src: str, dialect: str, key: str) -> str:
    """First captured digits of a regex dialect, NULL when there is no match."""
    return f"nullif(regexp_extract({src}, {lit(regex_pattern(dialect, key))}, 1), '')"


# --- Column helpers (take column names) ---------------------------------------


def greedy_block(text: str) -> Column:
    """Text from the first '{' to the last '}' (NULL when there is none);
    equal to a dot-all ``\\{.*\\}`` search, without a regex."""
    rest = after_first_brace_sql(ident(text))
    return F.expr(block_sql(rest, greedy_keep_sql(rest)))


def lazy_block(text: str) -> Column:
    """Text from the first '{' to the first '}' after it (NULL when none)."""
    rest = after_first_brace_sql(ident(text))
    return F.expr(block_sql(rest, lazy_keep_sql(rest)))


def regex_value(text: str, dialect: str, key: str) -> Column:
    """First captured digits of a regex dialect for column ``text``."""
    return F.expr(regex_value_sql(ident(text), dialect, key))


def raw_line(video: Column, response: Column) -> Column:
    """The JSONL line a keyed log holds for one (video, response) pair."""
    return F.to_json(F.create_map(video, response))


# --- the staged extraction ------------------------------------------------------


# What became of an answer.
STATUSES = ("ok", "null_response", "no_block", "bad_json", "no_value", "no_match")


def extract_labels(
    df: DataFrame,
    dialect: str | Column,
    key: str | Column,
    combos: Iterable[tuple[str, str]] | None = None,
    text_col: str = "response",
    line_col: str | None = None,
    video_col: str = "video",
) -> DataFrame:
    """Add ``raw_value`` and ``parse_status`` to ``df``.

    ``dialect`` / ``key`` are either Python strings (one dialect for the whole
    frame) or columns (per-row dialect, e.g. joined from the run matrix); in
    the latter case ``combos`` lists the (dialect, key) pairs that can occur,
    so every branch is a literal pattern compiled once per task.

    The work is staged in projections so that every scan of the (long)
    answer text happens once per row: text after the first brace, how much
    of it to keep, the block, the small per-dialect transform of the block,
    then one strict parse. Spark does not share sub-expressions across
    conditional branches, so a nested expression would re-scan the text for
    every reference.
    """
    if isinstance(dialect, str):
        if dialect not in DIALECTS:
            raise ValueError(f"unknown dialect {dialect!r}")
        combos = [(dialect, key)]
        D, K = lit(dialect), lit(key)
    else:
        if combos is None:
            raise ValueError("combos is required when the dialect is a column")
        combos = list(dict.fromkeys(combos))
        df = df.withColumns({"_vk_d": dialect, "_vk_k": key if isinstance(key, Column) else F.lit(key)})
        D, K = ident("_vk_d"), ident("_vk_k")

    T = ident(text_col)
    needs_line = any(d == "rawline" for d, _ in combos)
    temps = ["_vk_d", "_vk_k"] if not isinstance(dialect, str) else []
    if needs_line and not line_col:
        # Build the JSONL line once, as its own column.
        df = df.withColumn("_vk_line", raw_line(F.col(video_col), F.col(text_col)))
        line_col = "_vk_line"
        temps.append("_vk_line")
    L = ident(line_col) if needs_line else "CAST(NULL AS STRING)"

    dialects = sorted({d for d, _ in combos})
    json_ds = [d for d in dialects if d in JSON_DIALECTS]
    greedy_ds = [d for d in json_ds if d in GREEDY_DIALECTS]
    lazy_ds = [d for d in json_ds if d in LAZY_DIALECTS]
    rx_combos = [(d, k) for d, k in combos if d in REGEX_DIALECTS]
    keys = sorted({k for d, k in combos if d in JSON_DIALECTS})

    def is_in(ds):
        return f"{D} IN ({', '.join(lit(x) for x in ds)})" if ds else "FALSE"

    # Stage 1: text after the first '{' (block dialects) and the regex value.
    rx = case([(f"{D} = {lit(d)} AND {K} = {lit(k)}", regex_value_sql(L if d == "rawline" else T, d, k)) for d, k in rx_combos])
    out = df.withColumns(
        {
            "_vk_rest": F.expr(f"CASE WHEN {is_in(greedy_ds + lazy_ds)} THEN {after_first_brace_sql(T)} END"),
            "_vk_rx": F.expr(f"CAST({rx} AS STRING)"),
        }
    )
    # Stage 2: how much of it the block keeps (greedy: up to the last '}';
    # lazy: up to the first '}').
    R = ident("_vk_rest")
    keep = case([(is_in(greedy_ds), greedy_keep_sql(R)), (is_in(lazy_ds), lazy_keep_sql(R))])
    out = out.withColumn("_vk_keep", F.expr(f"CAST({keep} AS INT)"))
    # Stage 3: the block (or the whole text for 'strict').
    blk = case([(is_in(greedy_ds + lazy_ds), block_sql(R, ident("_vk_keep"))), (f"{D} = 'strict'", T)])
    out = out.withColumn("_vk_blk", F.expr(f"CAST({blk} AS STRING)"))
    # Stage 4: per-dialect transform of the (short) block.
    B = ident("_vk_blk")
    doc = case([(f"{D} = {lit(d)}", block_transform_sql(B, d)) for d in json_ds])
    out = out.withColumns({"_vk_doc": F.expr(f"CAST({doc} AS STRING)"), "_vk_json": F.expr(is_in(json_ds))})
    out = out.drop("_vk_rest", "_vk_keep", "_vk_blk")

    # Stage 5: strict parse of the candidate, once.
    if keys:
        out = with_strict_object(out, "_vk_doc", keys, "_vk_obj", guard="`_vk_doc` IS NOT NULL")
        field = case([(f"{K} = {lit(k)}", f"`_vk_obj`.{ident(k)}") for k in keys])
    else:
        out = out.withColumn("_vk_obj", F.lit(None))
        field = "CAST(NULL AS STRING)"

    # Stage 6: answer text and status.
    value = f"CASE WHEN `_vk_json` THEN {field} ELSE `_vk_rx` END"
    status = (
        f"CASE WHEN {T} IS NULL THEN 'null_response'"
        " WHEN `_vk_json` AND `_vk_doc` IS NULL THEN 'no_block'"
        " WHEN `_vk_json` AND `_vk_obj` IS NULL THEN 'bad_json'"
        f" WHEN `_vk_json` AND ({field}) IS NULL THEN 'no_value'"
        " WHEN NOT `_vk_json` AND `_vk_rx` IS NULL THEN 'no_match'"
        " ELSE 'ok' END"
    )
    out = out.withColumns({"raw_value": F.expr(value), "parse_status": F.expr(status)})
    return out.drop("_vk_doc", "_vk_rx", "_vk_json", "_vk_obj", *temps)


# --- E9 chain records -----------------------------------------------------------

CHAIN_FIELDS = ["video_description", "reasoning", "anomaly"]


def chain_cleaned_sql(text: str) -> str:
    """Fence characters and white space stripped, blank lines made a space."""
    ws = lit(WHITESPACE)
    cleaned = f"btrim(btrim({text}, {lit('`json')}), {ws})"
    return f"btrim(replace({cleaned}, {lit(chr(10) * 2)}, ' '), {ws})"


def _chain_struct_sql(obj: str, keys: str) -> str:
    """``keys``: SQL for the names of the object's members."""

    def member(name: str, default: str) -> str:
        # A default stands for a missing member; an explicit null stays null.
        given = f"{obj} IS NOT NULL AND {obj}.{name} IS NULL AND array_contains({keys}, {lit(name)})"
        return f"'{name}', CASE WHEN {given} THEN CAST(NULL AS STRING) ELSE coalesce({obj}.{name}, {lit(default)}) END"

    return (
        f"named_struct({member('video_description', CHAIN_DEFAULT_TEXT)}, {member('reasoning', CHAIN_DEFAULT_TEXT)}, "
        f"{member('anomaly', str(CHAIN_DEFAULT_ANOMALY))}, 'parsed', {obj} IS NOT NULL)"
    )


def chain_record(text: str) -> Column:
    """First-pass chain answer -> struct(video_description, reasoning, anomaly, parsed).

    The fence characters backtick, j, s, o, n are stripped from both ends as
    a character set, then white space; blank lines become a space; the rest
    must be one JSON object. Missing members take defaults ('NAN', 'NAN', 0), an
    explicit null stays NULL; anything unreadable gives all defaults, so a broken first answer reads as
    "normal" rather than invalid. (Expression form over column ``text``; hot
    paths use :func:`with_chain_record`.)
    """
    obj = single_sql(strict_array_sql(chain_cleaned_sql(ident(text)), CHAIN_FIELDS))
    return F.expr(_chain_struct_sql(f"({obj})", f"json_object_keys({chain_cleaned_sql(ident(text))})"))


def with_chain_record(df: DataFrame, text_col: str, out_col: str = "record") -> DataFrame:
    """E9 as a transform: parse once per row, then apply the defaults."""
    staged = df.withColumn("_cr_doc", F.expr(chain_cleaned_sql(ident(text_col))))
    staged = with_strict_object(staged, "_cr_doc", CHAIN_FIELDS, "_cr_obj")
    return staged.withColumn(out_col, F.expr(_chain_struct_sql("`_cr_obj`", "json_object_keys(`_cr_doc`)"))).drop("_cr_doc", "_cr_obj")
