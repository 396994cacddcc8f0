"""Strict JSON reading with built-in expressions only.

``from_json`` on its own is lenient: it returns the first object of
``{..} junk {..}`` and accepts single quotes. The candidate is therefore
parsed inside an array followed by a sentinel element:
``[`` doc ``, {"~vk~": 1}]``. Junk after the document becomes a syntax
error inside the array, a second top-level value becomes an extra element,
and a document that closes the array early (``{..}] and [{..}``) loses the
sentinel, since the parser ignores whatever follows the root value. So
"exactly two elements, the second one the intact sentinel" is the strict
test. A struct schema keeps the *last* duplicate key, as Python's
``json.loads`` does.

The parse is expensive, so hot paths use :func:`with_strict_object`, which
parses in one projection and tests the result in the next; the optimizer
does not merge projections that would duplicate a non-cheap expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.sqltext import ident, lit

_STRICT_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowComments": "false",
    "allowUnquotedControlChars": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "mode": "PERMISSIVE",
}

SENTINEL = "~vk~"
_TAIL = ', {"' + SENTINEL + '": 1}]'


def _field_ddl(fields: list[str]) -> str:
    cols = ", ".join(f"`{f}`: STRING" for f in [*fields, SENTINEL])
    return f"ARRAY<STRUCT<{cols}>>"


def strict_array_sql(doc: str, fields: list[str]) -> str:
    """SQL text: ``doc`` (SQL text) parsed with the sentinel wrapper."""
    opts = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in _STRICT_OPTIONS.items())
    return f"from_json(concat('[', {doc}, {lit(_TAIL)}), {lit(_field_ddl(fields))}, map({opts}))"


def single_sql(arr: str) -> str:
    """SQL text: the document's value when the sentinel came back intact."""
    ok = f"size({arr}) = 2 AND get({arr}, 1).{ident(SENTINEL)} = '1'"
    return f"CASE WHEN {ok} THEN get({arr}, 0) END"


def strict_object(doc: str, fields: list[str]) -> Column:
    """Parse the column ``doc`` as exactly one JSON value; a struct of ``fields``.

    NULL when ``doc`` is NULL, is not valid JSON, or holds more than one
    top-level value. Every field is read as text: numbers come back as their
    literal text, strings unquoted, nested values as raw JSON. (Single
    expression form; see :func:`with_strict_object` for hot paths.)
    """
    return F.expr(single_sql(strict_array_sql(ident(doc), fields)))


def with_strict_object(df: DataFrame, doc_col: str, fields: list[str], out_col: str, guard: str | None = None) -> DataFrame:
    """Add ``out_col`` = strict parse of ``doc_col``, parsing once per row.

    ``guard`` (SQL text) skips the parse where it is false.
    """
    tmp = f"_sj_{out_col}"
    arr = strict_array_sql(ident(doc_col), fields)
    if guard is not None:
        arr = f"CASE WHEN {guard} THEN {arr} END"
    staged = df.withColumn(tmp, F.expr(arr))
    return staged.withColumn(out_col, F.expr(single_sql(ident(tmp)))).drop(tmp)


def strict_field(doc: str, key: str) -> Column:
    """Text of ``doc[key]`` when ``doc`` is one valid JSON object, else NULL."""
    return strict_object(doc, [key]).getField(key)
