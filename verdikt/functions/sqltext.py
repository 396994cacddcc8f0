"""Small helpers for writing expressions as Spark SQL text.

Hot expression builders emit SQL text and hand it to ``F.expr`` once: a
Python ``Column`` tree costs one driver-to-JVM call per node, an expression
written as text costs one call in total, which keeps query construction
cheap when an expression has dozens of nodes.
"""

from __future__ import annotations


def lit(value: str) -> str:
    """A Spark SQL string literal holding exactly ``value``."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    """A quoted column reference."""
    return "`" + name.replace("`", "``") + "`"


def case(pairs: list[tuple[str, str]], default: str | None = None) -> str:
    """``CASE WHEN c1 THEN v1 ... [ELSE d] END``; NULL when ``pairs`` is empty."""
    if not pairs:
        return default if default is not None else "NULL"
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {body}{tail} END"
