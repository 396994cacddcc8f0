"""Answer text -> label, and the scoring policies.

One rule for every dialect: ``true``/``false`` are 1/0; text that looks like
a decimal number is read as a double and truncated toward zero; anything else
is invalid (NULL). The guard regex matters: Spark would also cast ``1d``,
``1f`` and ``NaN`` to double, Python would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdikt.config import LABEL_MAP

NUMERIC_PATTERN = r"^\s*[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"


def label_number(raw: Column, coerce: bool | Column = True) -> Column:
    """Answer text as a double (NULL when it is not a number or boolean).

    ``coerce`` (J7): read any decimal. Without it only whole numbers are
    labels, so ``0.9`` is invalid instead of 0.
    """
    return coerced(answer_number(raw), coerce)


def answer_number(raw: Column) -> Column:
    """Answer text as a double, fractions included."""
    return (
        F.when(raw == F.lit("true"), F.lit(1.0))
        .when(raw == F.lit("false"), F.lit(0.0))
        .when(raw.rlike(NUMERIC_PATTERN), raw.try_cast("double"))
    )


def coerced(number: Column, coerce: bool | Column) -> Column:
    """J7 on a number: without ``coerce`` a fraction is no label."""
    if coerce is True:
        return number
    whole = F.when(number == F.floor(number), number)
    return whole if coerce is False else F.when(coerce, number).otherwise(whole)


def label_int(number: Column) -> Column:
    """Truncate toward zero; overflow is invalid."""
    return number.try_cast("int")


def truth_label(label_text: Column, mapping: dict[str, int] | None = None) -> Column:
    """Ground-truth label text -> 0/1 (NULL for unknown text)."""
    mapping = mapping or LABEL_MAP
    expr = None
    for k, v in mapping.items():
        expr = F.when(label_text == F.lit(k), F.lit(v)) if expr is None else expr.when(label_text == F.lit(k), F.lit(v))
    return expr


def predicted_label(number: Column, truth: Column, policy: str | Column) -> Column:
    """Predicted label under an invalid-answer policy.

    ``wrong``    an invalid answer becomes ``1 - truth`` (counted wrong)
    ``negative`` every answer is binarised: ``>= 1`` is 1, the rest (invalid
                 included) is 0
    """
    wrong = F.coalesce(label_int(number), F.lit(1) - truth)
    negative = F.when(number >= F.lit(1.0), F.lit(1)).otherwise(F.lit(0))
    if isinstance(policy, str):
        if policy == "wrong":
            return wrong
        if policy == "negative":
            return negative
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(policy == F.lit("negative"), negative).otherwise(wrong)


def strip_media_suffix(name: Column, suffix: str = ".mp4") -> Column:
    """Remove a literal suffix text anywhere in the name (not only at the end)."""
    return F.replace(name, F.lit(suffix), F.lit(""))
