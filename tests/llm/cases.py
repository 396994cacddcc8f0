"""Small awkward inputs shared by the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ta", "ren", "o", "lis", "mé", "kur", "ab"]) for _ in range(1 + i % 4)) + str(i % 7) * (i % 11 == 0) for i in range(vocabulary)]
    out = []
    for k in range(n):
        out.append(r.choice(words))
        if k % 13 == 12:
            out[-1] += "." + r.choice([" ", "\n"])
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in every column, empty, very long, tied and repeated rows."""
    rows = [
        (1, prose(120, 1), "en", "a", 1),
        (2, prose(120, 1), "en", "a", 1),
        (2, prose(120, 1), "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", "en", "b", 0),
        (5, " \t\n\x0b\x0c\r ", None, "b", 6),
        (None, prose(90, 2), "de", None, 3),
        (None, prose(90, 2), "de", None, 3),
        (6, prose(30_000, 3, 3000), None, None, 4),
        (7, "x" * 200_000, "en", "a", 5),
        (8, "one two", "en", "b", 7),
        (-9, "▁  　 émoji \U0001f600 \u0000 end", "fr", "c", 7),
    ]
    rows += [(10 + i, prose(60 + 5 * i, 10 + i), ["en", "de"][i % 2], ["a", "b", "c"][i % 3], 0) for i in range(30)]
    return rows


def frame(spark, rows, extra: bool = False):
    """``extra``: with columns whose names an operator might want for itself."""
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("kept", "id", "_row", "fp", "n_words", "component_id", "block", "key", "bin", "_id", "log_weight", "base_failed"):
            df = df.withColumn(c, F.lit("theirs"))
    return df
