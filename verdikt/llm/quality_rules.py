"""Quality rules with adaptive thresholds.

Each text gets a few integer measures. For every (language, source) the
distribution of each measure is kept in a mergeable quantile sketch: a
log-linear histogram (32 buckets per power of two, so a quantile is exact
below 64 and within 1/32 above) whose merge is the sum of its counts. It is
one grouped count in Spark; sketches of a language are the sums of those of
its sources. The sketches give a fence per group and measure,

    fence = q3 + SPREAD * (q3 - q1) + slack of the measure

(and the mirror image below ``q1`` for word length), pulled towards the fence
of the whole language with the weight of ``PRIOR`` documents, so that a small
source isn't judged by its own few texts. The fences are then joined to the
documents by (language, source) and the rows beyond a fence are rejected.

Defined cases: a null or empty text has no words, fails the base rule and is
rejected. Null language or source is a group of its own. Repeated rows are
judged alike, each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import arrow_udf, col, packed, prepare, saved, table, utf8

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
SPREAD = 6
PRIOR = 200

# measure -> (rate as SQL over the counts, slack above, slack below or None).
# Rates are per million, word length is in thousandths of a code point.
MEASURES = {
    "symbol_rate": ("n_symbols * 1000000 div greatest(word_chars, 1)", 60000, None),
    "dup_line_rate": ("n_dup_lines * 1000000 div greatest(n_lines, 1)", 400000, None),
    "repeat_rate": ("n_repeat_words * 1000000 div greatest(n_words, 1)", 450000, None),
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", 3000, 2000),
}

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def repeated_positions(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    pair = a[:-1] * size + a[1:]
    if size > 2_000_000:  # the three ids wouldn't fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * size + a[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_positions(words),
    )


def counts_udf():
    kind = pa.struct([(n, pa.int64()) for n in COUNTS.names])

    def counts(texts: pa.Array) -> pa.Array:
        rows = [base_counts(x) for x in utf8(texts)]
        cols = list(zip(*rows)) or [[]] * len(COUNTS.names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind))

    return arrow_udf(counts, COUNTS)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (the input row) beside the counts, rates and the base verdict."""
    x = packed(docs).withColumn("_c", counts_udf()(F.col("_row").getField(text)))
    x = x.select("_row", "_c.*")
    rates = [F.expr(f"cast({sql} as bigint)").alias(m) for m, (sql, _, _) in MEASURES.items()]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.select("*", *rates, failed.alias("base_failed"))


def bucket(v: str) -> str:
    """Log-linear bucket of a non-negative integer, as SQL."""
    e = f"cast(length(bin({v})) - 6 as int)"
    return f"case when {v} < 64 then {v} else {e} * 32 + shiftright({v}, {e}) end"


def bucket_floor(b: str) -> str:
    e = f"cast({b} div 32 - 1 as int)"
    return f"case when {b} < 64 then {b} else shiftleft({b} - {e} * 32, {e}) end"


def sketches(measures: DataFrame, lang: Column, source: Column) -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows that pass the base rule."""
    values = F.expr("stack(%d, %s) as (measure, value)" % (len(MEASURES), ", ".join(f"'{m}', {m}" for m in MEASURES)))
    x = measures.where("not base_failed").select(lang.alias("lang"), source.alias("source"), *MEASURES)
    x = x.select("lang", "source", values)
    return x.groupBy("lang", "source", "measure", F.expr(bucket("value")).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Fences of each group of ``keys`` from the merged sketches: low and high
    per measure, and the number of documents. A group has at most some hundred
    buckets a measure."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    x = merged.withColumn("up_to", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * q, F.expr(bucket_floor("bucket"))))
    q = x.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("docs"))
    spread = F.lit(SPREAD) * (F.col("q3") - F.col("q1"))
    high = F.create_map(*[y for m, (_, up, _) in MEASURES.items() for y in (F.lit(m), F.lit(up).cast("long"))])
    low = F.create_map(*[y for m, (_, _, down) in MEASURES.items() if down for y in (F.lit(m), F.lit(down).cast("long"))])
    return q.select(
        *keys, "measure", "docs", (F.col("q3") + spread + high[F.col("measure")]).alias("high"), (F.col("q1") - spread - low[F.col("measure")]).alias("low")
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): a low and a high bound for each measure."""
    own, pooled = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"])
    pooled = pooled.select(F.col("lang").alias("_lang"), F.col("measure").alias("_m"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    both = own.join(pooled, own["lang"].eqNullSafe(pooled["_lang"]) & (own["measure"] == pooled["_m"]))
    mix = lambda c: F.expr(f"cast(floor((docs * cast({c} as decimal(30)) + {PRIOR} * cast(_{c} as decimal(30))) / (docs + {PRIOR})) as bigint)")
    pick = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c)))
    x = both.select("lang", "source", "measure", mix("high").alias("high"), mix("low").alias("low"))
    return x.groupBy("lang", "source").agg(
        *[pick("high", m).alias(f"{m}_high") for m in MEASURES], *[pick("low", m).alias(f"{m}_low") for m, (_, _, down) in MEASURES.items() if down]
    )


def judged(measures: DataFrame, bounds: DataFrame, lang: Column, source: Column) -> DataFrame:
    """Join the bounds by language and source; ``kept`` is the verdict.
    ``bounds`` should be a written table: small ones are then broadcast by the
    planner's own size check, large ones joined with skew handling."""
    b = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *bounds.columns[2:])
    x = measures.withColumns({"_l": lang, "_s": source})
    x = x.join(b, x["_l"].eqNullSafe(b["_lang"]) & x["_s"].eqNullSafe(b["_source"]), "left")
    inside = F.lit(True)
    for m, (_, _, down) in MEASURES.items():
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
        if down:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    return x.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_l", "_s", "_lang", "_source")


def quality_rules(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """All rows as ``_row`` with counts, measures, bounds and ``kept``. The
    texts are measured once for the sketches and once for the verdict, which
    is cheaper than shuffling them; see ``op1`` for the form without texts."""
    prepare(docs.sparkSession)
    row = F.col("_row")
    first = measured(docs.select(col(lang), col(source), col(text)), text)
    bounds = saved(thresholds(sketches(first, row.getField(lang), row.getField(source))), "bounds")
    return judged(measured(docs, text), bounds, row.getField(lang), row.getField(source))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    row = F.col("_row")
    x = measured(docs).withColumn("_row", F.struct(row["doc_id"].alias("doc_id"), row["lang"].alias("lang"), row["source"].alias("source")))
    x = saved(x, "measures")
    bounds = saved(thresholds(sketches(x, row["lang"], row["source"])), "bounds")
    return judged(x, bounds, row["lang"], row["source"]).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES
    )

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
n AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) t(k) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols * 1000000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_line_rate,
  n_repeat_words * 1000000 // greatest(n_words, 1) AS repeat_rate, word_chars * 1000 // greatest(n_words, 1) AS word_length FROM c),
v AS (SELECT lang, source, measure, value, CASE WHEN value < 64 THEN 0 ELSE length(bin(value)) - 6 END AS e FROM (
  UNPIVOT (SELECT lang, source, symbol_rate, dup_line_rate, repeat_rate, word_length FROM m WHERE NOT base_failed)
  ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME measure VALUE value)),
b AS (SELECT lang, source, measure, (value >> e) << e AS low FROM v),
q AS (SELECT *, count(*) OVER (PARTITION BY lang, source, measure ORDER BY low) AS up, count(*) OVER (PARTITION BY lang, source, measure) AS docs,
  count(*) OVER (PARTITION BY lang, measure ORDER BY low) AS lang_up, count(*) OVER (PARTITION BY lang, measure) AS lang_docs FROM b),
own AS (SELECT lang, source, measure, max(docs) AS docs, min(low) FILTER (4 * up >= docs) AS q1, min(low) FILTER (4 * up >= 3 * docs) AS q3 FROM q GROUP BY ALL),
pool AS (SELECT lang, measure, min(low) FILTER (4 * lang_up >= lang_docs) AS q1, min(low) FILTER (4 * lang_up >= 3 * lang_docs) AS q3 FROM q GROUP BY ALL),
s AS (SELECT * FROM (VALUES {slacks}) t(measure, up, down)),
f AS (SELECT own.lang, own.source, own.measure,
  CAST(floor(CAST(docs * (own.q3 + {spread} * (own.q3 - own.q1) + s.up) + {prior} * (pool.q3 + {spread} * (pool.q3 - pool.q1) + s.up) AS DOUBLE) / (docs + {prior})) AS BIGINT) AS high,
  CAST(floor(CAST(docs * (own.q1 - {spread} * (own.q3 - own.q1) - s.down) + {prior} * (pool.q1 - {spread} * (pool.q3 - pool.q1) - s.down) AS DOUBLE) / (docs + {prior})) AS BIGINT) AS low
  FROM own JOIN pool ON own.lang IS NOT DISTINCT FROM pool.lang AND own.measure = pool.measure JOIN s ON s.measure = own.measure),
t AS (SELECT lang, source, {picks} FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({inside}, TRUE) AS kept, symbol_rate, dup_line_rate, repeat_rate, word_length
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
""".format(
    spread=SPREAD,
    prior=PRIOR,
    slacks=", ".join(f"('{m}', {up}, {down or 0})" for m, (_, up, down) in MEASURES.items()),
    picks=", ".join(f"max({b}) FILTER (measure = '{m}') AS {m}_{b}" for m in MEASURES for b in ("high", "low")),
    inside=" AND ".join(f"{m} <= {m}_high" + (f" AND {m} >= {m}_low" if down else "") for m, (_, _, down) in MEASURES.items()),
)
