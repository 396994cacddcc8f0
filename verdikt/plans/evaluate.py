"""End-to-end evaluation: raw log lines -> scored rows -> sliced metrics.

Plan shape (one job, two shuffles):

    text lines --from_json/explode--> (run, video, response)
               --dialect projection--> (run, video, raw_value, status)   [map side]
               --max_by last-wins----> one row per (run, video)          [shuffle 1, partial hash agg]
               --broadcast join------> + truth and its slice mask        [no shuffle when truth is small]
               --histogram-----------> (run, mask, truth, prediction)    [shuffle 2, partial hash agg]
               --sums----------------> one row per (run, slice)          [a few rows]

The response text never enters a shuffle: extraction runs before the
deduplication, so only the answer's number and status code are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.config import run_matrix
from verdikt.functions.dialects import STATUSES, extract_labels
from verdikt.functions.labels import answer_number
from verdikt.operators.dedup import last_wins
from verdikt.operators.scoring import attach_truth, score_rows
from verdikt.sources.logs import parse_keyed_lines, parse_lines

RUN_COLS = ("model", "method")


def extract_from_lines(
    lines: DataFrame, dialect: str = "greedy", key: str = "result"
) -> DataFrame:
    """S1 + E*: keyed lines -> one row per (run, video, line) with the answer."""
    rows = parse_keyed_lines(lines)
    return extract_labels(rows, dialect, key, line_col="line")


def latest_answers(extracted: DataFrame, run_cols: Sequence[str] = RUN_COLS, extra: Sequence[str] = ()) -> DataFrame:
    """Last answer per (run, video); bad lines are left out."""
    ok = extracted.where(F.col("line_status") == F.lit("ok"))
    return last_wins(ok, [*run_cols, "video"], "line_order", ["raw_value", "parse_status", *extra])


def latest_labels(extracted: DataFrame, run_cols: Sequence[str] = RUN_COLS, run_values: Sequence[str] = ()) -> DataFrame:
    """J1 for labels: (run, video, number, parse_status) of the last answer, at
    fixed width all the way. ``run_values`` are columns that a run determines."""
    ok = extracted.where(F.col("line_status") == F.lit("ok"))
    known = F.array(*[F.lit(s) for s in STATUSES])
    keys = [*run_cols, *run_values, "video"]
    code = F.array_position(known, F.col("parse_status")).cast("byte")
    rows = ok.select(*keys, "line_order", answer_number(F.col("raw_value")).alias("number"), code.alias("_code"))
    last = last_wins(rows, keys, "line_order", ["number", "_code"])
    return last.select(*keys, "number", F.element_at(known, F.col("_code").cast("int")).alias("parse_status"), "n_versions")


def evaluate_lines(
    lines: DataFrame,
    truth: DataFrame,
    dialect: str = "greedy",
    key: str = "result",
    policy: str = "wrong",
    run_cols: Sequence[str] = RUN_COLS,
    coerce: bool = True,
) -> DataFrame:
    """Scored rows for logs that share one dialect (one prompting method)."""
    latest = latest_labels(extract_from_lines(lines, dialect, key), run_cols)
    return score_rows(attach_truth(latest, truth), policy, coerce=coerce)


MAX_RUNS = 10_000


def extract_grid(lines: DataFrame, matrix: DataFrame | None = None, unknown: str = "raise") -> DataFrame:
    """Lines of many runs -> (run, video, raw_value, ...), each run read by its
    own scan, dialect and key from ``matrix``.

    The matrix is collected (at most ``MAX_RUNS`` rows, checked) so the scans,
    dialects and keys that occur become literal branches, and is then
    broadcast. Lines of runs that it doesn't list fail the job
    (``unknown='raise'``) or come out with ``line_status = 'unknown_run'``
    (``unknown='report'``); see :func:`unknown_runs`.
    """
    if unknown not in ("raise", "report"):
        raise ValueError(f"unknown={unknown!r}")
    spark = lines.sparkSession
    known = (run_matrix(spark) if matrix is None else matrix).select("model", "method", "dialect", "coerce", "policy", "answer_key", "scan")
    rows = known.limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"a run matrix of more than {MAX_RUNS} rows")
    known = spark.createDataFrame(rows, known.schema).withColumn("_known", F.lit(True))
    joined = lines.join(F.broadcast(known), ["model", "method"], "left")
    if unknown == "raise":
        told = F.raise_error(F.concat(F.lit("run not in the matrix: "), F.coalesce("model", F.lit("null")), F.lit(" / "), F.coalesce("method", F.lit("null"))))
        # Part of the scan column, which every later step needs.
        joined = joined.withColumn("scan", F.when(F.col("_known"), F.col("scan")).otherwise(told.cast("string")))
        parsed = parse_lines(joined.drop("_known"), F.col("scan"), sorted({r["scan"] for r in rows}))
    else:
        joined = joined.withColumn("scan", F.coalesce("scan", F.lit("raw")))
        parsed = parse_lines(joined, F.col("scan"), sorted({r["scan"] for r in rows} | {"raw"}))
        parsed = parsed.withColumn("line_status", F.when(F.col("_known"), F.col("line_status")).otherwise(F.lit("unknown_run"))).drop("_known")
    combos = sorted({(r["dialect"], r["answer_key"]) for r in rows})
    return extract_labels(parsed, F.col("dialect"), F.col("answer_key"), combos=combos, line_col="line")


def unknown_runs(lines: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """(model, method, lines) of the runs that the matrix doesn't list."""
    known = run_matrix(lines.sparkSession) if matrix is None else matrix
    seen = lines.groupBy("model", "method").agg(F.count(F.lit(1)).alias("lines"))
    return seen.join(known.select("model", "method"), ["model", "method"], "left_anti")


def evaluate_grid(lines: DataFrame, truth: DataFrame, matrix: DataFrame | None = None, unknown: str = "raise") -> DataFrame:
    """Scored rows of every (model, method) run in one job."""
    extracted = extract_grid(lines, matrix, unknown)
    latest = latest_labels(extracted, RUN_COLS, run_values=["policy", "coerce"])
    return score_rows(attach_truth(latest, truth), F.col("policy"), coerce=F.col("coerce"))
