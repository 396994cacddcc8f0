"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables (or data Spark derives from them); nothing is sampled or cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.config import CATEGORIES, METHOD_KEYS, RUN_MATRIX, default_scan, run_matrix
from verdikt.functions.dialects import extract_labels, with_chain_record
from verdikt.functions.labels import label_int, label_number
from verdikt.operators import media_plan as MP
from verdikt.operators import profile as NP
from verdikt.operators.dedup import last_wins
from verdikt.operators.inference import clean_video_name, latency_stats, replay, score_batches
from verdikt.operators.metrics import chain_shift, majority_vote, parse_quality, sliced_metrics
from verdikt.operators.prompts import TEMPLATE_ROWS, frame_parts, request_json, rules_text, second_pass_prompt, taxonomy_text, template_rows, with_prompt
from verdikt.operators.scoring import scored_output
from verdikt.plans import oracle as O
from verdikt.plans.evaluate import evaluate_grid, evaluate_lines, extract_from_lines, latest_labels
from verdikt.plans.chain import first_pass_from_lines, two_pass_chain
from verdikt.plans.fixtures import (
    FLAGSHIP_RUNS,
    TimedScorer,
    FRAME_CHARS,
    PASS_SHIFT,
    derived_answers,
    derived_chain_records,
    derived_log_lines,
    derived_truth,
    document_frames,
    first_pass_scorer,
    keyword_scorer,
    second_pass_scorer,
    table,
    write_media_files,
)
from verdikt.session import checkpoint_path
from verdikt.sources import sinks
from verdikt.sources.frames import PART, SEGMENT, request_parts, store_frames, stride_choice
from verdikt.sources.media import walk_media
from verdikt.sources.logs import parse_raw_lines, read_keyed_log, read_lines, run_from_path
from verdikt.sources.tables import spread
from verdikt.sources.truth import load_rules, read_ground_truth, read_trim_list
from verdikt.streaming.ingest import ingest, quality_table, running_metrics, write_log_files
from verdikt.streaming.running import ingest_running, metrics_after

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# --- flagship: sliced metrics from a raw response log -----------------------


def flagship_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived_log_lines(derived_answers(spark, sf_dir, FLAGSHIP_RUNS))
    return evaluate_lines(lines, derived_truth(spark, sf_dir), dialect="greedy", key="result", policy="wrong")


_FLAGSHIP_BASE_SQL = (
    "WITH "
    + O.truth_cte()
    + ",\n"
    + O.answers_cte(FLAGSHIP_RUNS)
    + ",\n"
    + O.latest_cte(O.dialect_value_sql("greedy", "result"))
    + ",\n"
    + O.scored_cte()
)


@register("sliced_metrics", _FLAGSHIP_BASE_SQL + ",\n" + O.sliced_metrics_sql("scored"))
def q_sliced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_metrics(flagship_scored(spark, sf_dir))


@register(
    "scored_rows",
    _FLAGSHIP_BASE_SQL
    + "\nSELECT model, method, video_name, CAST(predicted_label AS INTEGER) AS predicted_label, title, category, label,"
    " true_label, CAST(predicted_label = true_label AS INTEGER) AS accuracy FROM scored",
)
def q_scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_output(flagship_scored(spark, sf_dir))


# --- W2 leaderboard: every (model, method) run in one job -------------------


GRID_RUNS = [(m, me, METHOD_KEYS[me]) for (m, me, _, _, _) in RUN_MATRIX]


def grid_sql(runs) -> str:
    """CTEs up to ``scored`` for runs read by their own scan, dialect, policy
    and coercion: one CASE over (model, method) each."""

    def pick(value, default: str) -> str:
        whens = [f"WHEN {{t}}model = '{r[0]}' AND {{t}}method = '{r[1]}' THEN {v}" for r in runs if (v := value(r)) != default]
        return "CASE " + " ".join(whens) + f" ELSE {default} END" if whens else default

    scan = pick(lambda r: f"'{default_scan(r[0], r[1], r[2])}'", "'keyed'").format(t="")
    value = "CASE " + " ".join(
        f"WHEN model = '{m}' AND method = '{me}' THEN "
        + O.dialect_value_sql(d, METHOD_KEYS[me], text="coalesce(response, '')" if d == "strict" else "response")
        for m, me, d, _, _ in runs
    ) + " END"
    policy = pick(lambda r: f"'{r[4]}'", "'wrong'").format(t="l.")
    coerce = pick(lambda r: "TRUE" if r[3] else "FALSE", "FALSE").format(t="l.")
    return (
        "WITH " + O.truth_cte() + ",\n" + O.answers_cte([(m, me, METHOD_KEYS[me]) for m, me, *_ in runs], with_cut=True) + ",\n"
        f"scans AS (SELECT *, {scan} AS scan FROM answers),\n"
        # Cut lines are bad unless they are never decoded.
        "kept AS (SELECT * FROM scans WHERE scan = 'raw' OR attempt <> 2 AND (scan <> 'idpred_drop' OR coalesce(response, '') <> '')),\n"
        + O.latest_cte(value, source="kept") + ",\n" + O.scored_cte(policy_sql=policy, coerce_sql=coerce) + ",\n"
    )


@register("leaderboard", grid_sql(RUN_MATRIX) + O.sliced_metrics_sql("scored"))
def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived_log_lines(derived_answers(spark, sf_dir, GRID_RUNS, with_cut=True))
    return sliced_metrics(evaluate_grid(lines, derived_truth(spark, sf_dir)))


# --- one query per extraction dialect (E1-E8) --------------------------------

DIALECT_QUERIES = {
    "extract_greedy": ("greedy", "zeroshot"),
    "extract_greedy_nostrip": ("greedy_raw", "zeroshot"),
    "extract_regex": ("regex", "cot"),
    "extract_flat": ("flat", "chain"),
    "extract_repair": ("repair", "chain"),
    "extract_rawline": ("rawline", "icl"),
    "extract_strict": ("strict", "zeroshot"),
    "extract_loose": ("loose", "fewshot"),
}


def _dialect_runs(method: str):
    k = METHOD_KEYS[method]
    return [("model_0", method, k), ("model_1", method, k)]


def _make_dialect_query(dialect: str, method: str):
    runs = _dialect_runs(method)
    key = METHOD_KEYS[method]

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        ans = derived_answers(spark, sf_dir, runs)
        if dialect == "rawline":
            # S3: the log line is not decoded; its video key comes from a
            # regex on the raw line, the label from the raw-line dialect.
            ans = ans.withColumn("line", F.to_json(F.create_map(F.col("video"), F.col("response"))))
            ans = parse_raw_lines(ans.select("model", "method", "attempt", "line"))
            ex = extract_labels(ans, dialect, key, line_col="line")
        else:
            ex = extract_labels(ans, dialect, key)
        return ex.select(
            "model", "method", "video", "attempt",
            label_int(label_number(F.col("raw_value"))).alias("label"),
            (F.col("parse_status") == "ok").alias("parsed"),
        )

    sql = (
        "WITH " + O.answers_cte(runs) + ",\n"
        + f"ex AS (SELECT model, method, video, attempt, {O.dialect_value_sql(dialect, key)} AS raw_value,"
        + ((f" response IS NOT NULL AND {O.regex_value_sql('response', dialect, key)} IS NOT NULL" if dialect in ("regex", "loose") else
           f" {O.regex_value_sql(O.raw_line_sql('video', 'response'), dialect, key)} IS NOT NULL" if dialect == "rawline" else
           " TRUE") + " AS rx_ok FROM answers)\n")
        + f"SELECT model, method, video, attempt, {O.int_sql(O.number_sql('raw_value'))} AS label, "
        + ("coalesce(rx_ok, FALSE) AS parsed" if dialect in ("regex", "loose", "rawline") else "raw_value IS NOT NULL AS parsed")
        + " FROM ex"
    )
    return build, sql


for _name, (_d, _m) in DIALECT_QUERIES.items():
    _b, _s = _make_dialect_query(_d, _m)
    register(_name, _s)(_b)


# --- J7 + J9: invalid answers read as normal --------------------------------

NEG_RUNS = [("GPT", "chain", "updated_anomaly"), ("GPTmini", "chain", "updated_anomaly")]


@register(
    "negative_policy",
    "WITH " + O.truth_cte() + ",\n" + O.answers_cte(NEG_RUNS) + ",\n"
    + O.latest_cte(O.dialect_value_sql("flat", "updated_anomaly")) + ",\n"
    + O.scored_cte(policy_sql="'negative'") + ",\n" + O.sliced_metrics_sql("scored"),
)
def q_negative_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived_log_lines(derived_answers(spark, sf_dir, NEG_RUNS))
    scored = evaluate_lines(lines, derived_truth(spark, sf_dir), dialect="flat", key="updated_anomaly", policy="negative")
    return sliced_metrics(scored)


# --- A10 majority vote over the three flagship runs -------------------------


@register(
    "majority_vote",
    _FLAGSHIP_BASE_SQL
    + """,
votes AS (
  SELECT method, video_name, count(*) AS voters, count(*) FILTER (WHERE predicted_label = 1) AS votes_abnormal,
         min(true_label) AS true_label
  FROM scored GROUP BY method, video_name)
SELECT method, video_name, voters, votes_abnormal, true_label,
       CASE WHEN votes_abnormal * 2 > voters THEN 1 WHEN votes_abnormal * 2 < voters THEN 0 ELSE 1 END AS vote,
       CAST((CASE WHEN votes_abnormal * 2 > voters THEN 1 WHEN votes_abnormal * 2 < voters THEN 0 ELSE 1 END) = true_label AS INTEGER) AS accuracy
FROM votes""",
)
def q_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return majority_vote(flagship_scored(spark, sf_dir))


# --- A11 parse quality --------------------------------------------------------

_PQ_STATUS_SQL = """CASE WHEN response IS NULL THEN 'null_response'
      WHEN regexp_extract(response, '(?s)\\{.*\\}', 0) = '' THEN 'no_block'
      WHEN NOT json_valid(regexp_replace(regexp_extract(response, '(?s)\\{.*\\}', 0), '//[^\\n]*', '', 'g')) THEN 'bad_json'
      WHEN raw_value IS NULL THEN 'no_value'
      WHEN """ + O.int_sql(O.number_sql("raw_value")) + """ IS NULL THEN 'bad_value'
      ELSE 'ok' END"""


@register(
    "parse_quality",
    "WITH " + O.answers_cte(FLAGSHIP_RUNS, with_cut=True) + ",\n"
    "extracted AS (SELECT *, " + O.dialect_value_sql("greedy", "result") + " AS raw_value FROM answers)\n"
    "SELECT model, method, CASE WHEN attempt = 2 THEN 'bad_line' ELSE " + _PQ_STATUS_SQL + " END AS parse_status, count(*) AS n"
    " FROM extracted GROUP BY ALL",
)
def q_parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line counts: bad lines and answers that later ones replace too."""
    lines = derived_log_lines(derived_answers(spark, sf_dir, FLAGSHIP_RUNS, with_cut=True))
    rows = extract_from_lines(lines, "greedy", "result")
    valid = label_int(label_number(F.col("raw_value"))).isNotNull()
    status = F.when(F.col("line_status") != "ok", F.col("line_status")).when((F.col("parse_status") == "ok") & ~valid, F.lit("bad_value"))
    return parse_quality(rows.withColumn("parse_status", status.otherwise(F.col("parse_status"))))


# --- E9 + P5 + P6: chain records and the second-pass prompt -------------------


CHAIN_MODELS = [m for m, me, *_ in RUN_MATRIX if me == "chain"]
CHAIN_RUNS = [(m, "chain", "anomaly") for m in CHAIN_MODELS]

# The rules file of the second pass is written from a table: one rule a region.
_RULE_SQL = "'Rule ' || CAST(r_regionkey + 1 AS VARCHAR) || ': footage filed under ' || r_name || ' needs a second look.'"
_RULES_BLOCK_SQL = f"(SELECT string_agg({_RULE_SQL}, chr(10) ORDER BY r_regionkey) FROM region)"


def _rules_file(spark: SparkSession, sf_dir: str) -> list[str]:
    """Write the rules document and read it as a caller would."""
    rule = F.concat(F.lit("Rule "), (F.col("r_regionkey") + 1).cast("string"), F.lit(": footage filed under "), F.col("r_name"), F.lit(" needs a second look."))
    listed = table(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", rule.alias("rule")))).alias("x"))
    path = scratch(spark, "rules")
    listed.select(F.transform("x", lambda r: r["rule"]).alias("rules")).write.json(path)
    return load_rules(spark, path)


def _p6_sql(desc: str, reason: str, anomaly: str) -> str:
    from verdikt.operators.prompts import SECOND_PASS_PARTS

    a, b, c, d, e = (O._q(x) for x in SECOND_PASS_PARTS)
    x, y, z = (f"coalesce({v}, 'null')" for v in (desc, reason, anomaly))
    return f"{a} || {x} || {b} || {y} || {c} || {z} || {d} || {_RULES_BLOCK_SQL} || {e}"


_LAST_RECORDS_SQL = "last_records AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY model, method, video ORDER BY attempt DESC) = 1)"


def _first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + J1: the derived first-pass log, read from its lines, last answers only."""
    records = derived_chain_records(spark, sf_dir, CHAIN_RUNS)
    lines = records.selectExpr("model", "method", "to_json(map(video, response)) AS line", "named_struct('pass', attempt, 'seq', doc_id) AS line_order", "line_file", "line_at")
    return first_pass_from_lines(lines)


@register(
    "chain_record",
    "WITH " + O.chain_records_cte(CHAIN_RUNS) + ",\n" + _LAST_RECORDS_SQL + ",\n"
    "rec AS (SELECT model, method, video, " + O.chain_fields_sql() + " FROM last_records)\n"
    "SELECT model, method, video, video_description, reasoning, anomaly, parsed, "
    + _p6_sql("video_description", "reasoning", "anomaly") + " AS prompt FROM rec",
)
def q_chain_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = with_chain_record(_first_pass(spark, sf_dir), "response")
    r = F.col("record")
    return recs.select(
        "model", "method", "video",
        r.getField("video_description").alias("video_description"),
        r.getField("reasoning").alias("reasoning"),
        r.getField("anomaly").alias("anomaly"),
        r.getField("parsed").alias("parsed"),
        second_pass_prompt(r.getField("video_description"), r.getField("reasoning"), r.getField("anomaly"),
                           rules_text(_rules_file(spark, sf_dir))).alias("prompt"),
    )


# --- A9: how labels moved between the chain's two passes ---------------------

PASS2_RUNS = [(m, "chain", "updated_anomaly") for m in CHAIN_MODELS]


@register(
    "chain_shift",
    "WITH " + O.chain_records_cte(CHAIN_RUNS) + ",\n" + _LAST_RECORDS_SQL + ",\n"
    "p1 AS (SELECT model, video, " + O.int_sql(O.number_sql("raw_value")) + " AS label_1\n"
    "       FROM (SELECT model, video, " + O.dialect_value_sql("greedy", "anomaly") + " AS raw_value FROM last_records)),\n"
    + O.answers_cte(PASS2_RUNS).replace("r.run_idx * 17", "(r.run_idx + 5) * 17") + ",\n"
    + O.latest_cte(O.dialect_value_sql("greedy", "updated_anomaly")) + ",\n"
    "p2 AS (SELECT model, video, " + O.int_sql(O.number_sql("raw_value")) + " AS label_2 FROM latest)\n"
    "SELECT coalesce(p1.model, p2.model) AS model, label_1, label_2, count(*) AS n\n"
    "FROM p1 FULL OUTER JOIN p2 ON p1.model = p2.model AND p1.video = p2.video GROUP BY ALL",
)
def q_chain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first pass is read again for its label, so that an answer that
    # can't be read is no label instead of the record's default.
    p1 = extract_labels(_first_pass(spark, sf_dir), "greedy", "anomaly")
    p1 = p1.select("model", "video", label_int(label_number(F.col("raw_value"))).alias("label_1"))
    lines = derived_log_lines(derived_answers(spark, sf_dir, PASS2_RUNS, run_offset=5))
    latest = latest_labels(extract_from_lines(lines, "greedy", "updated_anomaly"))
    p2 = latest.select("model", "video", label_int(F.col("number")).alias("label_2"))
    return chain_shift(p1, p2, keys=("model", "video"))


# --- I2 + I4 + I8: the chain itself, with calls that fail and a rerun ------------


@register(
    "two_pass_chain",
    """SELECT 'chain-model' AS model, 'chain' AS method, 'vid_' || CAST(doc_id AS VARCHAR) || '.mp4' AS video,
  CAST(CASE WHEN doc_id % 21 = 3 THEN 1 ELSE length(coalesce(text, '')) % 2 END AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS error
FROM documents""",
)
def q_two_pass_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over every document: the first run's scorer fails for some
    videos, the rerun scores those again and fails for fewer; what never gets
    a first answer goes through the second pass with the default record."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cot = {(m, mo): t for m, mo, t in TEMPLATE_ROWS}["chain", "video"]
    req = d.select(
        F.lit("chain-model").alias("model"), F.lit("chain").alias("method"),
        F.concat(F.lit("vid_"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("video"),
        F.concat(F.lit(cot + "\n\n"), F.coalesce("text", F.lit(""))).alias("prompt"),
    )
    rules, name = _rules_file(spark, sf_dir), uuid.uuid4().hex
    two_pass_chain(req, first_pass_scorer(7), second_pass_scorer, name, rules)
    out = two_pass_chain(req, first_pass_scorer(21), second_pass_scorer, name, rules)
    out = extract_labels(out, "greedy", "updated_anomaly")
    return out.select("model", "method", "video", label_int(label_number(F.col("raw_value"))).alias("label"), "error")


# --- J1 last-wins on events ---------------------------------------------------


@register(
    "last_wins",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, "
    "arg_max(value, (ts, event_id)) AS value, count(*) AS n_versions FROM events GROUP BY user_id",
)
def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    ev = ev.withColumn("ord", F.struct("ts", "event_id"))
    return last_wins(ev, ["user_id"], "ord", ["event_id", "event_type", "value"])


# --- M5 missing media ------------------------------------------------------------


@register(
    "missing_media",
    "SELECT 'vid_' || CAST(d.doc_id AS VARCHAR) AS title, 'raw_video/vid_' || CAST(d.doc_id AS VARCHAR) || '.mp4' AS input_path,"
    " l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id",
)
def q_missing_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    vid = lambda c: F.concat(F.lit("vid_"), F.col(c).cast("string"))
    plan = table(spark, sf_dir, "documents").select(vid("doc_id").alias("title"))
    plan = plan.withColumn("input_path", F.concat(F.lit("raw_video/"), F.col("title"), F.lit(".mp4")))
    inventory = table(spark, sf_dir, "labels").select(vid("doc_id").alias("title"))
    return MP.media_status(plan, inventory)


@register(
    "present_media",
    "SELECT DISTINCT 'vid_' || CAST(d.doc_id AS VARCHAR) AS title FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def q_present_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 work list: planned videos that exist (semi join)."""
    return MP.present(*_planned_and_there(spark, sf_dir))


@register(
    "absent_media",
    "SELECT 'vid_' || CAST(doc_id AS VARCHAR) AS title FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def q_absent_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 report: planned videos that do not exist (anti join)."""
    return MP.missing(*_planned_and_there(spark, sf_dir))


def _planned_and_there(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    title = F.concat(F.lit("vid_"), F.col("doc_id").cast("string")).alias("title")
    return table(spark, sf_dir, "documents").select(title), table(spark, sf_dir, "labels").select(title)


@register(
    "media_inventory",
    """WITH f AS (
  SELECT s_suppkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'nation_' || s_nationkey || '/day ' || s_suppkey % 3 || '/' END AS folder
  FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0),
l AS (SELECT mode, folder || 'vid_' || n || '.mp4' AS rel_path, n AS length, 'vid_' || n AS title FROM f, (VALUES ('flat'), ('recursive')) m(mode)
      WHERE mode = 'recursive' OR folder = ''),
p AS (SELECT mode, 'vid_' || s_suppkey AS title FROM supplier, (VALUES ('flat'), ('recursive')) m(mode))
SELECT p.mode, p.title, l.rel_path, l.length, l.title IS NOT NULL AS found FROM p LEFT JOIN l ON p.mode = l.mode AND p.title = l.title""",
)
def q_media_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + S8 + M5: a media folder is written, listed flat and with all its
    folders (by tasks, contents unread), and held against the planned videos."""
    root = scratch(spark, "media")
    write_media_files(spark, sf_dir, root)
    plan = table(spark, sf_dir, "supplier").select(F.concat(F.lit("vid_"), F.col("s_suppkey").cast("string")).alias("title"))
    out = []
    for mode in ("flat", "recursive"):
        there = walk_media(spark, root, recursive=mode == "recursive").select(F.replace("name", F.lit(".mp4"), F.lit("")).alias("title"), "rel_path", "length")
        status = MP.media_status(plan, there.select("title"))
        out.append(status.join(there, "title", "left").select(F.lit(mode).alias("mode"), "title", "rel_path", "length", "found"))
    return out[0].unionByName(out[1])


# --- M1-M4 trim plan --------------------------------------------------------------


@register(
    "trim_plan",
    """WITH t AS (
  SELECT c_name AS title, CASE WHEN c_nationkey = 0 THEN NULL ELSE CAST(floor(c_acctbal / 100) AS DOUBLE) END AS time,
         CAST(60 + c_custkey % 60 AS DOUBLE) AS duration FROM customer)
SELECT title, time, duration,
       CASE WHEN time > 0 THEN 'end' WHEN time < 0 THEN 'begin' ELSE 'none' END AS trim_kind,
       CAST(CASE WHEN time < 0 THEN -time ELSE 0.0 END AS DOUBLE) AS start_s,
       CAST(CASE WHEN time > 0 THEN duration - time ELSE duration END AS DOUBLE) AS end_s,
       (CASE WHEN time > 0 THEN duration - time ELSE duration END) > (CASE WHEN time < 0 THEN -time ELSE 0.0 END) AS valid,
       'raw_video/' || title || '.mp4' AS input_path, 'downloads/' || title || '.mp4' AS output_path
FROM t WHERE time IS NOT NULL""",
)
def q_trim_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    trims = c.select(
        F.col("c_name").alias("title"),
        F.when(F.col("c_nationkey") == 0, F.lit(None)).otherwise(F.floor(F.col("c_acctbal") / 100)).cast("double").alias("time"),
        (F.lit(60) + F.col("c_custkey") % 60).cast("double").alias("duration"),
    )
    return MP.trim_plan(trims)


# --- M6 + M10 uniform frame sample ---------------------------------------------


@register(
    "uniform_sample",
    """WITH v AS (
  SELECT 'vid_' || CAST(doc_id AS VARCHAR) AS video, n_chars AS n_frames, greatest(n_chars // 20, 1) AS interval FROM documents),
s AS (
  SELECT video, n_frames, interval, unnest(generate_series(0, least(n_frames - 1, interval * 19), interval)) AS frame_idx
  FROM v WHERE n_frames > 0)
SELECT video, n_frames, CAST(interval AS BIGINT) AS interval, CAST(frame_idx // interval AS INTEGER) AS sample_rank,
       CAST(frame_idx AS BIGINT) AS frame_idx, (frame_idx // interval) % 50 = 0 AS in_request FROM s""",
)
def q_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("vid_"), F.col("doc_id").cast("string")).alias("video"), F.col("n_chars").alias("n_frames")
    )
    return MP.uniform_sample(d)


# --- M7 + M8 + A13 payload cap and resize plan --------------------------------

PAYLOAD_CAP_TEST = 1024

_FRAMES_SQL = f"""v AS (
  SELECT 'vid_' || CAST(doc_id AS VARCHAR) AS video, text, CAST(ceil(length(text) / {FRAME_CHARS}.0) AS BIGINT) AS n_frames FROM documents),
f AS (SELECT video, n_frames, text, unnest(range(n_frames)) AS frame_idx FROM v),
frames AS (SELECT video, n_frames, frame_idx, encode(substring(text, frame_idx * {FRAME_CHARS} + 1, {FRAME_CHARS})) AS payload FROM f),
s AS (SELECT *, greatest(n_frames // 20, 1) AS iv FROM frames),
sampled AS (SELECT video, frame_idx // iv AS sample_rank, payload FROM s WHERE frame_idx % iv = 0 AND frame_idx < iv * 20)"""


@register(
    "payload_cap",
    f"""WITH {_FRAMES_SQL},
b AS (SELECT video, sample_rank, CAST(4 * ceil(octet_length(payload) / 3) AS BIGINT) AS payload_bytes FROM sampled),
w AS (
  SELECT *, coalesce(sum(payload_bytes) OVER (PARTITION BY video ORDER BY sample_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b),
k AS (SELECT video, count(*) AS frames_kept, CAST(sum(payload_bytes) AS BIGINT) AS total_bytes FROM w
      WHERE before <= {PAYLOAD_CAP_TEST} AND sample_rank < 20 GROUP BY video)
SELECT video, frames_kept, total_bytes, 1280 AS width, 720 AS height, total_bytes > {PAYLOAD_CAP_TEST} AS needs_resize,
       CASE WHEN total_bytes > {PAYLOAD_CAP_TEST} THEN sqrt({PAYLOAD_CAP_TEST}.0 / CAST(total_bytes AS DOUBLE)) ELSE 1.0 END AS factor,
       CAST(floor(1280 * CASE WHEN total_bytes > {PAYLOAD_CAP_TEST} THEN sqrt({PAYLOAD_CAP_TEST}.0 / CAST(total_bytes AS DOUBLE)) ELSE 1.0 END) AS INTEGER) AS new_width,
       CAST(floor(720 * CASE WHEN total_bytes > {PAYLOAD_CAP_TEST} THEN sqrt({PAYLOAD_CAP_TEST}.0 / CAST(total_bytes AS DOUBLE)) ELSE 1.0 END) AS INTEGER) AS new_height
FROM k""",
)
def q_payload_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, inventory = document_frames(spark, sf_dir)
    sized = frames.select("video", "frame_idx", MP.base64_size(F.octet_length("payload")).alias("payload_bytes"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    capped = MP.payload_cap(MP.sample_frames(sized, inventory), cap=PAYLOAD_CAP_TEST)
    return MP.resize_plan(capped, cap=PAYLOAD_CAP_TEST)


# --- P1-P7 request packing -----------------------------------------------------

REQUEST_METHODS = ["zeroshot", "fewshot", "cot", "icl"]
SYSTEM_TEXT = "You answer in JSON."

# The category guide of the in-context prompt, from the ground truth: how many
# clips of a category and kind there are, and the first of them.
_GUIDE_ROWS_SQL = (
    "guide_rows AS (SELECT x.category, CASE true_label WHEN 1 THEN 'abnormal' ELSE 'normal' END AS kind,\n"
    "  CAST(count(*) AS VARCHAR) || ' clips such as ' || min(title) AS rule\n"
    "  FROM truth t JOIN (SELECT unnest([" + ", ".join(O._q(c) for c in CATEGORIES) + "]) AS category) x ON contains(t.category, x.category)\n"
    "  GROUP BY ALL),\n"
    "guide AS (SELECT string_agg(category || ': ' || parts, chr(10) ORDER BY category) AS guide FROM (\n"
    "  SELECT category, string_agg(kind || ' - ' || rule, '; ' ORDER BY kind) AS parts FROM guide_rows GROUP BY category))"
)


def _guide(spark: SparkSession, sf_dir: str) -> str:
    t = derived_truth(spark, sf_dir)
    names = F.filter(F.array(*[F.lit(c) for c in CATEGORIES]), lambda c: F.contains(F.col("category"), c))
    rows = t.select(F.explode(names).alias("category"), F.when(F.col("true_label") == 1, "abnormal").otherwise("normal").alias("kind"), "title")
    rows = rows.groupBy("category", "kind").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" clips such as "), F.min("title")).alias("rule"))
    return taxonomy_text(rows)


def _prompt_sql(method: str, modality: str) -> str:
    whens = []
    for m, mo, t in template_rows("\0"):
        head, _, tail = t.partition("\0")
        text = O._q(head) + (f" || (SELECT guide FROM guide) || {O._q(tail)}" if "\0" in t else "")
        whens.append(f"WHEN {method} = '{m}' AND {modality} = '{mo}' THEN {text}")
    return "CASE " + " ".join(whens) + " END"


def _method_sql(doc: str) -> str:
    return f"CASE {doc} % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(REQUEST_METHODS)) + " END"


def _method(doc) -> F.Column:
    return F.element_at(F.array(*[F.lit(m) for m in REQUEST_METHODS]), (doc % 4 + 1).cast("int"))


def _doc_number():
    return F.substring("video", 5, 20).cast("long")


@register(
    "prompts",
    "WITH " + O.truth_cte() + ",\n" + _GUIDE_ROWS_SQL + "\n"
    "SELECT 'vid_' || CAST(doc_id AS VARCHAR) AS video, method, modality, " + _prompt_sql("method", "modality") + " AS prompt\n"
    "FROM documents, (VALUES ('zeroshot'), ('fewshot'), ('cot'), ('icl'), ('chain')) a(method), (VALUES ('video'), ('frames')) b(modality)",
)
def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every method and modality for every video."""
    runs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(mo).alias("modality")) for m in [*REQUEST_METHODS, "chain"] for mo in ("video", "frames")])
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("vid_"), F.col("doc_id").cast("string")).alias("video"), F.inline(runs))
    return with_prompt(d, guide=_guide(spark, sf_dir))


def _request_sql(parts: str, system: str | None = None, head: str = "vendor-model") -> str:
    first = "" if system is None else O._q('{"role":"system","content":"' + system + '"},') + " || "
    return (
        O._q('{"model":"' + head + '","max_tokens":4096,"temperature":0.0,"messages":[') + " || " + first
        + O._q('{"role":"user","content":[') + " || " + parts + " || ']}]}'"
    )


_TEXT_SQL = "CAST(to_json({p}) AS VARCHAR)"


@register(
    "request_uri",
    "WITH " + O.truth_cte() + ",\n" + _GUIDE_ROWS_SQL + ",\n"
    "r AS (SELECT 'vid_' || CAST(doc_id AS VARCHAR) AS video, " + _method_sql("doc_id") + " AS method FROM documents),\n"
    "q AS (SELECT *, " + _prompt_sql("method", "'video'") + " AS prompt FROM r)\n"
    "SELECT video, method, " + _request_sql(
        "'{\"type\":\"text\",\"text\":' || " + _TEXT_SQL.format(p="prompt") + " || ',\"uri\":null},{\"type\":\"file\",\"text\":null,\"uri\":\"media/' || video || '.mp4\"}'"
    ) + " AS request FROM q",
)
def q_request_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 for video inputs: the text and the video's address."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("vid_"), F.col("doc_id").cast("string")).alias("video"), _method(F.col("doc_id")).alias("method"))
    d = with_prompt(d.withColumn("modality", F.lit("video")), guide=_guide(spark, sf_dir))
    uri = F.concat(F.lit("media/"), F.col("video"), F.lit(".mp4"))
    return d.select("video", "method", request_json(F.lit("vendor-model"), F.col("prompt"), uri, shape="uri").alias("request"))


def _packed_requests(spark: SparkSession, sf_dir: str, frames: DataFrame, shape: str, system: str | None) -> DataFrame:
    """Requests of chosen frames (video, sample_rank, payload): payloads are
    encoded here, after the choice."""
    chosen = frames.select("video", "sample_rank", MP.base64_text(F.col("payload")).alias("payload"))
    packed = frame_parts(chosen, ["video"]).withColumn("method", _method(_doc_number())).withColumn("modality", F.lit("frames"))
    packed = with_prompt(packed, guide=_guide(spark, sf_dir))
    request = request_json(F.lit("vendor-model"), F.col("prompt"), F.col("frames"), shape=shape, system=None if system is None else F.lit(system))
    return packed.select("video", "method", "n_frames", request.alias("request"))


_IMAGES_SQL = (
    "'{\"type\":\"text\",\"text\":' || " + _TEXT_SQL.format(p="prompt") + " || ',\"data\":null}' || string_agg("
    "',{\"type\":\"image\",\"text\":null,\"data\":\"' || to_base64(payload) || '\"}', '' ORDER BY sample_rank)"
)
_BLOCKS_SQL = (
    "string_agg('{\"type\":\"image\",\"text\":null,\"source\":{\"type\":\"base64\",\"media_type\":\"image/jpeg\",\"data\":\"'"
    " || to_base64(payload) || '\"}},', '' ORDER BY sample_rank) || '{\"type\":\"text\",\"text\":' || " + _TEXT_SQL.format(p="prompt") + " || ',\"source\":null}'"
)


def _packed_sql(source: str, parts: str, system: str | None = None, numbers: str = "count(*) AS n_frames", by: str = "") -> str:
    return (
        "WITH " + O.truth_cte() + ",\n" + _GUIDE_ROWS_SQL + ",\n" + _FRAMES_SQL + f",\nc AS ({source}),\n"
        "m AS (SELECT *, " + _method_sql("CAST(substring(video, 5) AS BIGINT)") + " AS method FROM c),\n"
        "q AS (SELECT *, " + _prompt_sql("method", "'frames'") + " AS prompt FROM m)\n"
        f"SELECT video, method, {numbers}, " + _request_sql(parts, system) + f" AS request FROM q GROUP BY video, method, prompt{by}"
    )


@register("request_pack", _packed_sql("SELECT video, frame_idx AS sample_rank, payload FROM frames WHERE frame_idx % 50 = 0", _IMAGES_SQL))
def q_request_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + M10 + P7: all frames kept, every 50th goes into the request (the
    stride comes before frames are gathered and encoded)."""
    frames, _ = document_frames(spark, sf_dir)
    return _packed_requests(spark, sf_dir, MP.request_stride(MP.keep_all_frames(frames)), "images", None)


@register("request_blocks", _packed_sql("SELECT * FROM sampled", _BLOCKS_SQL, SYSTEM_TEXT))
def q_request_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + M11 + P7: 20 sampled frames as base64 blocks, with a system role.
    Frames are chosen without their payloads, which are joined back and encoded
    for the chosen ones only."""
    frames, inventory = document_frames(spark, sf_dir)
    chosen = MP.sample_frames(frames.select("video", "frame_idx"), inventory).select("video", "frame_idx", "sample_rank")
    return _packed_requests(spark, sf_dir, frames.join(chosen, ["video", "frame_idx"]), "blocks", SYSTEM_TEXT)


@register(
    "request_parts",
    _packed_sql(
        "SELECT video, n_frames AS n, frame_idx, frame_idx // 50 AS sample_rank, payload FROM frames WHERE frame_idx % 50 = 0", _IMAGES_SQL,
        numbers="min(sample_rank) AS first_rank, count(*) AS n_frames, CAST(ceil(max(n) / 50.0) AS BIGINT) AS n_request",
        by=f", frame_idx // {SEGMENT}, sample_rank // {PART}",
    ),
)
def q_request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + M10 + P7 for videos of any length: frames stored by video and
    segment, every 50th in numbered parts, without a payload in a shuffle."""
    frames, inventory = document_frames(spark, sf_dir)
    parts = request_parts(store_frames(frames, scratch(spark, "frames")), stride_choice(inventory))
    parts = parts.withColumn("method", _method(_doc_number())).withColumn("modality", F.lit("frames"))
    parts = with_prompt(parts, guide=_guide(spark, sf_dir))
    images = F.transform("frames", MP.base64_text)
    return parts.select("video", "method", "first_rank", "n_frames", "n_request", request_json(F.lit("vendor-model"), F.col("prompt"), images).alias("request"))


# --- I6 latency statistics --------------------------------------------------------


_CLEAN_SQL = "replace(regexp_replace('runs/' || event_type || '/vid_' || CAST(event_id AS VARCHAR) || '.mp4', '^.*/', ''), '.mp4', '')"


@register(
    "latency_stats",
    f"""WITH r AS (
  SELECT event_type, value, CAST(floor(value / CAST(0.001 AS DOUBLE)) AS BIGINT) AS step, {_CLEAN_SQL} AS name,
         row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
         count(value) OVER (PARTITION BY event_type) AS cnt
  FROM events WHERE value IS NOT NULL)
SELECT event_type AS model, count(value) AS n, round(avg(value), 6) AS avg_s,
       round(max(CASE WHEN rn = greatest(ceil(CAST(0.5 AS DOUBLE) * cnt), 1) THEN step END) * CAST(0.001 AS DOUBLE), 9) AS p50_s,
       round(max(CASE WHEN rn = greatest(ceil(CAST(0.9 AS DOUBLE) * cnt), 1) THEN step END) * CAST(0.001 AS DOUBLE), 9) AS p90_s,
       max(value) AS max_s, min(name) AS first_name
FROM r GROUP BY event_type""",
)
def q_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("runs/"), F.col("event_type"), F.lit("/vid_"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("video"),
        F.col("value").alias("latency_s"),
    )
    stats = latency_stats(ev, ["model"], extra=[F.min(clean_video_name("video"))])
    return stats.withColumn("first_name", F.col("_x0.low")).drop("_x0")


# --- N1-N4 dataset statistics ------------------------------------------------------


@register(
    "category_distribution",
    "WITH " + O.truth_cte() + ",\n"
    "c AS (SELECT unnest(list_filter(" + "[" + ", ".join(O._q(x) for x in CATEGORIES)
    + "], lambda x: coalesce(contains(category, x), FALSE))) AS category, label FROM truth)\n"
    "SELECT category, label, count(*) AS n FROM c GROUP BY ALL",
)
def q_category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NP.label_by_category(derived_truth(spark, sf_dir))


@register(
    "duration_histogram",
    """SELECT CAST(least(greatest(floor(value / 10.0), 0), 9) AS INTEGER) AS bucket, count(*) AS n,
       count(*) FILTER (WHERE value < 80.0) AS n_short, min(value) AS min_value, max(value) AS max_value
FROM events WHERE value IS NOT NULL GROUP BY ALL""",
)
def q_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NP.duration_histogram(table(spark, sf_dir, "events").select("value"), "value")


@register(
    "word_counts",
    """WITH w AS (SELECT lang, CAST(coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS BIGINT) AS words FROM documents)
SELECT lang, count(*) AS n, CAST(sum(words) AS BIGINT) AS total_words, min(words) AS min_words, max(words) AS max_words,
       CAST(quantile_cont(words, 0.5) AS DOUBLE) AS median_words FROM w GROUP BY lang""",
)
def q_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    return NP.word_stats(d, "text", ["lang"])


@register("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def q_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NP.source_counts(table(spark, sf_dir, "documents").select("source"))


# --- I7 replay: requests answered from the stored log -------------------------------


@register(
    "replay_score",
    "WITH " + O.answers_cte(FLAGSHIP_RUNS) + ",\n"
    + O.latest_cte(O.dialect_value_sql("greedy", "result")) + ",\n"
    "req AS (SELECT r.model, r.method, v.video FROM (SELECT 'vid_' || CAST(doc_id AS VARCHAR) || '.mp4' AS video FROM documents\n"
    "        UNION ALL SELECT 'page_' || CAST(page_id AS VARCHAR) || '.mp4' FROM pages) v CROSS JOIN "
    + O.runs_values(FLAGSHIP_RUNS) + "),\n"
    "j AS (SELECT req.*, l.video IS NOT NULL AS answered, " + O.int_sql(O.number_sql("l.raw_value")) + " AS label\n"
    "      FROM req LEFT JOIN latest l ON req.model = l.model AND req.method = l.method AND req.video = l.video)\n"
    "SELECT model, method, count(*) AS requests, count(*) FILTER (WHERE answered) AS answered,\n"
    "       count(*) FILTER (WHERE NOT answered) AS pending, count(label) AS valid FROM j GROUP BY ALL",
)
def q_replay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived_log_lines(derived_answers(spark, sf_dir, FLAGSHIP_RUNS))
    latest = latest_labels(extract_from_lines(lines, "greedy", "result"))
    vids = table(spark, sf_dir, "documents").select(F.concat(F.lit("vid_"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("video"))
    vids = vids.unionByName(
        table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".mp4")).alias("video"))
    )
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(me).alias("method")) for m, me, _ in FLAGSHIP_RUNS])
    req = vids.select("video", F.inline(runs))
    r = replay(req, latest, value_cols=("number",))
    r = r.withColumn("label", label_int(F.col("number")))
    return r.groupBy("model", "method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("answered")).alias("answered"),
        F.count_if(~F.col("answered")).alias("pending"),
        F.count("label").alias("valid"),
    )


# --- I1-I5 batched scoring with an offline scorer -------------------------------------

SCORER_WORDS = ["the", "une", "und"]


@register(
    "batched_score",
    "SELECT 'keyword' AS model, 'zeroshot' AS method, 'vid_' || CAST(doc_id AS VARCHAR) || '.mp4' AS video,\n"
    "  CASE WHEN text IS NULL THEN NULL ELSE '{\"result\": ' || CASE WHEN ("
    + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in SCORER_WORDS)
    + ") >= 3 THEN '1' ELSE '0' END || '}' END AS response, CAST(NULL AS VARCHAR) AS error FROM documents",
)
def q_batched_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    req = d.select(
        F.lit("keyword").alias("model"), F.lit("zeroshot").alias("method"),
        F.concat(F.lit("vid_"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("video"), F.col("text").alias("prompt"),
    )
    out = score_batches(req, keyword_scorer(SCORER_WORDS, threshold=3), batch_size=64)
    return out.select("model", "method", "video", "response", "error")


# Every seventh video's call fails, whatever batch it is in.
_FAILS = "doc_id % 7 = 3"


@register(
    "score_policies",
    f"""WITH a AS (
  SELECT policy, {_FAILS} AS failed,
         CASE WHEN NOT {_FAILS} THEN length(coalesce(text, '')) % 2 END AS label
  FROM documents, (VALUES ('null'), ('text')) p(policy))
SELECT policy, count(*) AS requests, count(*) FILTER (WHERE failed) AS errors,
       count(*) FILTER (WHERE NOT failed OR policy = 'text') AS responses, count(label) AS labels, CAST(sum(label) AS BIGINT) AS abnormal
FROM a GROUP BY policy
UNION ALL SELECT 'raise', count(*), count(*) FILTER (WHERE {_FAILS}), 0, 0, NULL FROM documents""",
)
def q_score_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 + I4: batches of ten with calls that fail, under each policy. Error
    texts are answers that E1 finds no label in; under ``raise`` the job fails
    and leaves nothing."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    req = d.select(
        F.lit("m").alias("model"), F.lit("zeroshot").alias("method"), F.concat(F.lit("vid_"), F.col("doc_id").cast("string")).alias("video"),
        F.concat(F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("prompt"),
    )
    out = []
    for policy in ("null", "text"):
        rows = extract_labels(score_batches(req, first_pass_scorer(7), on_error=policy, isolate=True), "greedy", "anomaly")
        label = label_int(label_number(F.col("raw_value")))
        counts = [F.count(F.lit(1)).alias("requests"), F.count("error").alias("errors"), F.count("response").alias("responses"), F.count(label).alias("labels"), F.sum(label).alias("abnormal")]
        out.append(rows.agg(*counts).select(F.lit(policy).alias("policy"), "*"))
    try:
        done = score_batches(req, first_pass_scorer(7), on_error="raise").count() - req.count()
    except PythonException:
        done = 0
    failing = F.count_if(F.col("doc_id") % 7 == 3).alias("errors")
    out.append(d.agg(F.count(F.lit(1)).alias("requests"), failing).selectExpr("'raise' AS policy", "requests", "errors", f"{done}L AS responses", "0L AS labels", "CAST(NULL AS BIGINT) AS abnormal"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(
    "scored_latency",
    """WITH r AS (
  SELECT lang, (1 + length(coalesce(text, '')) % 997) AS ms, row_number() OVER w AS rn, count(*) OVER (PARTITION BY lang) AS cnt
  FROM documents WINDOW w AS (PARTITION BY lang ORDER BY length(coalesce(text, '')) % 997))
SELECT lang AS model, count(*) AS n, round(avg(ms / CAST(1024 AS DOUBLE)), 6) AS avg_s,
       round(max(CASE WHEN rn = greatest(ceil(CAST(0.5 AS DOUBLE) * cnt), 1) THEN ms END) / CAST(1024 AS DOUBLE), 9) AS p50_s,
       round(max(CASE WHEN rn = greatest(ceil(CAST(0.9 AS DOUBLE) * cnt), 1) THEN ms END) / CAST(1024 AS DOUBLE), 9) AS p90_s,
       max(ms / CAST(1024 AS DOUBLE)) AS max_s
FROM r GROUP BY lang""",
)
def q_scored_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 + I6: a scorer whose calls take as long as its clock says, timed a
    request at a time, through to the latency table."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    req = d.select(F.col("lang").alias("model"), F.col("doc_id").cast("string").alias("video"), F.coalesce("text", F.lit("")).alias("prompt"))
    timed = TimedScorer(997, 1 / 1024)
    out = score_batches(req, timed, key_cols=["model", "video"], per_request=True, clock=timed.now)
    return latency_stats(out, ["model"], resolution=1 / 1024)


# --- T1 + T2: incremental ingest, then the same metrics as the batch flagship ----


def _passes(spark: SparkSession, sf_dir: str, with_cut: bool = False) -> list[DataFrame]:
    """The derived log as it was written: first answers, then reruns."""
    lines = derived_log_lines(derived_answers(spark, sf_dir, FLAGSHIP_RUNS, with_cut=with_cut))
    return [lines.where(F.shiftright("line_order", PASS_SHIFT) == p) for p in range(3 if with_cut else 2)]


@register("stream_metrics", ORACLE["sliced_metrics"])
def q_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship computed from a file stream: the first answers are dropped
    into a folder and ingested, then the reruns are dropped and the stream goes
    on from its checkpoint. Equal to ``sliced_metrics`` (stream = batch)."""
    base = scratch(spark, "stream")
    for p in _passes(spark, sf_dir):
        write_log_files(p, f"{base}/drop")
        ingest(spark, f"{base}/drop", f"{base}/table", f"{base}/checkpoint", dialect="greedy", key="result")
    return running_metrics(spark, f"{base}/table", derived_truth(spark, sf_dir))


def _running_sql() -> str:
    """Metrics of the first answers alone, then of all."""
    after = [
        "SELECT * FROM (WITH " + O.truth_cte() + ",\n" + O.answers_cte(FLAGSHIP_RUNS) + f",\nkept AS (SELECT * FROM answers{only}),\n"
        + O.latest_cte(O.dialect_value_sql("greedy", "result"), source="kept") + ",\n" + O.scored_cte() + ",\n" + O.sliced_metrics_sql("scored") + ")"
        for only in (" WHERE attempt = 0", "")
    ]
    return f"SELECT 0 AS after_drop, * FROM ({after[0]}) UNION ALL SELECT 1 AS after_drop, * FROM ({after[1]})"


@register("stream_running", _running_sql())
def q_stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 by retraction: metrics after the first answers were dropped and taken
    in, and again after the reruns, which take the answers they replace out."""
    base, truth, after = scratch(spark, "running"), derived_truth(spark, sf_dir), []
    for i, p in enumerate(_passes(spark, sf_dir)):
        write_log_files(p, f"{base}/drop")
        ingest_running(spark, f"{base}/drop", f"{base}/table", f"{base}/checkpoint", truth)
        after.append(metrics_after(spark, f"{base}/table", f"{base}/checkpoint").select(F.lit(i).alias("after_drop"), "*"))
    return after[0].unionByName(after[1])


@register(
    "stream_quality",
    "WITH " + O.answers_cte(FLAGSHIP_RUNS, with_cut=True) + ",\n"
    "extracted AS (SELECT *, " + O.dialect_value_sql("greedy", "result") + " AS raw_value FROM answers),\n"
    "s AS (SELECT model, method, CASE WHEN attempt = 2 THEN 'bad_line' ELSE " + _PQ_STATUS_SQL + " END AS st FROM extracted)\n"
    "SELECT model, method, CASE WHEN st = 'bad_value' THEN 'ok' ELSE st END AS parse_status, count(*) AS n FROM s GROUP BY ALL",
)
def q_stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 of the stream: lines per status over all epochs, bad lines included."""
    base = scratch(spark, "stream")
    for p in _passes(spark, sf_dir, with_cut=True):
        write_log_files(p, f"{base}/drop")
    ingest(spark, f"{base}/drop", f"{base}/table", f"{base}/checkpoint", dialect="greedy", key="result")
    return quality_table(spark, f"{base}/table")


# --- S2 id/pred logs (open-model runs): strict and loose dialects ---------------

IDPRED_MATRIX = [r for r in RUN_MATRIX if r[0] == "VILA"]


@register("idpred_metrics", grid_sql(IDPRED_MATRIX) + O.sliced_metrics_sql("scored"))
def q_idpred_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-model logs hold one ``{"id", "truth", "pred"}`` object per line.
    Zero-shot reads ``pred`` as strict JSON (a missing pred is ''); the other
    methods use the loose regex and drop lines with an empty id or pred."""
    lines = derived_log_lines(derived_answers(spark, sf_dir, [(m, me, METHOD_KEYS[me]) for m, me, *_ in IDPRED_MATRIX], with_cut=True))
    return sliced_metrics(evaluate_grid(lines, derived_truth(spark, sf_dir), run_matrix(spark, IDPRED_MATRIX)))


# --- S1 from files: the flagship over a log written to disk and read back --------


@register("file_log_metrics", ORACLE["sliced_metrics"])
def q_file_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log is written as JSONL files (K1 layout, first pass then
    reruns) under the shared checkpoint folder and read back as text: the
    line order now comes from file metadata (modification time, path, split
    start, row in split), the run from the folder names. Equal to
    ``sliced_metrics``."""
    folder = scratch(spark, "filelog")
    for p in _passes(spark, sf_dir):
        write_log_files(p, folder)
    lines = read_lines(spark, folder, recursive=True)
    lines = lines.select(
        run_from_path(F.col("file_path"), r"model=([^/]+)").alias("model"),
        run_from_path(F.col("file_path"), r"method=([^/]+)").alias("method"),
        "line",
        "line_order",
    )
    return sliced_metrics(evaluate_lines(lines, derived_truth(spark, sf_dir), dialect="greedy", key="result"))


# --- K1-K5, K7, S4, S6: what the sinks write and the file scans read ---------------

SINK_RUN = FLAGSHIP_RUNS[:1]
_SINK_SQL = "WITH " + O.answers_cte(SINK_RUN, with_reruns=False) + "\n"


def _sink_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_answers(spark, sf_dir, SINK_RUN, with_reruns=False).select("model", "method", "video", "response")


@register("sink_responses", _SINK_SQL + "SELECT model, method, video, sha256(response) AS response_sha FROM answers")
def q_sink_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 / K4: responses appended as Parquet by run, read back."""
    path = scratch(spark, "responses")
    sinks.append_responses(_sink_answers(spark, sf_dir), path)
    return spark.read.parquet(path).select("model", "method", "video", F.sha2("response", 256).alias("response_sha"))


@register("sink_jsonl", _SINK_SQL + "SELECT video, sha256(response) AS response_sha FROM answers")
def q_sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 as JSONL: written and read back by the keyed scan."""
    path = scratch(spark, "jsonl")
    sinks.export_jsonl(_sink_answers(spark, sf_dir), path)
    return read_keyed_log(spark, path).select("video", F.sha2("response", 256).alias("response_sha"))


@register(
    "sink_snapshots",
    _SINK_SQL + "SELECT form, video, sha256(response) AS response_sha FROM answers, (VALUES ('list'), ('object')) f(form)",
)
def q_sink_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + K3: list and flat-object snapshots, read back."""
    base, a = scratch(spark, "snapshot"), _sink_answers(spark, sf_dir)
    sinks.snapshot_list(a, f"{base}/list")
    sinks.snapshot_object(a, f"{base}/object")
    pairs = spark.read.text(f"{base}/list").select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    members = spark.read.text(f"{base}/object").select(F.explode(F.from_json("value", "map<string,string>")).alias("video", "response"))
    listed = pairs.select(F.lit("list").alias("form"), F.get("p", F.lit(0)).alias("video"), F.get("p", F.lit(1)).alias("response"))
    both = listed.unionByName(members.select(F.lit("object").alias("form"), "video", "response"))
    return both.select("form", "video", F.sha2("response", 256).alias("response_sha"))


@register("sink_scored", ORACLE["scored_rows"])
def q_sink_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: scored rows as partitioned CSV, read back."""
    path, rows = scratch(spark, "scored"), scored_output(flagship_scored(spark, sf_dir))
    sinks.write_scored(rows, path, fmt="csv")
    return spark.read.schema(rows.schema).option("header", "true").csv(path).select(*rows.columns)


@register(
    "sink_records",
    "WITH " + O.chain_records_cte(CHAIN_RUNS) + ",\n" + _LAST_RECORDS_SQL + ",\n"
    "rec AS (SELECT model, video, " + O.chain_fields_sql() + " FROM last_records)\n"
    "SELECT model, video, video_description, reasoning, anomaly FROM rec",
)
def q_sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the records of all chain runs as CSV, whole texts, read back."""
    path = scratch(spark, "records")
    recs = with_chain_record(_first_pass(spark, sf_dir), "response")
    rows = recs.select("model", "video", "record.video_description", "record.reasoning", "record.anomaly")
    sinks.dump_records(rows, path, rows.columns)
    return sinks.read_records(spark, path, rows.schema)


@register("sink_append", "WITH " + O.answers_cte(FLAGSHIP_RUNS, with_reruns=False) + "\nSELECT model, method, video, sha256(response) AS response_sha FROM answers")
def q_sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 / K4 exactly once: every run appends its responses, then the whole job
    is run again, as after a crash of the driver."""
    path = scratch(spark, "appended")
    rows = derived_answers(spark, sf_dir, FLAGSHIP_RUNS, with_reruns=False).select("model", "method", "video", "response")
    for _ in range(2):
        for model, method, _ in FLAGSHIP_RUNS:
            sinks.append_once(rows.where((F.col("model") == model) & (F.col("method") == method)), path, f"{model}/{method}")
    return sinks.read_appended(spark, path, rows.schema).select("model", "method", "video", F.sha2("response", 256).alias("response_sha"))


@register("truth_file", "WITH " + O.truth_cte() + "\nSELECT title, category, label, true_label FROM truth")
def q_truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + J3: the annotated CSV, written and read by the ground-truth scan."""
    path = scratch(spark, "truth")
    t = derived_truth(spark, sf_dir).select(F.col("title").alias("Title"), F.col("category").alias("Category"), F.col("label").alias("Label"))
    t.write.option("header", "true").csv(path)
    return read_ground_truth(spark, path)


@register(
    "trim_file",
    "SELECT c_custkey AS no, c_name AS title, CAST(CASE WHEN c_nationkey <> 0 THEN floor(c_acctbal / 100) END AS DOUBLE) AS time FROM customer",
)
def q_trim_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trim list, written and read by its scan."""
    path = scratch(spark, "trims")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("No."), F.col("c_name").alias("Title"), F.when(F.col("c_nationkey") != 0, F.floor(F.col("c_acctbal") / 100)).alias("Time")
    )
    c.write.option("header", "true").csv(path)
    return read_trim_list(spark, path).withColumn("no", F.col("no").cast("long"))


# --- A11 for the ground truth -------------------------------------------------------


@register(
    "truth_quality",
    "WITH " + O.truth_cte() + ",\n"
    "t AS (SELECT title, count(*) AS copies, count(*) FILTER (WHERE true_label IS NULL) AS unlabelled FROM truth GROUP BY title)\n"
    "SELECT CAST(sum(copies) AS BIGINT) AS rows, count(*) AS titles, count(*) FILTER (WHERE copies > 1) AS duplicate_titles,\n"
    "       CAST(sum(unlabelled) AS BIGINT) AS unlabelled_rows FROM t",
)
def q_truth_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdikt.operators.metrics import truth_quality

    return truth_quality(derived_truth(spark, sf_dir))
