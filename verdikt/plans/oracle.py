"""The fixture derivation and the evaluation rules restated in DuckDB SQL.

These strings are the independent side of the correctness check: they
recompute each registered query from the same parquet tables with DuckDB's
own regex (RE2) and JSON functions. They are plain SQL text, not used by
the Spark code paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from verdikt.config import CATEGORIES, CLEAR_LABELS, VAGUE_LABELS

SECOND_CATEGORIES = ["Security", "Wildlife", "Kid Monitoring"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_pick(expr: str, values: Sequence[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def category_sql(doc: str = "doc_id") -> str:
    first = _case_pick(f"{doc} % 7", CATEGORIES)
    second = _case_pick(f"{doc} % 3", SECOND_CATEGORIES)
    return f"(CASE WHEN {doc} % 5 = 0 THEN {first} || ', ' || {second} ELSE {first} END)"


def truth_cte() -> str:
    return f"""truth AS (
  SELECT 'vid_' || CAST(doc_id AS VARCHAR) AS title,
         {category_sql()} AS category,
         CASE WHEN toxic = 1 THEN 'Vague Abnormal' WHEN quality = 0 THEN 'Abnormal' ELSE 'Normal' END AS label,
         CAST(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS INTEGER) AS true_label
  FROM labels)"""


def runs_values(runs: Sequence[tuple[str, str, str]]) -> str:
    vals = ", ".join(f"({i}, {_q(m)}, {_q(me)}, {_q(k)})" for i, (m, me, k) in enumerate(runs))
    return f"(VALUES {vals}) AS r(run_idx, model, method, key)"


def answers_cte(runs: Sequence[tuple[str, str, str]], with_reruns: bool = True, with_cut: bool = False) -> str:
    """CTEs ``base``, ``x`` and ``answers`` (model, method, doc_id, video, attempt, response)."""
    nl = "chr(10)"
    rerun_filter = "a.attempt = 1" + (" OR a.attempt = 0 AND b.doc_id % 4 = 0" if with_reruns else "") + (
        " OR a.attempt = 2 AND b.doc_id % 9 = 0" if with_cut else "")
    obj = "'{\"' || key || '\": ' || CAST(p AS VARCHAR) || '}'"
    kq = "'{\"' || key || '\": '"
    body = f"""CASE shape
        WHEN 0 THEN {obj}
        WHEN 1 THEN '```json' || {nl} || {obj} || {nl} || '```'
        WHEN 2 THEN {kq} || CAST(p AS VARCHAR) || ' // note' || {nl} || '}}'
        WHEN 3 THEN {kq} || '"' || CAST(p AS VARCHAR) || '"}}'
        WHEN 4 THEN {obj} || {nl} || 'That is all.'
        WHEN 5 THEN '{{"other": ' || CAST(p AS VARCHAR) || '}}'
        WHEN 6 THEN 'no answer'
        WHEN 8 THEN {obj} || ' or ' || {kq} || CAST(1 - p AS VARCHAR) || '}}'
        WHEN 9 THEN {kq} || '"NAN"}}'
        WHEN 10 THEN '{{"a": "b"' || {nl} || '"' || key || '": ' || CAST(p AS VARCHAR) || {nl} || '}}'
        WHEN 11 THEN '{{"a": "http://x",' || {nl} || '"' || key || '": ' || CAST(p AS VARCHAR) || '}}'
        WHEN 12 THEN '{{"a": {{"b": 2}}, "' || key || '": ' || CAST(p AS VARCHAR) || '}}'
        WHEN 13 THEN {kq} || CAST(p AS VARCHAR) || chr(92) || 'n' || chr(13) || {nl} || '}}'
        WHEN 14 THEN {kq} || '2}}'
        WHEN 15 THEN {kq} || 'null}}'
        WHEN 16 THEN {kq} || '0.9}}'
      END"""
    body = body.replace("}}", "}").replace("{{", "{")
    return f"""base AS (
  SELECT d.doc_id, d.text,
         CAST(coalesce(CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 WHEN l.toxic IS NOT NULL THEN 0 END,
                       d.doc_id % 2) AS INTEGER) AS t
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
x AS (
  SELECT b.doc_id, b.text, r.run_idx, r.model, r.method, r.key, a.attempt,
         CAST(CASE WHEN (b.doc_id * 31 + r.run_idx * 17) % 6 = 0 THEN 1 - b.t ELSE b.t END AS INTEGER) AS p,
         b.doc_id % 17 AS shape
  FROM base b CROSS JOIN {runs_values(runs)} CROSS JOIN (VALUES (0), (1), (2)) AS a(attempt)
  WHERE {rerun_filter}),
answers AS (
  SELECT model, method, doc_id, 'vid_' || CAST(doc_id AS VARCHAR) || '.mp4' AS video, attempt, run_idx, key,
         CASE WHEN attempt <> 1 THEN text || {nl} || {kq} || CAST(1 - p AS VARCHAR) || '}}'
              WHEN shape = 7 THEN NULL
              WHEN shape = 0 THEN {body}
              ELSE text || {nl} || {body} END AS response
  FROM x)""".replace("'}}'", "'}'")


NUMBER_SQL = (
    "CASE WHEN {v} = 'true' THEN 1.0 WHEN {v} = 'false' THEN 0.0 "
    "WHEN regexp_full_match({v}, '\\s*[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?\\s*') "
    "THEN try_cast({v} AS DOUBLE) END"
)


def number_sql(v: str) -> str:
    return "(" + NUMBER_SQL.format(v=v) + ")"


def int_sql(num: str) -> str:
    return f"try_cast(trunc({num}) AS INTEGER)"


def json_value_sql(doc: str, key_path: str) -> str:
    """Strict-JSON member text; ``key_path`` is a SQL expression for '$.key'."""
    return f"CASE WHEN {doc} IS NOT NULL AND {doc} <> '' AND json_valid({doc}) THEN json_extract_string({doc}, {key_path}) END"


def greedy_doc_sql(text: str, strip_comments: bool = True) -> str:
    b = f"regexp_extract({text}, '(?s)\\{{.*\\}}', 0)"
    if strip_comments:
        b = f"regexp_replace({b}, '//[^\\n]*', '', 'g')"
    return b


def flat_doc_sql(text: str) -> str:
    flat = f"replace(replace({text}, chr(10), ' '), chr(13), '')"
    b = f"regexp_extract({flat}, '(?s)\\{{.*?\\}}', 0)"
    b = f"replace({b}, '\\n', '')"
    return f"regexp_replace({b}, '//[^\\n]*', '', 'g')"


def repair_doc_sql(text: str) -> str:
    rep = f"regexp_replace({text}, '\"(\\s*\\n)', '\",\\1', 'g')"
    return f"regexp_extract({rep}, '(?s)\\{{.*?\\}}', 0)"


def regex_value_sql(src: str, dialect: str, key: str) -> str:
    if dialect == "regex":
        pat = "[\"']?" + key + "[\"']?\\s*:\\s*[\"']?([0-9]+)"
    elif dialect == "loose":
        pat = "[\"']?" + key + "[\"']?\\s*:\\s*([0-9]+)"
    elif dialect == "rawline":
        pat = '\\\\"' + key + '\\\\"\\s*:\\s*([0-9]+)'
    else:
        raise ValueError(dialect)
    return f"nullif(regexp_extract({src}, {_q(pat)}, 1), '')"


def raw_line_sql(video: str, response: str) -> str:
    return f"CAST(json_object({video}, {response}) AS VARCHAR)"


def dialect_value_sql(dialect: str, key: str, text: str = "response", video: str = "video") -> str:
    path = _q("$." + key)
    if dialect == "greedy":
        return json_value_sql(greedy_doc_sql(text), path)
    if dialect == "greedy_raw":
        return json_value_sql(greedy_doc_sql(text, False), path)
    if dialect == "flat":
        return json_value_sql(flat_doc_sql(text), path)
    if dialect == "repair":
        return json_value_sql(repair_doc_sql(text), path)
    if dialect == "strict":
        return json_value_sql(text, path)
    if dialect == "rawline":
        return regex_value_sql(raw_line_sql(video, text), dialect, key)
    return regex_value_sql(text, dialect, key)


def slices_values() -> str:
    names = [("all", False), ("clear", False), ("vague", False)] + [(c, True) for c in CATEGORIES]
    vals = ", ".join(f"({_q(n)}, {'TRUE' if c else 'FALSE'})" for n, c in names)
    return f"(VALUES {vals}) AS s(slice, is_category)"


def slice_member_sql() -> str:
    clear = ", ".join(_q(x) for x in CLEAR_LABELS)
    vague = ", ".join(_q(x) for x in VAGUE_LABELS)
    return (
        f"CASE WHEN s.slice = 'all' THEN TRUE WHEN s.slice = 'clear' THEN sc.label IN ({clear}) "
        f"WHEN s.slice = 'vague' THEN sc.label IN ({vague}) ELSE coalesce(contains(sc.category, s.slice), FALSE) END"
    )


def sliced_metrics_sql(scored_cte: str, group_cols: Sequence[str] = ("model", "method")) -> str:
    """Final SELECT of sliced metrics over a CTE named ``scored_cte``."""
    g = ", ".join(group_cols)
    gs = ", ".join(f"sc.{c}" for c in group_cols)
    gg = ", ".join(f"g.{c}" for c in group_cols)
    on = " AND ".join(f"c.{c} = g.{c}" for c in group_cols)
    return f"""cnt AS (
  SELECT {gs}, s.slice,
         count(*) FILTER (WHERE sc.true_label = 0 AND sc.predicted_label = 0) AS tn,
         count(*) FILTER (WHERE sc.true_label = 0 AND sc.predicted_label = 1) AS fp,
         count(*) FILTER (WHERE sc.true_label = 1 AND sc.predicted_label = 0) AS fn,
         count(*) FILTER (WHERE sc.true_label = 1 AND sc.predicted_label = 1) AS tp,
         count(*) FILTER (WHERE sc.true_label = 1 AND sc.predicted_label NOT IN (0, 1)) AS pos_other,
         count(*) FILTER (WHERE sc.true_label = 0 AND sc.predicted_label NOT IN (0, 1)) AS neg_other
  FROM {scored_cte} sc JOIN {slices_values()} ON ({slice_member_sql()})
  GROUP BY {gs}, s.slice),
grid AS (
  SELECT {gg}, s.slice, s.is_category FROM (SELECT DISTINCT {g} FROM {scored_cte}) g CROSS JOIN {slices_values()}),
full_counts AS (
  SELECT {gg}, g.slice, g.is_category,
         coalesce(c.tn, 0) AS tn, coalesce(c.fp, 0) AS fp, coalesce(c.fn, 0) AS fn, coalesce(c.tp, 0) AS tp,
         coalesce(c.pos_other, 0) AS pos_other, coalesce(c.neg_other, 0) AS neg_other
  FROM grid g LEFT JOIN cnt c ON {on} AND c.slice = g.slice)
SELECT {g}, slice,
       CAST(tn + fp + fn + tp + pos_other + neg_other AS BIGINT) AS n,
       CAST(pos_other + neg_other AS BIGINT) AS n_other,
       CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
       CAST(tn + tp AS BIGINT) AS correct,
       CASE WHEN tp + fn + pos_other > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn + pos_other AS DOUBLE) ELSE 0.0 END AS accuracy_abnormal,
       CASE WHEN tn + fp + neg_other > 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp + neg_other AS DOUBLE) ELSE 0.0 END AS accuracy_normal,
       CASE WHEN tn + fp + fn + tp + pos_other + neg_other > 0
            THEN CAST(tn + tp AS DOUBLE) / CAST(tn + fp + fn + tp + pos_other + neg_other AS DOUBLE)
            WHEN is_category THEN 0.0 END AS overall_accuracy,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1
FROM full_counts"""


def latest_cte(value_sql: str, name: str = "latest", source: str = "answers", extra: str = "") -> str:
    """Extract, then keep the last attempt per (model, method, video)."""
    return f"""extracted AS (
  SELECT model, method, video, attempt, doc_id{extra}, {value_sql} AS raw_value FROM {source}),
{name} AS (
  SELECT * FROM extracted
  QUALIFY row_number() OVER (PARTITION BY model, method, video ORDER BY attempt DESC, doc_id DESC) = 1)"""


def scored_cte(latest: str = "latest", policy_sql: str = "'wrong'", coerce_sql: str = "TRUE") -> str:
    """``coerce_sql``: whether fractions are numbers for a row."""
    num = number_sql("l.raw_value")
    num = f"(CASE WHEN {coerce_sql} OR {num} = floor({num}) THEN {num} END)"
    pint = int_sql(num)
    return f"""joined AS (
  SELECT l.*, {num} AS pred_number, t.title, t.category, t.label, t.true_label, {policy_sql} AS policy_v
  FROM {latest} l JOIN truth t ON replace(l.video, '.mp4', '') = t.title),
scored AS (
  SELECT *, replace(video, '.mp4', '') AS video_name,
         CASE WHEN policy_v = 'negative' THEN (CASE WHEN pred_number >= 1 THEN 1 ELSE 0 END)
              ELSE coalesce({int_sql('pred_number')}, 1 - true_label) END AS predicted_label
  FROM joined)""".replace("{pint}", pint)


def chain_records_cte(runs: Sequence[tuple[str, str, str]], run_offset: int = 0) -> str:
    """CTE ``records`` (model, method, doc_id, attempt, video, response): first-pass chain answers."""
    vals = ", ".join(f"({i + run_offset}, {_q(m)}, {_q(me)})" for i, (m, me, _) in enumerate(runs))

    def full(p):
        return f"CAST(json_object('video_description', text, 'reasoning', 'seen in ' || lang || ' footage from ' || source, 'anomaly', {p}) AS VARCHAR)"

    short = "CAST(json_object('video_description', text, 'anomaly', p) AS VARCHAR)"
    return f"""cbase AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
         CAST(coalesce(CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 WHEN l.toxic IS NOT NULL THEN 0 END,
                       d.doc_id % 2) AS INTEGER) AS t
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cx AS (
  SELECT b.*, r.run_idx, r.model, r.method, a.attempt,
         CAST(CASE WHEN (b.doc_id * 31 + r.run_idx * 17) % 6 = 0 THEN 1 - b.t ELSE b.t END AS INTEGER) AS p
  FROM cbase b CROSS JOIN (VALUES {vals}) AS r(run_idx, model, method) CROSS JOIN (VALUES (0), (1)) AS a(attempt)
  WHERE a.attempt = 1 OR b.doc_id % 4 = 0),
records AS (
  SELECT model, method, doc_id, attempt, 'vid_' || CAST(doc_id AS VARCHAR) || '.mp4' AS video,
         CASE WHEN attempt = 0 THEN {full('1 - p')} ELSE
         CASE doc_id % 6 WHEN 0 THEN {full('p')}
                         WHEN 1 THEN '```json' || chr(10) || {full('p')} || chr(10) || '```'
                         WHEN 2 THEN {short}
                         WHEN 3 THEN substring({full('p')}, 1, length({full('p')}) - 1)
                         WHEN 5 THEN {full('CAST(NULL AS INTEGER)')}
                         ELSE NULL END END AS response
  FROM cx)"""


WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def chain_fields_sql(resp: str = "response") -> str:
    """Columns video_description, reasoning, anomaly, parsed of a chain record."""
    c = f"trim(replace(trim(trim({resp}, '`json'), {WS_SQL}), chr(10) || chr(10), ' '), {WS_SQL})"
    ok = f"(CASE WHEN coalesce(json_valid({c}), FALSE) THEN json_type({c}) = 'OBJECT' ELSE FALSE END)"
    def f(name, default):
        # An explicit null stays null, a missing member takes the default.
        given = f"{ok} AND json_type({c}, '$.{name}') = 'NULL'"
        return f"CASE WHEN {given} THEN NULL WHEN {ok} THEN coalesce(json_extract_string({c}, '$.{name}'), '{default}') ELSE '{default}' END"
    return (f"{f('video_description', 'NAN')} AS video_description, {f('reasoning', 'NAN')} AS reasoning, "
            f"{f('anomaly', '0')} AS anomaly, coalesce({ok}, FALSE) AS parsed")
