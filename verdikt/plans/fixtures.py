"""Response logs derived from the driver's tables.

The driver's tables hold no model answers, so the evaluation queries run on
a response log that Spark derives from ``documents`` and ``labels``: every
document is one "video", every run answers it, and the answer text carries
the document's whole text as the model's prose around a JSON verdict whose
shape rotates through the messy forms the extraction dialects must handle.
Ground truth comes from ``labels``. The same derivation is written in SQL in
:mod:`verdikt.plans.oracle`, so DuckDB can recompute every result.

Derivation (all integer arithmetic on ``doc_id``):

* truth ``t``: 1 when ``toxic = 1 or quality = 0``, 0 when labelled
  otherwise, ``doc_id % 2`` for unlabelled documents (they are answered but
  have no ground truth, so the inner join drops them)
* label text: toxic -> 'Vague Abnormal', quality 0 -> 'Abnormal', else 'Normal'
* category: one of 7 names by ``doc_id % 7``; when ``doc_id % 5 = 0`` a
  second name (Security / Wildlife / Kid Monitoring by ``doc_id % 3``)
* answer ``p`` of run ``r``: ``1 - t`` when ``(doc_id * 31 + r * 17) % 6 = 0``
* answer shape by ``doc_id % 17`` (0 bare JSON, 1 fenced, 2 '// note', 3
  quoted value, 4 trailing prose, 5 other key, 6 no answer, 7 null, 8 two
  objects, 9 "NAN", 10 a missing comma after a quote and newline, 11 a URL in a
  string, 12 a nested object, 13 a literal backslash-n and a carriage return, 14
  label 2, 15 an explicit null, 16 the fraction 0.9); all shapes but 0 and 7 are
  preceded by the document text
* reruns: documents with ``doc_id % 4 = 0`` were answered twice; the first
  (stale) answer says ``1 - p`` and must lose to the second (last wins)
* cut lines (where asked for): documents with ``doc_id % 9 = 0`` have a third
  line that says ``1 - p`` and lost its last character when it was written
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.config import CATEGORIES
from verdikt.functions.sqltext import lit
from verdikt.operators.dedup import is_listed, list_places
from verdikt.sources.tables import read_table, spread

NL = "\n"
SHAPES = 17
QB, QU, QN = '"a": "b"', '"a": "http://x"', '"a": {"b": 2}'
SECOND_CATEGORIES = ["Security", "Wildlife", "Kid Monitoring"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return read_table(spark, sf_dir, name)


# The derivation is written as Spark SQL text: one expression per column.


def _pick_sql(index: str, values: Sequence[str]) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def category_sql(doc: str = "doc_id") -> str:
    first = _pick_sql(f"{doc} % 7", CATEGORIES)
    second = _pick_sql(f"{doc} % 3", SECOND_CATEGORIES)
    return f"CASE WHEN {doc} % 5 = 0 THEN concat({first}, ', ', {second}) ELSE {first} END"


LABEL_TEXT_SQL = "CASE WHEN toxic = 1 THEN 'Vague Abnormal' WHEN quality = 0 THEN 'Abnormal' ELSE 'Normal' END"
TRUTH_SQL = (
    "coalesce(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL THEN 0 END, CAST(doc_id % 2 AS INT))"
)
ANSWER_SQL = "CASE WHEN (doc_id * 31 + run.run_idx * 17) % 6 = 0 THEN 1 - t ELSE t END"


def response_sql() -> str:
    """The answer text from the staged columns ``p``, ``key``, ``shape``,
    ``attempt`` and ``text``."""
    obj = "concat('{\"', key, '\": ', CAST(p AS STRING), '}')"
    kq = "concat('{\"', key, '\": ')"
    body = (
        "CASE shape"
        f" WHEN 0 THEN {obj}"
        f" WHEN 1 THEN concat({lit('```json' + NL)}, {obj}, {lit(NL + '```')})"
        f" WHEN 2 THEN concat({kq}, CAST(p AS STRING), {lit(' // note' + NL + '}')})"
        f" WHEN 3 THEN concat({kq}, '\"', CAST(p AS STRING), '\"}}')"
        f" WHEN 4 THEN concat({obj}, {lit(NL + 'That is all.')})"
        " WHEN 5 THEN concat('{\"other\": ', CAST(p AS STRING), '}')"
        " WHEN 6 THEN 'no answer'"
        f" WHEN 8 THEN concat({obj}, ' or ', {kq}, CAST(1 - p AS STRING), '}}')"
        f" WHEN 9 THEN concat({kq}, '\"NAN\"}}')"
        f" WHEN 10 THEN concat({lit('{' + QB + NL + chr(34))}, key, '\": ', CAST(p AS STRING), {lit(NL + '}')})"
        f" WHEN 11 THEN concat({lit('{' + QU + ',' + NL + chr(34))}, key, '\": ', CAST(p AS STRING), '}}')"
        f" WHEN 12 THEN concat({lit('{' + QN + ', ' + chr(34))}, key, '\": ', CAST(p AS STRING), '}}')"
        f" WHEN 13 THEN concat({kq}, CAST(p AS STRING), {lit(chr(92) + 'n' + chr(13) + NL + '}')})"
        f" WHEN 14 THEN concat({kq}, '2}}')"
        f" WHEN 15 THEN concat({kq}, 'null}}')"
        f" WHEN 16 THEN concat({kq}, '0.9}}')"
        " END"
    )
    fresh = f"CASE WHEN shape = 7 THEN CAST(NULL AS STRING) WHEN shape = 0 THEN {body} ELSE concat(text, {lit(NL)}, {body}) END"
    stale = f"concat(text, {lit(NL)}, {kq}, CAST(1 - p AS STRING), '}}')"
    return f"CASE WHEN attempt <> 1 THEN {stale} ELSE {fresh} END"


def _runs_sql(runs: Sequence[tuple[str, str, str]], run_offset: int) -> str:
    items = ", ".join(
        f"named_struct('run_idx', {i + run_offset}, 'model', {lit(m)}, 'method', {lit(me)}, 'key', {lit(k)})"
        for i, (m, me, k) in enumerate(runs)
    )
    return f"array({items})"


def _base(spark: SparkSession, sf_dir: str, doc_cols: Sequence[str]) -> DataFrame:
    """Documents (spread over the cluster) with their truth bit ``t``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", *doc_cols))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # labels is a dimension of documents (at most one row per doc_id); the
    # planner broadcasts it when its file-size estimate is small.
    return docs.join(lab, "doc_id", "left")


def _placed_base(spark: SparkSession, sf_dir: str, doc_cols: Sequence[str]) -> DataFrame:
    """Documents with their place (``line_file``, ``row``) and truth bit ``t``. The
    labels are joined to ids and places; texts stay where they are read, however
    many labels there are."""
    place = [F.md5(F.col("_metadata.file_path").cast("binary")).alias("line_file"), F.col("_metadata.row_index").alias("row")]
    docs = table(spark, sf_dir, "documents").select("doc_id", *doc_cols, *place)
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    truth = docs.select("doc_id", "line_file", "row").join(lab, "doc_id").selectExpr("line_file AS file", "row AS at", f"CAST({TRUTH_SQL} AS LONG) AS entry")
    folder = list_places(truth.groupBy("file", "at").agg(F.max("entry").alias("entry")))
    is_truth = lambda t: is_listed(folder, F.col("line_file"), F.col("row"), F.lit(t))
    docs = spread(docs).select("*", is_truth(1).alias("is_1"), is_truth(0).alias("is_0"))
    return docs.selectExpr("doc_id", *doc_cols, "line_file", "row", "CASE WHEN is_1 THEN 1 WHEN is_0 THEN 0 ELSE CAST(doc_id % 2 AS INT) END AS t")


def derived_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth (title, category, label, true_label) from ``labels``."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lab.selectExpr(
        "concat('vid_', CAST(doc_id AS STRING)) AS title",
        f"{category_sql()} AS category",
        f"{LABEL_TEXT_SQL} AS label",
        f"{TRUTH_SQL} AS true_label",
    )


def derived_answers(
    spark: SparkSession,
    sf_dir: str,
    runs: Sequence[tuple[str, str, str]],
    with_reruns: bool = True,
    run_offset: int = 0,
    with_cut: bool = False,
) -> DataFrame:
    """One row per (run, document, attempt): model, method, video, response.
    ``with_cut`` adds attempt 2, whose line :func:`derived_log_lines` cuts.

    ``runs`` lists (model, method, answer key); run ``r`` is its position
    plus ``run_offset``. The run list is small and fixed, so it is expanded
    with ``explode`` (a generator in the same stage), not a join.
    """
    attempts = "CASE WHEN doc_id % 4 = 0 THEN array(0, 1) ELSE array(1) END" if with_reruns else "array(1)"
    if with_cut:
        attempts = f"concat({attempts}, CASE WHEN doc_id % 9 = 0 THEN array(2) ELSE CAST(array() AS ARRAY<INT>) END)"
    x = _base(spark, sf_dir, ["text"]).selectExpr(
        "doc_id", "text", f"{TRUTH_SQL} AS t", f"explode({_runs_sql(runs, run_offset)}) AS run"
    )
    # Stage the per-row answer, key and shape so the answer expression
    # refers to them instead of repeating their expressions.
    x = x.selectExpr(
        "run.model AS model",
        "run.method AS method",
        "doc_id",
        "text",
        "run.key AS key",
        f"CAST({ANSWER_SQL} AS INT) AS p",
        f"CAST(doc_id % {SHAPES} AS INT) AS shape",
        f"explode({attempts}) AS attempt",
    )
    return x.selectExpr(
        "model",
        "method",
        "doc_id",
        "concat('vid_', CAST(doc_id AS STRING), '.mp4') AS video",
        "attempt",
        f"{response_sql()} AS response",
    )


def derived_log_lines(answers: DataFrame) -> DataFrame:
    """The JSONL lines a run would have appended, with their write order.

    ``line_order`` = attempt, then doc_id, in 64 bits: reruns are appended
    after the first pass, documents in id order within a pass. The open model
    logs id/pred objects.
    """
    lines = answers.selectExpr(
        "model",
        "method",
        "attempt",
        "CASE WHEN model = 'VILA' THEN to_json(named_struct('id', video, 'truth', CAST(NULL AS INT), 'pred', response))"
        " ELSE to_json(map(video, response)) END AS line",
        f"shiftleft(CAST(attempt AS BIGINT), {PASS_SHIFT}) + doc_id AS line_order",
    )
    cut = "CASE WHEN attempt = 2 THEN substring(line, 1, length(line) - 1) ELSE line END AS line"
    return lines.selectExpr("model", "method", cut, "line_order")


# A log line's order: the attempt above this many bits of document number.
PASS_SHIFT = 48

FLAGSHIP_RUNS = [("model_0", "zeroshot", "result"), ("model_1", "zeroshot", "result"), ("model_2", "zeroshot", "result")]


def derived_chain_records(spark: SparkSession, sf_dir: str, runs: Sequence[tuple[str, str, str]], run_offset: int = 0) -> DataFrame:
    """First-pass chain answers: a JSON record (description = the whole
    document text, reasoning, anomaly) in six shapes by ``doc_id % 6``: 0 plain,
    1 fenced, 2 without reasoning, 3 cut short (unreadable), 4 null, 5 with an
    explicit null as anomaly. Documents with ``doc_id % 4 = 0`` have a stale
    answer (attempt 0) before it, a plain record that says ``1 - p``.
    ``line_file`` and ``line_at`` are an answer's place: its document's file and a
    number from the document's row, the run and the attempt.
    """
    runs3 = [(m, me, "anomaly") for m, me, _ in runs]
    x = _placed_base(spark, sf_dir, ["text", "lang", "source"]).selectExpr(
        "doc_id", "text", "lang", "source", "line_file", "row", "t", f"explode({_runs_sql(runs3, run_offset)}) AS run"
    )
    x = x.selectExpr(
        "run.model AS model", "run.method AS method", "doc_id", "text", "lang", "source", "line_file",
        f"row * {len(runs)} + run.run_idx - {run_offset} AS answer", f"CAST({ANSWER_SQL} AS INT) AS p",
        "explode(CASE WHEN doc_id % 4 = 0 THEN array(0, 1) ELSE array(1) END) AS attempt",
    )
    # Each branch serialises the record it needs; only one branch runs per row.
    seen = "'reasoning', concat('seen in ', lang, ' footage from ', source)"
    full = "to_json(named_struct('video_description', text, " + seen + ", 'anomaly', {p}), map('ignoreNullFields', 'false'))"
    short = "to_json(named_struct('video_description', text, 'anomaly', p))"
    plain = full.format(p="p")
    resp = (
        f"CASE WHEN attempt = 0 THEN {full.format(p='1 - p')} ELSE"
        f" CASE doc_id % 6 WHEN 0 THEN {plain}"
        f" WHEN 1 THEN concat({lit('```json' + NL)}, {plain}, {lit(NL + '```')})"
        f" WHEN 2 THEN {short}"
        f" WHEN 3 THEN substring({plain}, 1, length({plain}) - 1)"
        f" WHEN 5 THEN {full.format(p='CAST(NULL AS INT)')} END END"
    )
    return x.selectExpr("model", "method", "doc_id", "attempt", "concat('vid_', CAST(doc_id AS STRING), '.mp4') AS video", f"{resp} AS response",
                        "line_file", "answer * 2 + attempt AS line_at")


FRAME_CHARS = 64


def document_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frames, inventory): every document is a video whose frames are the
    slices of ``FRAME_CHARS`` characters of its text. The inventory has the
    number of frames, so nothing has to count them."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.selectExpr("concat('vid_', CAST(doc_id AS STRING)) AS video", "text", f"CAST(ceil(length(text) / {FRAME_CHARS}) AS BIGINT) AS n_frames")
    # A text is cut once, in one pass, and isn't copied into its frames.
    cut = f"posexplode(regexp_extract_all(text, '(?s).{{1,{FRAME_CHARS}}}', 0)) AS (frame_idx, slice)"
    frames = d.selectExpr("video", cut).selectExpr("video", "CAST(frame_idx AS BIGINT) AS frame_idx", "encode(slice, 'UTF-8') AS payload")
    return frames, d.select("video", "n_frames")


# --- offline scorers: stand-ins for a model ------------------------------------


def keyword_scorer(words: Sequence[str], key: str = "result", threshold: int = 1):
    """A deterministic scorer: flags a text as anomalous when it contains at
    least ``threshold`` of ``words`` (whole-text scan)."""
    ws = [w.lower() for w in words]

    def score(pdf):
        hits = [None if t is None else sum(t.lower().count(w) for w in ws) for t in pdf["prompt"]]
        return [None if h is None else '{"%s": %d}' % (key, h >= threshold) for h in hits]

    return score


def first_pass_scorer(fails_every: int):
    """First chain pass: a record with the length of the text it was shown; the
    anomaly is whether that length is odd. Calls for videos whose number leaves
    3 when divided by ``fails_every`` fail."""

    def score(pdf):
        out = []
        for video, prompt in zip(pdf["video"], pdf["prompt"]):
            if int(video.removeprefix("vid_").removesuffix(".mp4")) % fails_every == 3:
                raise TimeoutError("no answer")
            n = len(prompt.partition("\n\n")[2])
            out.append(json.dumps({"video_description": f"a text of {n} characters", "reasoning": "counted", "anomaly": n % 2}))
        return out

    return score


def second_pass_scorer(pdf):
    """Second chain pass: keeps the verdict shown, but a record that could not
    be read is an anomaly."""
    unread = pdf["prompt"].str.contains('"video_description": "NAN"', regex=False)
    given = pdf["prompt"].str.contains('"anomaly": 1}', regex=False)
    return ['{"Rule_Reasoning": "none", "updated_anomaly": %d}' % (u or g) for u, g in zip(unread, given)]


class TimedScorer:
    """A scorer with a clock of its own, on which a call takes 1 + length %
    ``modulus`` ticks of the text it is shown."""

    def __init__(self, modulus: int, tick: float):
        self.modulus, self.tick, self.ticks = modulus, tick, 0

    def now(self) -> float:
        return self.ticks * self.tick

    def __call__(self, pdf):
        self.ticks += sum(1 + len(t) % self.modulus for t in pdf["prompt"])
        return ["{}"] * len(pdf)


def write_media_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """A media folder derived from ``supplier``: a file for every supplier whose
    number isn't a multiple of five, as many bytes long as the number; right in
    the folder for even numbers, below nation and day for odd ones. Every
    seventh is no video. Tasks write the files."""

    def write(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, n in zip(pdf["path"], pdf["n"]):
                fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as f:
                    f.write(b"x" * n)
            yield pdf[["n"]]

    s = spread(table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0"))
    s.selectExpr(f"{MEDIA_PATH_SQL} AS path", "s_suppkey AS n").mapInPandas(write, "n long").agg({"n": "max"}).collect()


MEDIA_PATH_SQL = (
    "concat(CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE concat('nation_', s_nationkey, '/day ', s_suppkey % 3, '/') END,"
    " 'vid_', s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '.txt' ELSE '.mp4' END)"
)
