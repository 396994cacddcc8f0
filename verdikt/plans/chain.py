"""I8: the two-pass rule-review chain as a resumable Spark job.

Pass 1 scores the requests (chain-of-thought prompt), pass 2 re-scores each
answer's record against the rule block. The passes are separated by tables
written to the shared checkpoint folder (``spark.checkpoint.dir``): model
calls are the expensive, non-repeatable part, so the lineage is cut there
and a lost executor never re-runs a finished pass.

Passes are kept in resume stores (:mod:`verdikt.plans.resume`): a rerun joins
its requests with the stored answers where they lie, without shuffling them.

A rerun of the same chain scores what has no answer yet: requests never tried,
requests whose call failed, and second-pass requests whose prompt has changed
because the first pass has a new answer. A request that still has no first
answer goes on with the default record, like one whose answer can't be read;
its pass-2 answer is replaced once a rerun brings a first answer. Answers of a
retried task are reduced last-wins, before pass 2 as well as after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.functions.dialects import with_chain_record
from verdikt.operators.dedup import last_in_place, last_wins
from verdikt.operators.inference import Scorer, score_batches
from verdikt.operators.prompts import rules_text, second_pass_prompt
from verdikt.plans.resume import ResumeStore
from verdikt.session import checkpoint_path
from verdikt.sources.logs import parse_keyed_lines

KEYS = ["model", "method", "video"]


def _score_into(requests: DataFrame, scorer: Scorer, path: str, keys: Sequence[str], **options) -> DataFrame:
    """Score the requests that the store at ``path`` doesn't answer yet and add
    them; one row per key."""
    store = ResumeStore(requests.sparkSession, path, keys)
    store.add(score_batches(store.pending(requests), scorer, key_cols=keys, **options), F.col("scored_at"))
    return store.answers()


def first_pass_from_lines(lines: DataFrame) -> DataFrame:
    """S9 + J1: a first-pass log as chain input, one row per (run, video).

    Lines that come with their place (``line_file``, ``line_at``, see
    :func:`verdikt.operators.dedup.last_in_place`) are reduced where they are read,
    others by a shuffle of the answers."""
    if {"line_file", "line_at"} <= set(lines.columns):
        lines = lines.withColumn("line_order", F.struct("line_order"))  # so that an entry's position comes with it
        rows = parse_keyed_lines(lines).where(F.col("line_status") == "ok")
        rows = rows.select(*KEYS, "response", "line_order", "line_file", "line_at", F.col("line_order.pos").alias("line_entry"))
        return last_in_place(rows, KEYS, "line_order", "line_file", "line_at", "line_entry").select(*KEYS, "response")
    rows = parse_keyed_lines(lines).where(F.col("line_status") == "ok")
    return last_wins(rows, KEYS, "line_order", ["response"]).drop("n_versions")


def second_pass_requests(first: DataFrame, rules: Sequence[str]) -> DataFrame:
    """E9 + P5 + P6: pass-2 requests (keys, prompt, prompt_id) from pass-1 answers."""
    recs = with_chain_record(first, "response")
    r = F.col("record")
    prompt = second_pass_prompt(r.getField("video_description"), r.getField("reasoning"), r.getField("anomaly"), rules_text(rules))
    out = recs.select(*KEYS, prompt.alias("prompt"))
    return out.withColumn("prompt_id", F.sha2("prompt", 256))


def two_pass_chain(
    requests: DataFrame,
    first_pass: Scorer,
    second_pass: Scorer,
    name: str,
    rules: Sequence[str],
    batch_size: int = 10,
    partitions: int | None = None,
    per_request: bool = False,
    isolate: bool = True,
) -> DataFrame:
    """Run both passes; one row per request (model, method, video, response,
    error, latency_s).

    ``requests`` holds (model, method, video, prompt). ``name`` names the
    chain's folder under the checkpoint directory, so a rerun resumes. Calls
    take ``batch_size`` requests; those of a failed call are tried one by one.
    """
    spark = requests.sparkSession
    base = checkpoint_path(spark, f"chain-{name}")
    options = {"batch_size": batch_size, "partitions": partitions, "per_request": per_request, "isolate": isolate}
    p1 = _score_into(requests.select(*KEYS, "prompt"), first_pass, f"{base}/pass1", KEYS, **options)
    second = second_pass_requests(p1, rules)
    p2 = _score_into(second, second_pass, f"{base}/pass2", [*KEYS, "prompt_id"], **options)
    # Answers to prompts of an earlier first answer are stale.
    return second.select(*KEYS, "prompt_id").join(p2, [*KEYS, "prompt_id"]).drop("prompt_id")
