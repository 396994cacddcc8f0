"""Batched scoring as a dataflow operator.

The model call is the only Python that runs on executors: ``mapInPandas``
hands Arrow batches of requests to an injected scorer. There is no network
here, so the offline default is *replay*: requests are joined to a stored
response log. A deterministic text scorer stands in for a live model in
tests and in the registered query.

Fault tolerance: a retried task re-scores its rows, so scoring is
at-least-once; the response log is deduplicated last-wins downstream (J1),
which makes duplicates harmless. ``pending`` (anti join against the log)
gives the resume set after a crash.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORED_COLS = "response string, error string, latency_s double, batch_id long, scored_at double"

Scorer = Callable[[pd.DataFrame], Sequence[str | None]]

# I4: what a failed call leaves behind.
FAILURE_POLICIES = ("null", "raise", "text")


class SharedRate:
    """A task's share of a rate that all tasks of a barrier stage keep to.

    A thread tells the other tasks, about once a second, whether this one still
    has requests, and sets the share from their answers; calls go on meanwhile.
    """

    def __init__(self, max_rps: float):
        self.context, self.max_rps = BarrierTaskContext.get(), max_rps
        self.share = max_rps / len(self.context.getTaskInfos())
        self.last, self.sent = -math.inf, 0  # the last call, and how many requests it sent
        self.busy = True
        self.thread = threading.Thread(target=self._gather, daemon=True)
        self.thread.start()

    def _gather(self) -> None:
        while n := self.context.allGather("1" if self.busy else "0").count("1"):
            self.share = self.max_rps / n
            time.sleep(0.05)

    def wait(self, n: int) -> None:
        """Until a call of ``n`` requests may start."""
        while (left := self.last + self.sent / self.share - time.monotonic()) > 0:
            time.sleep(min(left, 0.1))  # the share may have grown by then
        self.last, self.sent = time.monotonic(), n

    def leave(self) -> None:
        """No more requests: keep the others company until they are done."""
        self.busy = False
        self.thread.join()


def score_batches(
    requests: DataFrame,
    scorer: Scorer,
    batch_size: int = 10,
    partitions: int | None = None,
    max_rps: float | None = None,
    key_cols: Sequence[str] = ("model", "method", "video"),
    text_col: str = "prompt",
    on_error: str = "null",
    per_request: bool = False,
    isolate: bool = False,
    deal_by: Sequence[str] = (),
    clock: Callable[[], float] = time.perf_counter,
) -> DataFrame:
    """Score requests in batches on the executors.

    Returns the ``key_cols`` (strings), response, error, latency_s, batch_id and
    scored_at (seconds since the epoch). ``partitions`` caps the concurrency (one batch stream per task);
    ``batch_size`` is the number of requests handed to one scorer call
    (Arrow batches are cut to that size inside the task).

    ``max_rps`` (I3) bounds the requests per second of the whole job. The
    ``partitions`` tasks, which must then be given and have a slot each, run as
    one barrier stage: about once a second they tell each other who still has
    requests and share the rate among those, so what a finished task would have
    had goes to the others.

    ``deal_by`` names columns whose values stay together in a task (e.g. the
    model); else requests are dealt evenly.

    ``on_error`` (I4) says what a scorer exception does to its batch: ``null``
    leaves a NULL ``response`` and the ``error``; ``text`` puts the error's
    text into ``response`` as well (logs of some runs hold it); ``raise`` fails
    the task. Only the error column marks a failure.

    ``latency_s`` (I5) is the wall time of the call divided over its batch;
    with ``per_request`` every request is a call of its own and timed by itself.
    ``clock`` gives the seconds. ``isolate`` calls the requests of a failed batch
    again one by one, so that only those that fail by themselves are failures.
    """
    if on_error not in FAILURE_POLICIES:
        raise ValueError(f"on_error={on_error!r}")
    if max_rps and not partitions:
        raise ValueError("max_rps is shared out over the tasks: give partitions")
    df = requests.select(*key_cols, text_col)
    if partitions:
        df = df.repartition(partitions, *deal_by)
    keys = list(key_cols)
    step = 1 if per_request else batch_size

    def call(pdf: pd.DataFrame) -> tuple[list, str | None, float]:
        """Answers, error and time of one call; a failed call has no answers."""
        t0 = clock()
        try:
            return list(scorer(pdf)), None, clock() - t0
        except Exception as e:
            if on_error == "raise" and not (isolate and len(pdf) > 1):
                raise
            return [], f"{type(e).__name__}: {e}", clock() - t0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rate = SharedRate(max_rps) if max_rps else None
        number = 0
        for whole in batches:
            # One frame out for each that came in; calls fill its columns.
            out = {c: [] for c in ("response", "error", "latency_s", "batch_id", "scored_at")}
            todo = [(k, min(k + step, len(whole))) for k in range(0, len(whole), step)][::-1]
            while todo:
                a, b = todo.pop()
                n = b - a
                if rate:
                    rate.wait(n)
                texts, err, took = call(whole.iloc[a:b])
                if err is not None and isolate and n > 1:
                    todo += [(k, k + 1) for k in range(a, b)][::-1]
                    continue
                out["response"] += texts if err is None else [err if on_error == "text" else None] * n
                out["error"] += [err] * n
                out["latency_s"] += [took / n] * n
                out["batch_id"] += [number] * n
                out["scored_at"] += [time.time()] * n
                number += 1
            yield pd.DataFrame({k: whole[k].to_numpy() for k in keys} | out)
        if rate:
            rate.leave()

    return df.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", " + SCORED_COLS, barrier=bool(max_rps))


def pending(requests: DataFrame, log: DataFrame, keys: Sequence[str] = ("model", "method", "video")) -> DataFrame:
    """Resume set: requests that have no answer in the log yet. Failed calls
    (rows with an ``error``) are no answers."""
    done = log.where(F.col("error").isNull()) if "error" in log.columns else log
    return requests.join(done.select(*keys), list(keys), "left_anti")


def replay(requests: DataFrame, latest_log: DataFrame, keys: Sequence[str] = ("model", "method", "video"),
           value_cols: Sequence[str] = ("response",)) -> DataFrame:
    """Answer requests from a stored, deduplicated response log.

    Left join: a request without a stored answer keeps NULL values and
    ``answered = false``.
    """
    log = latest_log.select(*keys, *value_cols).withColumn("answered", F.lit(True))
    j = requests.join(log, list(keys), "left")
    return j.withColumn("answered", F.coalesce(F.col("answered"), F.lit(False)))


def clean_video_name(name_col: str = "video") -> F.Column:
    """Part after the last '/', '.mp4' removed."""
    return F.replace(F.substring_index(F.col(name_col), "/", -1), F.lit(".mp4"), F.lit(""))


RESOLUTION_S = 0.001


def latency_stats(latency: DataFrame, group_cols: Sequence[str] = ("model", "method"), value_col: str = "latency_s",
                  resolution: float = RESOLUTION_S, extra: Sequence[Column] = ()) -> DataFrame:
    """Per run count, mean, median / p90 and max of the latency, in one scan.

    Latencies are counted on a grid of ``resolution`` seconds, and a quantile is
    the grid value below the smallest latency that has the requested share at
    or below it. The grid is exact and mergeable at any number of rows: a run
    holding a third of all calls aggregates map-side to its distinct grid values.
    ``extra`` are further aggregates of a group that merge by min or max.
    """
    v = F.col(value_col)
    step = F.floor(v / F.lit(resolution)).cast("long")
    names = [f"_x{i}" for i in range(len(extra))]
    grid = latency.where(v.isNotNull()).groupBy(*group_cols, step.alias("_step")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_sum"), F.max(v).alias("_max"), *[x.alias(n) for x, n in zip(extra, names)]
    )
    w = Window.partitionBy(*group_cols)
    grid = grid.withColumn("_upto", F.sum("_n").over(w.orderBy("_step"))).withColumn("_all", F.sum("_n").over(w))
    at = lambda share: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(share)), F.col("_step"))) * F.lit(resolution)
    return grid.groupBy(*group_cols).agg(
        F.sum("_n").alias("n"),
        F.round(F.sum("_sum") / F.sum("_n"), 6).alias("avg_s"),
        F.round(at(0.5), 9).alias("p50_s"),
        F.round(at(0.9), 9).alias("p90_s"),
        F.max("_max").alias("max_s"),
        *[F.struct(F.min(n).alias("low"), F.max(n).alias("high")).alias(n) for n in names],
    )
