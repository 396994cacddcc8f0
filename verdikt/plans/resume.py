"""Answers of a scoring pass that survive a crash and are resumed without a
shuffle of what is stored (I8, S9).

A store is a folder of runs. A run writes its answers and failed calls once, as
a table bucketed by a digest of the keys, one row a key. A key is
scored again only while it has no answer, so answers of different runs never
share a key: stored answers are their union, and nothing has to be folded.

A rerun looks up its requests by anti joins with the runs' tables. Requests are
shuffled by key into as many partitions as there are buckets; the tables are
read as they lie. The number of buckets is the store's own, fixed by its first
run, so later sessions with other settings read it the same way.

A run that dies before its marker is written is no run: its files are not read,
and its calls are made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.sqltext import ident, lit
from verdikt.operators.dedup import last_wins
from verdikt.session import child_files, create_file

ANSWER = ["response", "error", "latency_s"]
DIGEST = "_key_digest"


class ResumeStore:
    """The answers below ``path``, by ``keys`` (strings)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int | None = None):
        self.spark, self.path, self.keys = spark, path, list(keys)
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Of several first runs one fixes the number.
        create_file(spark, f"{path}/store.json", json.dumps({"buckets": n}))
        self.buckets = json.loads(spark.read.text(f"{path}/store.json").first()[0])["buckets"]

    def _schema(self) -> str:
        return f"{DIGEST} STRING, " + ", ".join(f"{ident(k)} STRING" for k in self.keys) + ", response STRING, error STRING, latency_s DOUBLE"

    def _digested(self, df: DataFrame) -> DataFrame:
        """With the one column that rows are dealt and joined by. (Key columns
        may be constant, which Spark would take out of a partitioning.)"""
        return df.withColumn(DIGEST, F.sha2(F.to_json(F.array(*self.keys)), 256))

    def _table(self, run: str) -> DataFrame:
        """A run's table as it lies. The catalog entry only tells Spark about the
        buckets and is dropped once the frame knows them; files stay."""
        name = f"resume_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({self._schema()}) USING parquet CLUSTERED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION {lit(f'{self.path}/rows-{run}')}"
        )
        df = self.spark.table(name)
        df.schema  # noqa: B018  (resolved before the entry goes)
        self.spark.sql(f"DROP TABLE {name}")
        return df

    def runs(self) -> list[str]:
        """Finished runs, oldest first."""
        return [n.partition("-")[2] for n in child_files(self.spark, f"{self.path}/done")]

    def pending(self, requests: DataFrame) -> DataFrame:
        """The requests that no run has answered."""
        todo = self._digested(requests)
        for run in self.runs():
            todo = todo.join(self._table(run).where("error IS NULL").select(DIGEST).hint("shuffle_hash"), DIGEST, "left_anti")
        return todo.drop(DIGEST)

    def add(self, scored: DataFrame, order: Column) -> None:
        """Write a run: of several rows of a key (a retried task scores its rows
        again) the last answer, or the last failure if there is none."""
        run = uuid.uuid4().hex
        best = F.struct(F.col("error").isNull().alias("answered"), order.alias("at"))
        rows = last_wins(scored.withColumn("_order", best), self.keys, "_order", ANSWER).select(*self.keys, *ANSWER)
        dealt = self._digested(rows).select(DIGEST, *self.keys, *ANSWER).repartition(self.buckets, DIGEST)
        name = f"resume_{uuid.uuid4().hex}"
        dealt.write.bucketBy(self.buckets, DIGEST).option("path", f"{self.path}/rows-{run}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        create_file(self.spark, f"{self.path}/done/{len(self.runs()):09d}-{run}", "")

    def answers(self) -> DataFrame:
        """One row per key: its answer, or the failure of the last run that tried
        it (a run tries every key that has no answer)."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self._schema()).drop(DIGEST)
        out = self._table(runs[-1]).where("error IS NOT NULL")
        for run in runs:
            out = out.unionByName(self._table(run).where("error IS NULL"))
        return out.drop(DIGEST)
