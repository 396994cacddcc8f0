"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id. A shard holds ``IDS_PER_SHARD`` records or
so, from one rank to another (``verdikt.llm.ranges``), and is a task's work, so
what an archive holds depends on the rows alone, never on the cluster, and tasks
grow in number with the rows, whatever the ids are. A shard rolls to a next
file when the compressed size would pass ``ROLL_BYTES``. All headers and digests
are made anew from the payload; every record is a gzip member of its own,
without a time stamp.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one with
the smallest id is the response, the others are revisits of it. Who revisits
whom is settled on digests alone; the verdicts travel as small rows through the
one shuffle that also sorts the payloads.

Commit: tasks write under temporary names of their own and return manifest
rows, which Spark's committer keeps for successful attempts only. A second job
renames what the manifest lists (renaming again is harmless), and the manifest
is published last, so readers never see a half-written archive. Files are
written with pyarrow's file systems to the shared folder, so any store they
know works (local or mounted paths, hdfs, s3, gs).

Defined cases: a null payload is empty. Rows with a null id come first, ordered
and dealt by payload; they are never referred to nor revisits. Of rows that
repeat an id and payload, which are always in one shard, the first is the
response. A null address has no target header. An
empty table gives an empty manifest and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.common import col, discard, partitions, prepare, salted_lookup, saved, scratch, table, utf8
from verdikt.llm.ranges import shard_of, shards

IDS_PER_SHARD = 4096
ROLL_BYTES = 4 << 20
FILES_PER_TASK = 16  # read back by a task
REVISIT_FROM = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard long, seq int, name string, temporary string, bytes long, records long, sha256 string"
RECORDS = "id long, target string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def header_value(s: str) -> str:
    """An address without characters that would end or split a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'null' if page is None else page}:{digest[:16]}:{copy}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("WARC-Block-Digest", block_digest(block)), ("Content-Length", str(len(block)))] if v is not None]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else header_value(url)),
        ("WARC-Payload-Digest", "sha256:" + digest),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record(common, head + payload)
    return record([*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0))], head)


class ShardFiles:
    """The files of one shard in one task attempt, under temporary names."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.root = file_system(folder)
        self.attempt, self.roll, self.rows = uuid.uuid4().hex, roll, []
        self.shard, self.out = None, None

    def begin(self, shard: int) -> None:
        self.end()
        self.shard, self.seq = shard, -1

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll:
            self.end()
        if self.out is None:
            self.seq += 1
            self.name = f"shard-{self.shard:012d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.count, self.sha = 0, 0, hashlib.sha256()
            self.put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.put(member)
        self.count += 1

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.seq, self.name, self.temporary, self.size, self.count, self.sha.hexdigest()))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*self.rows)) or [[]] * len(kinds)
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def shard_writer(folder: str, roll: int):
    """Sorted rows (shard, id, digest, refers_to, url, payload) -> files and manifest rows.
    A row without payload says that the record of its id and digest revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ShardFiles(folder, roll)
        verdict = last = None
        copy = 0
        for b in batches:
            shards, ids, digests, refers, urls = (b.column(i).to_pylist() for i in range(5))
            for shard, page, digest, first, url, payload in zip(shards, ids, digests, refers, urls, utf8(b.column(5))):
                if payload is None:
                    verdict = (page, digest, first)
                    continue
                if shard != files.shard:
                    files.begin(shard)
                    if len(files.rows) > 100:
                        yield files.manifest()
                copy = copy + 1 if last == (shard, page, digest) else 0
                last = (shard, page, digest)
                to = None
                if page is not None and len(payload) >= REVISIT_FROM:
                    to = verdict[2] if verdict and verdict[:2] == (page, digest) else page if copy else None
                files.add(page_record(page, url, payload, digest.hex(), copy, to))
        files.end()
        yield files.manifest()

    return run


def committer(folder: str):
    """Rename the manifest's files to their final names; safe to run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            for r in b.to_pylist():
                there = fs.get_file_info([f"{root}/{r['temporary']}", f"{root}/{r['name']}"])
                if there[0].type == pafs.FileType.File:
                    fs.move(there[0].path, there[1].path)
                elif there[1].type != pafs.FileType.File or there[1].size != r["bytes"]:
                    raise FileNotFoundError(f"{r['name']}: neither its temporary nor its final file is there")
            yield b

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ids_per_shard: int = IDS_PER_SHARD, roll: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row below ``folder``; returns the published manifest."""
    spark = prepare(pages.sparkSession)
    text = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("long").alias("id"), col(url_col).cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Who revisits whom and where shards begin are settled on keys; payloads are read again after.
    large = F.octet_length("payload") >= REVISIT_FROM
    keys = saved(rows.groupBy("id", "digest").agg(F.count("*").alias("n"), F.first(large).alias("large")).withColumn("h", F.xxhash64("digest")), "keys")
    found = shards(keys, ids_per_shard)
    narrow = keys.where("large AND id IS NOT NULL").select("id", "digest")
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("most")).where("most > refers_to").drop("most")
    verdicts = salted_lookup(narrow, first, ["digest"]).where("refers_to < id")
    none = F.lit(None).cast("string")
    x = rows.select("id", "digest", F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    x = x.unionByName(verdicts.select("id", "digest", "refers_to", none.alias("url"), none.alias("payload")))
    x = x.select(shard_of(found, F.col("id"), F.xxhash64("digest")).alias("shard"), "*")
    x = x.repartitionById(found.count, F.col("shard").cast("int"))
    x = x.sortWithinPartitions("shard", "id", F.xxhash64("digest"), "digest", F.col("payload").isNotNull(), "url")
    made = x.mapInArrow(shard_writer(folder, roll), MANIFEST)
    listed = f"{folder}/_written"
    made.write.parquet(listed)
    discard(keys)
    done = spark.read.schema(MANIFEST).parquet(listed).mapInArrow(committer(folder), MANIFEST)
    done.write.parquet(f"{folder}/_manifest")
    fs, root = file_system(folder)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of an archive, one record in memory at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n" or headers["WARC-Block-Digest"] != block_digest(block):
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, block


def archive_reader(folder: str, with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def number(urn: str) -> int | None:
        x = urn.split(":")[2]
        return None if x == "null" else int(x)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for h, block in records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        refers = h.get("WARC-Refers-To")
                        if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
                        rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], size, digest, refers and number(refers), payload if with_payload and refers is None else None))
                        if len(rows) >= 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The page records of a published archive. Block and payload digests are checked."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("name")
    tasks = max(partitions(spark), -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks, "name").mapInArrow(archive_reader(folder, with_payload), RECORDS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    x = read_warc(spark, folder, with_payload=False)
    return x.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM r
"""
