import gzip
import hashlib
from collections import Counter

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdikt.llm import warc as w
from verdikt.llm.common import scratch

PAGES = "page_id long, url string, html string, refers_to string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "theirs", "theirs") for r in rows], PAGES)


def awkward():
    big = "<p>été " * 60_000
    rows = [(i, f"http://h/{i}", f"<p>page {i} " + "x" * (40 * i)) for i in range(60)]
    rows += [(100 + i, "http://h/copy", "same text " * 20) for i in range(30)]
    rows += [(200 + i, None, "short") for i in range(3)]
    rows += [(300, "http://h/a b\r\nWARC-Type: x", big), (301, "http://h/é", None), (302, "", ""), (9000, "u", big), (-5, "u", "same text " * 20)]
    rows += [(400, "u", "tied " * 50), (400, "u", "tied " * 50), (400, "v", "tied " * 51), (None, "u", "same text " * 20), (None, "u", "none " * 50), (None, "u", "none " * 50)]
    return rows


def slow(rows):
    first, seen, out = {}, Counter(), []
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (h or "").encode()
        to = first[h] if h in first and i is not None and (first[h] < i or seen[i, h]) else None
        seen[i, h] += 1
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return Counter(out)


def read(spark, folder):
    return [tuple(r) for r in w.read_warc(spark, folder).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()]


def test_round_trip_equals_brute_force(spark):
    rows, folder = awkward(), scratch(spark, "warc")
    manifest = w.write_warc(frame(spark, rows), folder, ids_per_shard=16, roll=2000).collect()
    got = read(spark, folder)
    assert Counter(r[:5] for r in got) == slow(rows)
    assert Counter(r[5] for r in got if r[3] == "response") == Counter(h for (i, n, h, k, t), c in slow(rows).items() if k == "response" for h in [next((x[2] or "").encode() for x in rows if hashlib.sha256((x[2] or "").encode()).hexdigest() == h)] for _ in range(c))
    assert max(m["seq"] for m in manifest) > 0
    fs, root = w.file_system(folder)
    for m in manifest:
        data = fs.open_input_stream(f"{root}/{m['name']}", compression=None).read()
        assert len(data) == m["bytes"] and hashlib.sha256(data).hexdigest() == m["sha256"]
        assert m["bytes"] <= 2000 or m["records"] == 1
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.NotFound


def test_archives_do_not_depend_on_partitions(spark):
    rows, sums = awkward(), []
    for n, rev in ((1, False), (7, True)):
        folder = scratch(spark, "warc")
        df = frame(spark, rows[::-1] if rev else rows).repartition(n)
        sums.append(sorted((m["name"], m["sha256"]) for m in w.write_warc(df, folder, ids_per_shard=64, roll=5000).collect()))
    assert sums[0] == sums[1]


def test_commit_twice_and_missing_file(spark):
    folder = scratch(spark, "warc")
    w.write_warc(frame(spark, awkward()), folder)
    listed = spark.read.schema(w.MANIFEST).parquet(f"{folder}/_written")
    assert listed.mapInArrow(w.committer(folder), w.MANIFEST).count() == listed.count()
    fs, root = w.file_system(folder)
    fs.delete_file(f"{root}/{listed.first()['name']}")
    with pytest.raises(Exception, match="neither its temporary nor its final"):
        listed.mapInArrow(w.committer(folder), w.MANIFEST).count()


def test_damage_is_found(spark):
    folder = scratch(spark, "warc")
    m = w.write_warc(frame(spark, awkward()[:5]), folder).first()
    fs, root = w.file_system(folder)
    raw = gzip.decompress(fs.open_input_stream(f"{root}/{m['name']}", compression=None).read())
    with fs.open_output_stream(f"{root}/{m['name']}", compression=None) as f:
        f.write(gzip.compress(raw.replace(b"page 3", b"page 4")))
    with pytest.raises(Exception, match="damaged"):
        w.read_warc(spark, folder).count()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.binary(max_size=200))
def test_records_read_back(url, payload):
    import io

    digest = hashlib.sha256(payload).hexdigest()
    data = w.page_record(7, url, payload, digest, 0, None) + w.page_record(8, url, payload, digest, 0, 7)
    got = list(w.records(io.BytesIO(gzip.decompress(data))))
    assert [h["WARC-Type"] for h, _ in got] == ["response", "revisit"]
    assert got[0][1].partition(b"\r\n\r\n")[2] == payload and got[1][0]["WARC-Refers-To"] == got[0][0]["WARC-Record-ID"]


def test_empty_table(spark):
    folder = scratch(spark, "warc")
    assert w.write_warc(frame(spark, []), folder).count() == 0
    assert w.read_warc(spark, folder).count() == 0


@pytest.mark.parametrize("id_of", [lambda i: i * 1_000_000_007, lambda i: None, lambda i: 7])
def test_any_ids_make_shards_of_equal_size(spark, id_of):
    """Sparse ids, none at all, and one id for all rows."""
    rows, folder = [(id_of(i), "u", f"page {i} " + "x" * 200) for i in range(6000)], scratch(spark, "warc")
    manifest = w.write_warc(frame(spark, rows), folder, ids_per_shard=500).collect()
    sizes = Counter()
    for m in manifest:
        sizes[m["shard"]] += m["records"]
    assert sorted(sizes) == list(range(12)) and set(sizes.values()) == {500}
    assert Counter(r[:5] for r in read(spark, folder)) == slow(rows)
