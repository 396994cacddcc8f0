import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verdikt.llm import ranges


def slow(rows, step):
    """Shard of each (id, h) by walking all rows in order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    shard, out = 0, {}
    for rank, key in enumerate(order):
        if key not in out and rank:
            # A shard begins at a key that holds a multiple of step.
            last = rank + order.count(key) - 1
            shard += last // step > (rank - 1) // step
        out.setdefault(key, shard)
    return out


def tables():
    r = random.Random(5)
    h = lambda: r.randrange(-(2**63), 2**63)
    yield "dense", [(i, h()) for i in range(300)]
    yield "sparse", [(i * 1_000_000_007 - 2**60, h()) for i in range(300)]
    yield "null", [(None, h()) for _ in range(300)]
    yield "one id", [(7, h()) for _ in range(300)]
    yield "equal rows", [(7, 5)] * 300
    yield "mixed", [(r.choice([None, None, 3, 3, r.randrange(-50, 50), h()]), r.choice([1, 2, h()])) for _ in range(400)]
    yield "ends", [(-(2**63), h()), (2**63 - 1, h()), (0, -(2**63)), (None, 2**63 - 1)] * 9
    yield "one row", [(4, 4)]
    yield "none", []


@pytest.mark.parametrize("name,rows", list(tables()))
def test_shards_equal_brute_force(spark, name, rows):
    for step, parts in ((16, 1), (16, 7), (1, 3), (10_000, 2)):
        keys = spark.createDataFrame(rows, "id long, h long").repartition(parts).groupBy("id", "h").count().withColumnRenamed("count", "n")
        found = ranges.shards(keys, step)
        want = slow(rows, step)
        ids, hs = pa.array([k[0] for k in want], pa.int64()), pa.array([k[1] for k in want], pa.int64())
        assert dict(zip(want, ranges.places(found, ids, hs).tolist())) == want
        assert found.count == max(want.values(), default=0) + 1


@pytest.mark.parametrize("rows", [[(None, i) for i in range(20_000)], [(7, i) for i in range(20_000)], [(i * 1_000_003, 0) for i in range(20_000)]])
def test_no_shard_is_large(spark, rows):
    found = ranges.shards(spark.createDataFrame(rows, "id long, h long").selectExpr("id", "h", "1 AS n"), 1000)
    at = ranges.places(found, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()))
    assert found.count == 20 and set(Counter(at.tolist()).values()) == {1000}


def test_shards_grow_past_their_greatest_number(spark, monkeypatch):
    monkeypatch.setattr(ranges, "MAX_SHARDS", 8)
    keys = spark.range(1000).selectExpr("id", "0L AS h", "1 AS n")
    assert ranges.shards(keys, 10).count == 8


def test_batches_without_rows():
    none = pa.array([], pa.int64())
    assert ranges.places(ranges.Shards(*[np.zeros(0, np.int64)] * 3), none, none).tolist() == []
