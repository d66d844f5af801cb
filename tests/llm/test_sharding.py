import random
import zlib
from collections import defaultdict
from hashlib import md5

import numpy as np
import pytest

from ledgerloom.llm import sharding
from ledgerloom.llm.registry import op2_sharding
from ledgerloom.llm.sharding import capacity_of, greedy, shard


def brute(rows, shards):
    groups = defaultdict(int)
    for _, t in rows:
        t = (t or "").encode()
        groups[md5(t).hexdigest()] += len(t) + 1
    keys = sorted(groups)
    sizes = [groups[k] for k in keys]
    low, high = max(sizes, default=0), sum(sizes)

    def fill(c):
        at, used, out = 0, 0, {}
        for k, s in zip(keys, sizes):
            if used + s > c:
                at, used = at + 1, 0
            used += s
            out[k] = at
        return out, at < shards

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(mid)[1] else (mid + 1, high)
    where = fill(low)[0]
    return [(d, t, where[md5((t or "").encode()).hexdigest()]) for d, t in rows]


def check(got, rows, shards):
    assert sorted(((r.doc_id, r.text_crc32, r.shard) for r in got), key=str) == sorted(((d, zlib.crc32((t or "").encode()), s) for d, t, s in brute(rows, shards)), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("seed,shards,digits", [(0, 8, 4), (1, 8, 1), (2, 3, 1), (3, 5, 2)])
def test_against_brute_force(spark, monkeypatch, seed, shards, digits):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.choice([0, 5, 300, 4000]) + str(rng.randrange(120))) for i in range(400)]
    monkeypatch.setattr(sharding.cut_keys, "__defaults__", (digits, 2))
    check(shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect(), rows, shards)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100_000), (3, "é" * 100_000), (None, "a"), (None, "a"), (4, "b")]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, shard int, g string")
    got = shard(df).collect()
    check(got, rows, 8)
    assert {r.doc_id: r["size"] for r in got}[3] == 200_001
    assert shard(df.limit(0)).count() == 0


def test_capacity():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(1, 50, rng.integers(1, 30))
        c = capacity_of(s, 4)
        assert greedy(np.cumsum(s), c, 4) and (c == s.max() or not greedy(np.cumsum(s), c - 1, 4))


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op2_sharding(spark, d).collect()
    check(got, rows, 8)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
