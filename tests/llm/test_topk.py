import math

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import oracles, topk
from ledgerloom.llm.registry import op9_topk
from ledgerloom.llm.topk import KDTree, top_k


def brute(rows, k=5, every=50):
    v = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, [math.floor(256 * c) for c in x]))
    found = {}
    for q, x in {(i, tuple(x)) for i, x in v if i % every == 0}:
        found.setdefault(q, []).extend((-sum(a * b for a, b in zip(x, y)), i) for i, y in v if i != q and len(y) == len(x))
    return sorted((q, r + 1, i, -n) for q, s in found.items() for r, (n, i) in enumerate(sorted(s)[:k]))


@pytest.mark.parametrize("shard,leaf,queries", [(16_384, 256, 2048), (40, 4, 3)])
def test_against_brute_force(spark, monkeypatch, shard, leaf, queries):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(KDTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.choice([-0.5, 0.0, 0.25, 1.0], 6).tolist()) for i in rng.permutation(900)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [math.nan, 1.0]), (150, [math.inf, 1.0]), (1, [None, 1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (200, [2.0]), (None, [1.0, 1.0]), (4, []), (250, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)
    assert top_k(df.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 7919) % 1000) * 8e3 + i, 70_000.0, -1.0]) for i in range(120)] + [(50, [70_000.0, 1.0]), (1, [70_000.0, 1.0]), (100, []), (7, []), (8, [])]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in rows], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df.where("vec_id < 1000 and size(embedding) <> 3 or vec_id % 3 <> 1"), k=3).collect())) == brute([r for r in rows if len(r[1]) != 3 or r[0] % 3 != 1], k=3)


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(50, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        top_k(df).collect()


def test_copies_of_one_row(spark):
    rows = [(1, [1.0, 1.0])] * 40 + [(50, [1.0, 1.0])] * 9 + [(2, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)


def test_registered_query(spark):
    d = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{d}/embeddings.parquet'")
    assert sorted(map(tuple, op9_topk(spark, d).collect())) == sorted(duckdb.sql(oracles.TOPK).fetchall())
