import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import drawn, mix, split_quotas, targets
from ledgerloom.llm.registry import op1_mixing


def test_targets():
    assert targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert targets([], []) == []
    assert targets([0, 10], [3, 1]) == [0.0, 15.0]
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 1000, 12).tolist()
        t = targets(sizes, [float(3 if i % 3 == 0 else i % 3) for i in range(12)])
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))


def test_splitting_tree_is_exact():
    q = np.array([5, 0, 1000, 33, 7])
    for shards in (1, 2, 3, 16):
        s = split_quotas(q, shards, np.random.default_rng(1))
        assert s.shape == (shards, 5) and (s.sum(0) == q).all() and (s >= 0).all()
        assert s.sum(1).max() - s.sum(1).min() <= 1


def plain_targets(sizes):
    """The contract's rule, restated: raise the unit until the capped shares make up 150 % of all words."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(2 * n, w * unit) for n, w in zip(sizes, weights)) < 1.5 * sum(sizes) else (low, unit)
    return [min(2.0 * n, w * high) for n, w in zip(sizes, weights)]


def test_targets_against_the_rule():
    rng = np.random.default_rng(3)
    for _ in range(100):
        sizes = rng.integers(0, 1000, rng.integers(1, 9)).tolist()
        assert targets(sizes, [float((3, 1, 2)[i % 3]) for i in range(len(sizes))]) == pytest.approx(plain_targets(sizes), abs=1e-6)


def test_clashing_columns_and_local_shuffle(spark):
    rows = [(i, f"w{i} " * 20, f"s{i % 3}", f"own{i}", i, "p") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Shard string, epoch int, mix string")
    m = mix(df, shards=4)
    assert m.columns == [*df.columns, "mix_"]
    out = drawn(m, shards=4)
    assert out.columns == [*df.columns, "shard_", "epoch_", "place"]
    got = [r.asDict() | {"at": r.at} for r in out.withColumn("at", F.spark_partition_id()).collect()]
    assert {r["Shard"] for r in got} <= {f"own{i}" for i in range(3000)} and all(r["Shard"] == f"own{r['doc_id']}" for r in got)
    assert [(r["shard_"], r["place"]) for r in got] == sorted((r["shard_"], r["place"]) for r in got)
    assert all(r["at"] // 4 == r["shard_"] for r in got) and len({r["at"] for r in got}) == 16
    near = np.mean([a["source"] == b["source"] for a, b in zip(got, got[1:])])
    assert near < 0.5


def test_registered_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op1_mixing(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, op1_mixing(spark, d).collect()))
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = {k: len(v.text.encode().split()) for k, v in docs.items()}
    sources = sorted({v.source for v in docs.values()})
    sizes = [sum(size[k] for k, v in docs.items() if v.source == s) for s in sources]
    want = dict(zip(sources, plain_targets(sizes)))
    taken = dict.fromkeys(sources, 0)
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sizes[sources.index(s)] and r.target == pytest.approx(want[s])
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s]


def test_edge_rows(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (2, None, "s", 1), (3, "", None, 1), (None, "x y", None, 1), (4, "z " * 50_000, "é", 1), (5, "q", "empty", None), (6, " \t", "blank", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long")
    m = mix(df, shards=3)
    assert m.columns == [*df.columns, "mix"]
    got = m.select("doc_id", "text", "source", "mix.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.taken == r["size"] * len(r.draws) and r.taken <= 2 * r["size"]
    out = drawn(m, shards=3)
    assert out.columns == [*df.columns, "shard", "epoch", "place"]
    assert out.count() == sum(len(r.draws) for r in got)
    assert mix(df.limit(0)).count() == 0
