import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import ngram_join, oracles
from ledgerloom.llm.ngram_join import _signature, may_link, needed, ngram_classes, one_of_each, overlaps, shingle_hashes, words_of
from ledgerloom.llm.registry import op10_ngram_join


def brute(rows, num=75, den=100):
    """{doc_id: (n, component)} for distinct non-null ids."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = w + passage[: rng.randrange(60)]
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize("limit,block", [(64, 512), (3, 4)])
def test_against_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(ngram_join, "LIST", limit)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(260, limit)
    got = ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_long_posting_list_at_default_settings(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(1 + i % 25))) for i in range(3 * ngram_join.LIST)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and 1 < len({c for _, c in got.values()}) < len(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (4, "A b", 0), (5, "a  B", 0), (6, "a b c d e", 0), (6, "a b c d e", 0), (7, "A B C D E", 0), (None, "a b c d e", 0), (8, long, 0), (9, long + " y", 0), (10, "é b c d e", 0), (11, "É b c d e", 0), (None, "lonely words here", 0), (12, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_classes(df).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 6), (None, 1, 6), (8, 29_996, 8), (9, 29_997, 8), (10, 1, 10), (11, 1, 11), (None, 1, None), (12, 1, 12)]
    assert got == sorted(want, key=str)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, 10, 11, None, 12], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_classes(df).count() == 0 and one_of_each(df).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.lists(st.integers(0, 300), max_size=60))
def test_bitmaps_never_reject_a_link(a, b):
    x, y = (np.unique(np.array([hash((v, 7)) & (2**64 - 1) for v in s], np.uint64)) for s in (a, b))
    if len(x) and len(y):
        c = len(np.intersect1d(x, y))
        if 100 * c >= 75 * (len(x) + len(y) - c):
            assert may_link(len(x), _signature(x), len(y), _signature(y), 75, 100)
            assert c >= needed(len(x), 75, 100)
        assert overlaps([x], [y])[0, 0] == c


def test_words():
    assert words_of("A b\x0bC\x1cd É") == ["a b".encode(), b"c\x1cd", "É".encode()]
    assert len(shingle_hashes(words_of("a a a a a a a"))) == 1


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{d}/documents.parquet'")
    want = duckdb.sql(oracles.NGRAM_JOIN).fetchall()
    assert sorted(map(tuple, op10_ngram_join(spark, d).collect())) == sorted(want)


def test_common_passage_ties_nothing_where_cells_are_crowded(spark, monkeypatch):
    """On large inputs every cell of the count table is as full as any other."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        own = [f"u{rng.randrange(10**9)}" for _ in range(200)]
        rows.append((i, " ".join(own[:100] + passage + own[100:])))
    rows += [(240 + i, rows[i][1] + " and a few more") for i in range(5)]
    real, counted = ngram_join.stored, {}

    def noted(df, name):
        out = real(df, name)
        counted[name] = out.count()
        return out

    def flat(df, slots, bits, name):
        return np.full(1 << bits, 900) if name == "shingles" else counts(df, slots, bits, name)

    counts = ngram_join.summed
    monkeypatch.setattr(ngram_join, "stored", noted)
    monkeypatch.setattr(ngram_join, "summed", flat)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_classes(docs).collect()}
    assert found == brute(rows)
    assert counted["members"] == 10  # the five linked pairs, not all 245 texts


def test_common_shingles_count_equal_texts_once(spark):
    rng = random.Random(6)
    line = "one line that very many of the documents have in common"
    rows = [(i, f"{line} {rng.random()} {rng.random()}") for i in range(400)] + [(1000 + i, "a text of which there are a lot of equal copies") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) as hash")
    common, ranks = ngram_join._common(docs, 5)
    assert set(shingle_hashes(words_of(line)).tolist()) <= set(common.tolist())
    assert not set(shingle_hashes(words_of(rows[-1][1])).tolist()) & set(common.tolist())
    assert (np.diff(common.astype(object)) > 0).all() and ranks.min() >= ngram_join.RANKS
    empty, none = ngram_join._common(docs.limit(0), 5)
    assert len(empty) == len(none) == 0
