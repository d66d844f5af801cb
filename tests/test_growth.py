"""Records, truths and similar texts whose work must not grow with the square of a group."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import provenance as P, records, truth as T


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _mentions(spark, n=400):
    r = random.Random(5)
    rows = [(f"m{i:03d}", r.randrange(4), f"2020-01-{1 + r.randrange(4):02d}", r.choice([-1, 1, 1, 1]) * r.random() * 10 ** r.randrange(4)) for i in range(n)] + [("z0", 1, None, 3.0), ("z1", 1, "2020-01-01", None)]
    return spark.createDataFrame(rows, "mention_id string, entity long, date string, number double").withColumn("date", F.to_date("date"))


def test_components_of_links_without_links(spark):
    m = _mentions(spark)
    for tau in (0.6, 0.75, 0.9, 0.99):
        want = records.record_components(m, records.record_links(m, tau))
        assert sorted(records.components_at(m, tau).collect()) == sorted(want.collect())
    assert "Join" not in _plan(records.components_at(m, 0.85))


def test_repeated_mentions_connect_both_places(spark):
    m = spark.createDataFrame([("a", 1, "2020-01-01", 5.0), ("b", 1, "2020-01-01", 5.0), ("b", 1, "2020-03-01", 7.0), ("c", 1, "2020-03-01", 7.0)], "mention_id string, entity long, date string, number double").withColumn("date", F.to_date("date"))
    assert {(r.mention_id, r.record) for r in records.components_at(m, 0.85).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert [r.records for r in records.sweep_at(m, [0.85]).collect()] == [1]


def test_sweep_of_a_day_of_many_mentions(spark):
    """20,000 mentions of a day are 200 million links."""
    m = spark.range(20_000).selectExpr("id as mention_id", "1 as entity", "date'2020-01-01' as date", "cast(pow(2, id % 20) as double) as number")
    assert {r.tau: r.records for r in records.sweep_at(m, [0.75, 0.97]).collect()} == {0.75: 1, 0.97: 20}


def test_sweep_is_that_of_the_links(spark):
    m, taus = _mentions(spark), [0.6, 0.75, 0.9, 0.97]
    want = records.threshold_sweep(m, records.record_links(m, 0.5), taus)
    assert sorted(records.sweep_at(m, taus).collect()) == sorted(want.collect())


def test_amounts_of_many_entities_meet_in_batches(spark):
    f = spark.range(3_000).selectExpr("id % 1500 as entity", "id", "cast(100 + id % 7 as double) as amount")
    got = T.aligned_by_amount(f, f.selectExpr("entity", "id + 1 as key", "amount"))
    assert "FlatMapGroupsInPandas" not in _plan(got)
    rows = got.collect()
    assert len(rows) == len({(r.entity, r.id) for r in rows}) == len({(r.entity, r.key) for r in rows}) == 3_000
    assert all(r.key == r.id + 1 for r in rows if r.id % 7 != (r.id + 1500) % 7)


def test_copies_are_no_pairs_before_the_end(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(50)] + [(90 + i, text + " more" * i) for i in range(1, 3)] + [(99, "too short"), (100, "too short"), (101, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    pairs, copies = P.similar_texts(docs)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, 91), (0, 92), (91, 92)]
    assert sorted(map(tuple, copies.collect())) == [(i, 0) for i in range(1, 50)]
    got = {(r.a, r.b): r.similarity for r in P.similar_pairs(docs).collect()}
    assert len(got) == 50 * 49 // 2 + 2 * 50 + 1 and all(a < b for a, b in got)
    assert got[(3, 4)] == 1 and got[(7, 91)] == 36 / 37


def test_texts_of_other_cells_do_not_meet(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([((c, i), text, c) for c in (1, 2) for i in range(3)], "id struct<cell: long, id: long>, text string, cell long")
    assert {(r.a.cell, r.b.cell) for r in P.similar_pairs(docs, within="cell").collect()} == {(1, 1), (2, 2)}


def test_coverage_matrix_needs_one_aggregation(spark):
    from ledgerloom.operators import fragments

    m = spark.createDataFrame([("r", "a", "news"), ("r", "a", "news"), ("r", "a", "vendor"), ("r", "b", None)], "record string, attribute string, source_class string")
    got = fragments.coverage_matrix(m)
    assert _plan(got).count("Aggregate") == 1
    assert {r.attribute: (r.news, r.vendor, r.other) for r in got.collect()} == {"a": (1, 1, 0), "b": (0, 0, 0)}
