"""Readers, data sources and stores on small files."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import harvest, screening
from ledgerloom.operators.matching import bounded_blocks, fit_matcher, partial_ratio
from ledgerloom.operators.ranks import running
from ledgerloom.sources import pages, registry, store
from ledgerloom.sources.datasource import PagedList, RecordedSearch


def test_paged_list_follows_tokens(spark, tmp_path):
    (tmp_path / "first.json").write_text(json.dumps({"items": [{"key": "a"}, {"key": "b"}], "nextPageToken": "p2"}))
    (tmp_path / "p2.json").write_text(json.dumps({"items": [{"key": "c", "x": 1}]}))
    (tmp_path / "other.json").write_text(json.dumps({"items": [{"key": "z"}]}))
    spark.dataSource.register(PagedList)
    rows = spark.read.format("paged_list").option("path", str(tmp_path)).load().collect()
    assert [r.key for r in rows] == ["a", "b", "c"] and json.loads(rows[2].item)["x"] == 1


def test_recorded_search(spark, tmp_path):
    hits = [{"link": f"http://x/{i}", "title": None} for i in range(12)]
    (tmp_path / "q.json").write_text(json.dumps({"formulation_id": "f", "query": "q", "results": hits}))
    spark.dataSource.register(RecordedSearch)
    rows = spark.read.format("recorded_search").option("path", str(tmp_path)).load().collect()
    assert len(rows) == 10 and rows[0].rank == 1 and rows[0].title == "" and rows[0].snippet == ""


def test_denylist():
    assert pages.denylist(["sec", ".sec.gov", "A.org"]) == ["sec.gov", "a.org"]
    with pytest.raises(ValueError):
        pages.denylist(["unknown"])


def test_contamination_raises(spark):
    s = spark.createDataFrame([(1, "https://www.sec.gov/x")], "source_id long, url string")
    with pytest.raises(AssertionError):
        pages.assert_undenied(s.limit(0), s, ["sec.gov"])
    pages.assert_undenied(s, s, ["b.org"])


def test_broken_xml_stops(spark):
    d = spark.createDataFrame([(1, "Form D", "http://x", "<a><b></a>")], "source_id long, title string, url string, doc string")
    with pytest.raises(Exception, match="(?i)xml"):
        registry.parsed_forms(d).collect()


def test_store(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path), "r")
    assert s.table("queue") is None and s.certificate("d", "m") is None
    ids = spark.range(5).withColumnRenamed("id", "k")
    s.append_unseen("queue", ids, ["k"])
    s.append_unseen("queue", ids.unionAll(spark.range(7).withColumnRenamed("id", "k")), ["k"])
    assert sorted(r.k for r in s.table("queue").collect()) == list(range(7))
    s.save_certificate("d", 0.2, "m1")
    s.save_certificate("d", 0.1, "m2")
    assert s.certificate("d", "m2") == (0.1, False) and s.certificate("d", "m3") == (0.1, True)


def test_candidates_sheet_and_truth(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# list\n\n  Acme \nBeta\n")
    c = store.candidates(spark, str(tmp_path / "names.txt"))
    assert sorted(r.candidate for r in c.collect()) == ["Acme", "Beta"]
    store.write_sheet(c.withColumn("verdict", F.lit("ok")), str(tmp_path / "sheet"))
    got = spark.read.csv(str(tmp_path / "sheet"), header=True)
    assert got.columns == store.SHEET and got.count() == 2
    (tmp_path / "t.json").write_text(json.dumps({"entity_id": "e", "records": [{"amount": 3}, {"amount": 5}]}))
    assert tuple(store.truth(spark, str(tmp_path / "t.json")).first()) == ("e", 2, 8.0, 4.0)


def test_guards(spark):
    cohort = spark.createDataFrame([("a", "calibration"), ("b", "validation")], "entity string, half string")
    harvest.assert_calibration_half(cohort, "a")
    for e in ("b", "c"):
        with pytest.raises(ValueError):
            harvest.assert_calibration_half(cohort, e)
    m = spark.createDataFrame([(["gate_uncalibrated"],), ([],)], "flags array<string>")
    harvest.assert_ungated(m.where("size(flags) > 0"))
    with pytest.raises(ValueError):
        harvest.assert_ungated(m)


def test_matcher_floor_and_ratios(spark):
    d = spark.createDataFrame([(i, i + 1, 0.5, 0.5, 0.0, 0.0, 0.5, "1") for i in range(60)], "a long, b long, name double, part double, domain double, cosine double, time double, label string")
    assert fit_matcher(d)[1] is None
    assert partial_ratio("abc", "xxabcxx") == 1.0 and partial_ratio("", "a") == 0.0 and 0 < partial_ratio("abcd", "xxabxdxx") < 1


def test_bounded_blocks_split_only_large_ones(spark):
    rows = [(i, f"same{i % 26 * 7919 % 9973:06d}{i}", ["pre:same"]) for i in range(200)] + [(1000, "other", ["pre:othe"])]
    b = bounded_blocks(spark.createDataFrame(rows, "mention_id long, solid string, blocks array<string>"), most=20).select("mention_id", F.explode("blocks").alias("block"))
    sizes = {r.block: r.n for r in b.groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) <= 20 and "pre:othe" in sizes and sum(sizes.values()) == 201


def test_running_places(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.place == r.v + 1 for r in running(d, ["v"]).collect())


def test_screening_verdicts(spark):
    names = spark.createDataFrame([(1, "Databricks"), (2, "Affirm"), (3, "Robinhood"), (4, "Nobody"), (5, None)], "candidate long, name string")
    found = spark.createDataFrame([(1, "a", "Databricks, Inc."), (2, "b", "AFFIRMXH INC"), (3, "c", "Robinhood Secondary Two Fund"), (3, "d", "Robinhood Markets, Inc."), (3, "e", "Zed"), (5, "f", "Acme")], "candidate long, cik string, registered string")
    got = {r.candidate: (r.verdict, r.cik, r.alternates) for r in screening.screened(names, found).collect()}
    assert got == {1: ("ok", "a", []), 2: ("weak_match", "b", []), 3: ("weak_match", "d", ["Robinhood Secondary Two Fund"]), 4: ("no_match", None, []), 5: ("no_match", None, [])}
