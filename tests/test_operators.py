"""Small exact cases of single operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import claims as C, corroborate as B, frontier as N, gate, graph, provenance as P, report as R, resolve as E, truth as T


def one(spark, column, **inputs):
    kind = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in inputs.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("$40M", "40000000"), ("40,000,000", "40000000"), ("0.04B", "40000000"), ("2024-01-05", "2024-01-05"), ("40 games", "40 games"), ("Indiana   Pacers", "indiana pacers"), ("  ", ""), ("", ""), ("40 USD", "40"), ("Series B", "series b"), ("1.5", "1.5")])
def test_canonical_value(spark, raw, want):
    assert one(spark, V.canonical_value(F.col("r")), r=raw) == want


def test_money(spark):
    amount = lambda raw: one(spark, V.parsed_amount(F.col("r")), r=raw)
    assert (amount("$40MM").num, amount("$40MM").unit) == (40.0, "mm")
    assert amount("40 games").reject == "amount_unit_unknown" and amount("x").reject == "amount_unparseable"
    usd = one(spark, V.money_usd(F.lit("37M"), F.col("c")), c="EUR")
    assert usd.usd == pytest.approx(37e6 * 1.08) and usd.flags == ["fx:EUR", "fx_static_rate"]
    assert one(spark, V.money_usd(F.lit("1"), F.col("c")), c=None).reject == "currency_missing"


def test_names_and_hosts(spark):
    assert one(spark, V.surface_key(F.col("s")), s="Acme, Inc.") == "acme"
    assert one(spark, V.surface_key(F.col("s")), s="Inc") == "inc"
    assert one(spark, V.resolver_name(F.col("s")), s="Zürich Bär Corp.") == "bar zurich"
    denied = lambda h: one(spark, V.under_any(F.col("h"), ["sec.gov"]), h=h)
    assert denied("sec.gov") and denied("www.sec.gov") and not denied("mysec.gov") and not denied("sec.gov.evil.com")
    assert one(spark, V.source_class(F.col("d")), d="blog.techcrunch.com") == "news"


@pytest.mark.parametrize("x,want", [(0.0, 0.0), (12_000_000.0, 0.12e6), (1_500.0, 15.0), (101.0, 0.5)])
def test_implied_tolerance(spark, x, want):
    assert one(spark, V.implied_tolerance(F.col("x")), x=x) == pytest.approx(want)


def test_chao(spark):
    assert spark.createDataFrame([(8, 0)], "f1 long, f2 long").select(N.chao1(F.lit(4.0)).alias("x")).first().x == 21.0


def test_margin(spark):
    assert one(spark, B.margin(F.col("b"), F.lit(0.51)), b=0.9964) == 13
    assert one(spark, B.margin(F.col("b"), F.lit(0.0)), b=0.9964) == 15


def test_copies_add_no_belief(spark):
    rows = [("c", "40", "reg", 0.95, True), ("c", "40", "press", 0.6, False)]
    for n in (3, 10):
        m = rows + [("c", "40", f"blog{i}", 0.4, False) for i in range(n)]
        df = spark.createDataFrame([(*r, f"m{i}") for i, r in enumerate(m)], "cell string, value string, source_id string, q double, anchored boolean, mention_id string")
        comp = spark.createDataFrame([("c", "40", f"blog{i}", "press") for i in range(n)], "cell string, value string, source_id string, component string")
        r = B.origin_beliefs(df, comp).first()
        assert r.nu == 2 and r.belief == pytest.approx(1 - 0.05 * 0.7)


def test_verbatim_run(spark):
    a = spark.createDataFrame([(1, "the quick brown fox jumps over")], "id long, text string")
    b = spark.createDataFrame([(2, "yesterday the quick brown fox sat down")], "id long, text string")
    assert P.verbatim_pairs(a, b, 4).count() == 1 and P.verbatim_pairs(a, b, 5).count() == 0


def test_checksum_branches(spark):
    rows = [("a", 2, 0.0, False), ("b", 3, 0.0, False), ("c", 4, 0.0, False), ("d", 3, 3.0, False), ("e", 3, 0.0, True)]
    cover = spark.createDataFrame([(s, n, 10e6, 0.0, chao, fragile) for s, n, chao, fragile in rows] + [("f", 3, 63e6, 0.3e6, 0.0, False), ("g", 3, 40e6, 0.3e6, 0.0, False), ("h", 1, 1.0, 0.0, 0.0, False)], "stratum string, n long, total double, slack double, chao double, fragile boolean")
    counts = spark.createDataFrame([(s, 3, 0.51) for s in "abcde"], "stratum string, claimed long, belief double")
    sums = spark.createDataFrame([(s, 63e6, 0.5e6, 0.51) for s in "fg"], "stratum string, v double, tolerance double, belief double")
    got = {r.stratum: r for r in C.checksum(cover, counts, sums).collect()}
    assert {s: (r.outcome, r.kind, r.conflict) for s, r in got.items()} == {
        "a": ("gap", None, None), "b": ("certified", "COUNT", None), "c": ("conflict", None, "found_more_than_claimed"), "d": ("conflict", None, "chao_vs_checksum"),
        "e": ("conflict", None, "fragile_entity"), "f": ("certified", "SUM", None), "g": ("gap", None, None), "h": ("none", None, None),
    }
    assert got["a"].count_gap == 1 and got["f"].delta_plus == pytest.approx(0.8e6) and got["f"].belief == 0.51 and got["g"].value_gap == pytest.approx(23e6)


def test_a_revoked_conflict_is_vetoed_too(spark):
    d = "stratum string, outcome string, conflict string, count_gap long"
    before = spark.createDataFrame([("a", "certified", None, None), ("b", "certified", None, None), ("c", "gap", None, 1), ("d", "gap", None, 1), ("e", "certified", None, None)], d)
    after = spark.createDataFrame([("a", "conflict", "x", None), ("b", "gap", None, 2), ("c", "certified", None, None), ("d", "conflict", "x", None), ("e", "open", None, None)], d)
    got = {r.stratum: (r.revoked, r.action) for r in C.revalidated(before, after).collect()}
    assert got == {"a": ("conflict", "VETO"), "b": ("count_gap", "REVOKE"), "c": (None, "CERTIFY"), "d": (None, "VETO"), "e": ("checksum_open", "REVOKE")}


def test_leaders_take_the_claims_tolerance(spark):
    c = spark.createDataFrame([("c1", "s1", "g", "SUM", 100.0, 0.0), ("c2", "s2", "g", "SUM", 100.502, 0.0)], "claim_id string, source_id string, stratum string, functional string, value_num double, tolerance double")
    assert [(r.leader, r.members) for r in C.leader_groups(c).collect()] == [(100.0, 2)]


def test_stale_echoes_die_with_their_origin(spark):
    """A filing says 35, its press page and twelve copies too; its amendment says 40 and is all that lives."""
    rows = [("reg", 1, "35", True, "c", "Form D"), ("press", 2, "35", False, None, "page"), ("new", 90, "40", True, "c", "Form D/A")] + [(f"blog{i}", 3 + i, "35", False, None, "page") for i in range(12)]
    w = spark.createDataFrame([("cell", s, t, v, a, c, k, 0.95 if a else 0.3, f"m{s}") for s, t, v, a, c, k in rows], "cell string, source_id string, ts long, value string, anchored boolean, chain string, doc_type string, q double, mention_id string")
    edges = spark.createDataFrame([("cell", "reg", "press")] + [("cell", "press", f"blog{i}") for i in range(12)] + [("cell", "blog3", "new")], "cell string, src string, dst string")
    stale = P.stale_sources(edges, P.dead_sources(P.superseded_in_chain(w), w), w)
    got = B.live_beliefs(w, edges, stale).collect()
    assert [(r.value, r.nu, r.n_dead) for r in got] == [("40", 1, 14)]
    everything = w.select("cell", "source_id").distinct()
    assert {(r.value, r.nu, r.n_dead) for r in B.live_beliefs(w, edges, everything).collect()} == {("35", 1, 0), ("40", 1, 0)}


def test_names_lose_any_mark(spark):
    assert one(spark, V.resolver_name(F.col("s")), s="Škoda Őrség Ñandú Ltd.") == "nandu orseg skoda"


def test_clusters_move_to_no_gain_rather_than_a_loss():
    w = {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): -2.0}
    of = E.cluster_signed(["a", "b", "c"], w)
    assert of["b"] != of["c"]


def test_four_regimes(spark):
    g = spark.createDataFrame([("a", 2, 15e6, "COUNT", 0.9, 0.0), ("b", 1, 50e6, "SUM", 0.8, 1e6), ("c", 1, 20e6, "STATISTICAL", None, None), ("d", 1, 7e6, "ABANDONED", None, None)], "stratum string, n long, total double, regime string, belief double, delta_plus double")
    assert R.global_line(R.two_term(g, 0.05)).first().total == 85e6


def test_audit_bounds():
    assert gate.upper_bound(0, 60) == pytest.approx(0.049, abs=1e-3) and gate.upper_bound(1, 60) == pytest.approx(0.078, abs=2e-3)
    assert gate.upper_bound(0, 0) == gate.upper_bound(5, 5) == 1.0
    assert T.cohort_needed() == 150


def test_threshold(spark):
    s = spark.createDataFrame([(i / 100,) for i in range(1, 100)], "score double")
    assert gate.threshold(s).first().t_hat == 0.95


def test_signed_clusters():
    w = lambda p: p
    assert len(set(E.cluster_signed(["A", "B", "C"], {("A", "B"): w(2.9), ("A", "C"): -3.9, ("B", "C"): -3.9}).values())) == 2
    assert len(set(E.cluster_signed(["X", "Y", "Z"], {("X", "Y"): 2.9, ("Y", "Z"): 2.9, ("X", "Z"): -2.2}).values())) == 1


def test_hoeffding(spark):
    assert one(spark, T.hoeffding(F.col("m"), F.lit(100)), m=0.05) == pytest.approx(2.718281828 ** -0.5)


def test_chain_collapse(spark):
    f = spark.createDataFrame([(1, None, "e", "2020-01-01", "2019-12-01", 5e6), (2, 1, "e", "2020-06-01", None, 7.5e6), (4, 3, "e", "2021-01-01", None, 2e6)], "accession long, previous long, entity string, filing_date string, first_sale string, amount double")
    got = {r.root: (r.amount, r.n_filings, r.snapshots, r.partial) for r in T.collapsed_chains(f).collect()}
    assert got == {1: (7.5e6, 2, [5e6], False), 3: (2e6, 1, [], True)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + list(itertools.pairwise(range(1000, 1100)))
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in up}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
