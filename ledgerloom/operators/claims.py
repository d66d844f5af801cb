"""Totals and counts that sources state, and checks of what was assembled against them.

``claims(claim_id, source_id, stratum, functional, value_num, tolerance, scope,
passage, chain, t_asof)``; functional is COUNT or SUM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.values import QBAR

# Words that demote a claim, words that a stated scope needs, relative tolerances, belief that arms the brake.
SCOPE_FORBID, SCOPE_REQUIRE = ("debt", "to date"), ("equity", "round")
SUM_TOLERANCE, GROUP_TOLERANCE, BRAKE_BELIEF, CHAO_VETO = 0.02, 0.005, 0.50, 2.0


def scope_ok(scope: Column, passage: Column) -> Column:
    """No forbidden word in scope or passage; a stated scope needs a required one in either."""
    s = F.lower(F.coalesce(scope, F.lit("")))
    text = F.concat_ws(" ", s, F.lower(F.coalesce(passage, F.lit(""))))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    return ~hit(SCOPE_FORBID) & ((s == "") | hit(SCOPE_REQUIRE))


def demotion_rate(claims: DataFrame) -> DataFrame:
    c = claims.select("claim_id", (~scope_ok(F.col("scope"), F.col("passage"))).alias("demoted")).distinct()
    return c.agg(F.count("*").alias("claims"), F.avg(F.col("demoted").cast("int")).alias("demotion_rate"))


def clean(claims: DataFrame) -> DataFrame:
    return claims.where(scope_ok(F.col("scope"), F.col("passage")))


def newest(claims: DataFrame) -> DataFrame:
    """Per stratum, functional and chain only the newest valid time; claims without chain or date stay."""
    top = F.max("t_asof").over(Window.partitionBy("stratum", "functional", "chain"))
    c = claims.withColumn("_top", F.when(F.col("chain").isNotNull(), top))
    return c.where("_top is null or t_asof is null or t_asof >= _top").drop("_top")


def count_beliefs(claims: DataFrame) -> DataFrame:
    """``stratum, claimed, belief, sources``: COUNT claims by rounded value, the most believed first, ties to the lesser."""
    c = claims.where("functional = 'COUNT'").withColumn("claimed", F.bround("value_num").cast("bigint"))
    g = c.groupBy("stratum", "claimed").agg(F.countDistinct("source_id").alias("sources"))
    g = g.withColumn("belief", 1 - F.pow(F.lit(1 - QBAR), F.col("sources")))
    w = Window.partitionBy("stratum").orderBy(F.desc("sources"), "claimed")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def leader_members(claims: DataFrame) -> DataFrame:
    """``stratum, value_num, n, tol, leader``: SUM claims in ascending order join the first leader within tolerance.

    Tolerance is the loosest that the claim or a member states, or 0.5 % of the
    claim if that is more. The leader's value has six significant digits. Taking
    leaders in order is sequential, so a stratum's distinct values go to one task: a stratum has as
    many as it has differing statements, not as many as it has sources.
    """
    c = claims.where("functional = 'SUM'").groupBy("stratum", "value_num").agg(F.count("*").alias("n"), F.max(F.coalesce("tolerance", F.lit(0.0))).alias("tol"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for batch in batches:
            of = []
            for stratum, v, tol in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if stratum != at:
                    at, leaders = stratum, []
                near = next((g for g in leaders if abs(v - g[0]) <= max(g[1], tol, GROUP_TOLERANCE * abs(v))), None)
                if near is None:
                    leaders.append(near := [float(f"{v:.6g}"), tol])
                near[1] = max(near[1], tol)
                of.append(near[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.float64())], ["stratum", "value_num", "n", "tol", "leader"])

    c = c.where("stratum is not null and value_num is not null").select("stratum", "value_num", "n", "tol")
    return c.repartition("stratum").sortWithinPartitions("stratum", "value_num").mapInArrow(run, "stratum string, value_num double, n long, tol double, leader double")


def leader_groups(claims: DataFrame) -> DataFrame:
    """``stratum, leader, members, tolerance``: the groups of ``leader_members``."""
    return leader_members(claims).groupBy("stratum", "leader").agg(F.sum("n").alias("members"), F.max("tol").alias("tolerance"))


def provisional_count(claims: DataFrame) -> DataFrame:
    """``stratum, provisional``: smallest count that two sources state."""
    c = claims.where("functional = 'COUNT'").withColumn("v", F.bround("value_num").cast("bigint"))
    g = c.groupBy("stratum", "v").agg(F.countDistinct("source_id").alias("s")).where("s >= 2")
    return g.groupBy("stratum").agg(F.min("v").alias("provisional"))


def brakes(counts: DataFrame) -> DataFrame:
    """``stratum, brake``: the believed count where belief arms it, else null."""
    return counts.select("stratum", F.when(F.round("belief", 9) >= BRAKE_BELIEF, F.col("claimed")).alias("brake"))


def sum_beliefs(claims: DataFrame) -> DataFrame:
    """``stratum, v, tolerance, belief``: SUM claims by leader group, the most believed first, ties to the lesser leader.

    As for counts, each source is one unanchored origin.
    """
    c = claims.where("functional = 'SUM'").select("stratum", "source_id", "value_num", F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"))
    m = c.join(leader_members(claims).select("stratum", "value_num", "leader"), ["stratum", "value_num"])
    b = m.groupBy("stratum", F.col("leader").alias("v")).agg(F.countDistinct("source_id").alias("sources"), F.max("tolerance").alias("tolerance"))
    b = b.withColumn("belief", 1 - F.pow(F.lit(1 - QBAR), F.col("sources")))
    w = Window.partitionBy("stratum").orderBy(F.desc("sources"), "v")
    return b.withColumn("r", F.row_number().over(w)).where("r = 1").select("stratum", "v", "tolerance", "belief")


def checksum(coverage: DataFrame, counts: DataFrame, sums: DataFrame) -> DataFrame:
    """Each stratum's coverage against what sources say of its count and its sum.

    ``coverage(stratum, n, total, slack, chao, fragile)``, ``counts(stratum,
    claimed, belief)``, ``sums(stratum, v, tolerance, belief)``. Gives ``stratum, n,
    claimed, outcome, kind, belief, delta_plus, count_gap, value_gap, conflict``.

    Count first: too few found is a gap; as many as stated certifies, unless the
    entity rests on a fragile merge; more is a conflict. Where that neither
    certifies nor conflicts, the sum certifies if the excess is small and no
    record is known to be missing, else a residual beyond the tolerances is a gap. A
    certificate that the estimate of the unseen contradicts is a conflict.
    """
    d = coverage.join(counts.select("stratum", "claimed", F.col("belief").alias("b_n")), "stratum", "left")
    d = d.join(sums.select("stratum", "v", "tolerance", F.col("belief").alias("b_v")), "stratum", "left")
    n, c, v, total = (F.col(x) for x in ("n", "claimed", "v", "total"))
    known = lambda x: F.coalesce(x, F.lit(False))
    short, even, more = known(n < c), known(n == c), known(n > c)
    conflict = F.when(even & F.col("fragile"), "fragile_entity").when(more, "found_more_than_claimed")
    by_count = even & ~F.col("fragile")
    open_ = ~by_count & conflict.isNull() & v.isNotNull()
    plus = F.greatest(F.lit(0.0), v - total) + F.col("tolerance") + F.col("slack")
    by_sum = known(open_ & ~short & (plus <= SUM_TOLERANCE * v))
    lacks = known(open_ & ~by_sum & (v - total > F.col("tolerance") + F.col("slack")))
    doubt = (by_count | by_sum) & (F.col("chao") > CHAO_VETO)
    sure = (by_count | by_sum) & ~doubt
    conflict = F.when(doubt, "chao_vs_checksum").otherwise(conflict)
    outcome = F.when(sure, "certified").when(conflict.isNotNull(), "conflict").when(short | lacks, "gap").when(c.isNull() & v.isNull(), "none").otherwise("open")
    return d.select(
        "stratum", "n", "claimed", outcome.alias("outcome"), F.when(sure, F.when(by_count, "COUNT").otherwise("SUM")).alias("kind"),
        F.when(sure, F.when(by_count, F.col("b_n")).otherwise(F.col("b_v"))).alias("belief"), F.when(sure & by_sum, plus).alias("delta_plus"),
        F.when(short, c - n).alias("count_gap"), F.when(lacks, v - total).alias("value_gap"), conflict.alias("conflict"),
    )


def revalidated(before: DataFrame, after: DataFrame) -> DataFrame:
    """``stratum, revoked, action`` when strata have been merged and checked again.

    revoked says why a certificate that stood before goes: conflict, count_gap or
    checksum_open. action: VETO for any conflict, also one of a revoked certificate;
    CERTIFY where none stood; REVOKE where one goes without a conflict; else KEEP.
    """
    d = before.select("stratum", (F.col("outcome") == "certified").alias("was"))
    d = d.join(after.select("stratum", (F.col("outcome") == "certified").alias("now"), F.col("conflict").isNotNull().alias("conflict"), F.col("count_gap").isNotNull().alias("short")), "stratum", "full")
    was, now, conflict, short = (F.coalesce(F.col(x), F.lit(False)) for x in ("was", "now", "conflict", "short"))
    goes = was & (conflict | ~now)
    why = F.when(goes, F.when(conflict, "conflict").when(short, "count_gap").otherwise("checksum_open"))
    return d.select("stratum", why.alias("revoked"), F.when(conflict, "VETO").when(now & ~was, "CERTIFY").when(goes, "REVOKE").otherwise("KEEP").alias("action"))


def gap_searches(checked: DataFrame, seen: DataFrame) -> DataFrame:
    """``stratum, gap_key, query``: one search for each kind of gap of a stratum, the first time that it shows.

    ``seen(stratum, gap_key)`` are those asked before; gap_key is the sorted kinds.
    """
    kinds = F.array_compact(F.array(F.when(F.col("count_gap").isNotNull(), F.lit("count_gap")), F.when(F.col("value_gap").isNotNull(), F.lit("value_gap"))))
    g = checked.select("stratum", F.array_join(F.array_sort(kinds), "+").alias("gap_key")).where("gap_key <> ''").distinct()
    g = g.join(seen.select("stratum", "gap_key").distinct(), ["stratum", "gap_key"], "left_anti")
    return g.withColumn("query", F.concat(F.col("stratum"), F.lit(" missing records "), F.col("gap_key")))


def agreed_claims(a: DataFrame, b: DataFrame) -> DataFrame:
    """``claim_id, status``: claims of reader A that some claim of B on the same source, stratum and functional confirms.

    Within the greater of both tolerances or 0.5 % of A's value.
    """
    x = a.select("claim_id", "source_id", "stratum", "functional", F.col("value_num").alias("x"), F.coalesce("tolerance", F.lit(0.0)).alias("tx"))
    y = b.select("source_id", "stratum", "functional", F.col("value_num").alias("y"), F.coalesce("tolerance", F.lit(0.0)).alias("ty"))
    near = F.abs(F.col("x") - F.col("y")) <= F.greatest("tx", "ty", F.lit(GROUP_TOLERANCE) * F.abs("x"))
    j = x.join(y, ["source_id", "stratum", "functional"], "left").groupBy("claim_id").agg(F.bool_or(near).alias("ok"))
    return j.select("claim_id", F.when(F.coalesce("ok", F.lit(False)), "agreed").otherwise("a_only").alias("status"))
