"""Totals with honest intervals: completeness and fidelity kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.values import implied_tolerance

# Statistical level, fallback fidelity level, belief floor and supersession weight of the menu, its length.
EPS_G, FALLBACK_EPS_F, BELIEF_FLOOR, SUPERSESSION_WEIGHT, MENU = 0.10, 0.15, 0.70, 0.10, 5


def stratum_sums(mentions: DataFrame) -> DataFrame:
    """``stratum, n, total, slack``: sum of each record's median amount, and of those medians' implied tolerances."""
    r = mentions.groupBy("stratum", "record").agg(F.median("amount").alias("m"))
    return r.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.sum(implied_tolerance(F.col("m"))).alias("slack"))


def completeness(regime: Column, belief: Column, delta_plus: Column, total: Column) -> Column:
    """Completeness level of a group by what certifies it; null for an abandoned one."""
    return (
        F.when(regime.isin("schema", "registry"), 0.0).when(regime == "COUNT", 1 - belief)
        .when(regime == "SUM", F.try_divide(delta_plus, total) + 1 - belief).when(regime == "STATISTICAL", EPS_G)
    )


def two_term(groups: DataFrame, eps_f: float = FALLBACK_EPS_F) -> DataFrame:
    """``groups(stratum, n, total, kappa, regime, belief, delta_plus)`` with ``eps_c, eps_f, halfwidth``."""
    e = completeness(F.col("regime"), F.col("belief"), F.col("delta_plus"), F.col("total"))
    g = groups.withColumns({"eps_c": e, "eps_f": F.lit(eps_f)})
    return g.withColumn("halfwidth", F.col("total") * (F.col("eps_c") + F.col("eps_f")))


def global_line(report: DataFrame) -> DataFrame:
    """One row over certified groups: value-weighted completeness, summed halfwidth; abandoned groups stay out."""
    r = report.where("eps_c is not null")
    return r.agg(F.count("*").alias("groups"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.try_divide(F.sum(F.col("eps_c") * F.col("total")), F.sum("total")).alias("eps_c"), F.coalesce(F.sum("halfwidth"), F.lit(0.0)).alias("halfwidth"))


def three_part(records: DataFrame, eps_er: float = 0.05, eps_recall: float = 0.05, z: float = 1.96) -> DataFrame:
    """``records(value, belief)``: sum, and its interval's value, join and recall parts."""
    v, b = F.col("value"), F.col("belief")
    a = records.agg(F.sum("value").alias("total"), (z * F.sqrt(F.sum(v * v * (1 - b) * (1 - b)))).alias("value_part"), (2 * eps_er * F.avg("value")).alias("join_part"), (eps_recall * F.sum("value")).alias("recall_part"))
    return a.withColumn("halfwidth", F.col("value_part") + F.col("join_part") + F.col("recall_part"))


def menu(records: DataFrame, conflicts: DataFrame, claims: DataFrame | None = None, merges: DataFrame | None = None, alpha: float = 0.05, length: int = MENU, floor: float = BELIEF_FLOOR) -> DataFrame:
    """The checks by a person that would narrow the answer most.

    ``records(record, value, belief, n_dead, weak)`` give weak values, values whose
    page does not name the entity, and those that rest on supersessions;
    ``conflicts(stratum)`` come first of all; ``claims(stratum, belief, total)`` are
    those that certify; each of the fragile ``merges(a, b)`` stakes an average value at the matcher's error ``alpha``.
    """
    value = F.coalesce("value", F.lit(0.0))
    weak = records.where((F.col("belief") < floor) | F.coalesce("weak", F.lit(False))).select(F.lit("value").alias("kind"), F.col("record").cast("string").alias("subject"), (value * (1 - F.col("belief"))).alias("drop"))
    dead = records.where("n_dead > 0").select(F.lit("supersession").alias("kind"), F.col("record").cast("string").alias("subject"), (value * SUPERSESSION_WEIGHT).alias("drop"))
    first = conflicts.select(F.lit("conflict").alias("kind"), F.col("stratum").alias("subject"), F.lit(float("inf")).alias("drop"))
    out = first.unionByName(weak).unionByName(dead)
    if claims is not None:
        out = out.unionByName(claims.select(F.lit("claim").alias("kind"), F.col("stratum").alias("subject"), ((1 - F.col("belief")) * F.col("total")).alias("drop")))
    if merges is not None:
        mean = records.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("_v"))
        out = out.unionByName(merges.join(F.broadcast(mean)).select(F.lit("merge").alias("kind"), F.concat_ws("|", "a", "b").alias("subject"), (alpha * F.col("_v")).alias("drop")))  # one row
    return out.orderBy(F.desc("drop"), "kind", "subject").limit(length)


def fidelity_level(given: float | None, certificate: float | None) -> tuple[float, str]:
    """The fidelity level and where it is from: stated, certified for the domain, or the fallback."""
    if given is not None:
        return given, "given"
    return (certificate, "ltt") if certificate is not None else (FALLBACK_EPS_F, "fallback")


def statistical_status(strata: DataFrame, eps: float = EPS_G) -> DataFrame:
    """``stratum, passed, achieved`` of ``(stratum, n, u_hat, psi, claimed)``: estimate and radius below the level, and no fewer found than claimed."""
    achieved = F.col("u_hat") + F.col("psi")
    return strata.select("stratum", ((achieved < eps) & (F.col("claimed").isNull() | (F.col("n") >= F.col("claimed")))).alias("passed"), achieved.alias("achieved"))


def with_known_strata(records: DataFrame, strata: DataFrame) -> DataFrame:
    """A row for every stratum that has records or that a search knew of, those without records with n = 0 and total = 0."""
    r = records.join(strata.select("stratum").distinct(), "stratum", "full")
    return r.withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0.0))})
