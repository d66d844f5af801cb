"""What has been found and what has not: capture statistics, stopping, and the choice of the next search.

Tables: ``covered(record_key, formulation_id, ...)`` says which searches found
which records; ``record_stratum`` is a column ``stratum`` on it. A search is one
capture occasion, however many pages it returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.values import query_key

# Novelty cap, stopping level, value of a record, price and budget of searches.
Y_CAP, BETA, DELTA, ETA, LAMBDA, PRICE, BUDGET = 12, 1.0, 0.05, 0.20, 0.50, 0.02, 5.0


def record_counts(covered: DataFrame) -> DataFrame:
    """Distinct searches that found each record."""
    return covered.groupBy("stratum", "record_key").agg(F.countDistinct("formulation_id").alias("times"))


def frequency_of_frequencies(covered: DataFrame) -> DataFrame:
    """``stratum, n, f1, f2, more``: records found once, twice, more often."""
    t = F.col("times")
    return record_counts(covered).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(t == 1).alias("f1"), F.count_if(t == 2).alias("f2"), F.count_if(t > 2).alias("more"))


def residual_yield() -> Column:
    """Expected new records of a search not yet issued."""
    return F.when(F.col("issued"), 0.0).otherwise(F.col("p_success") * F.col("yield_if_success"))


def good_turing(freq: DataFrame, formulations: DataFrame, beta: float = BETA) -> DataFrame:
    """Adds ``u_hat``: unseen mass, with credit for pending searches of the stratum or of none."""
    pending = formulations.withColumn("r", residual_yield())
    own = pending.where("stratum is not null").groupBy("stratum").agg(F.sum("r").alias("own"))
    free = pending.where("stratum is null").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("free"))
    d = freq.join(own, "stratum", "left").join(F.broadcast(free))  # one row
    credit = beta * (F.coalesce("own", F.lit(0.0)) + F.col("free"))
    return d.withColumn("u_hat", F.when(F.col("n") == 0, 1.0).otherwise((F.col("f1") + credit) / F.col("n"))).drop("own", "free")


def chao1(occasions: Column) -> Column:
    """Unseen records by ``f1`` and ``f2``; infinite before the second occasion."""
    f1, f2 = F.col("f1"), F.col("f2")
    shrink = (occasions - 1) / occasions
    return F.when(occasions < 2, F.lit(math.inf)).when(f2 > 0, shrink * f1 * f1 / (2 * f2)).otherwise(shrink * f1 * (f1 - 1) / 2)


def radius(n: Column, strata: Column, realized: Column, occasions: Column, delta: float = DELTA, beta: float = BETA) -> Column:
    """Anytime radius; a realized variance of null or 0 falls back to the worst case."""
    c = Y_CAP * (1 + beta) / F.greatest(n, F.lit(1))
    v = F.when(F.coalesce(realized, F.lit(0.0)) != 0, realized).otherwise(occasions * c * c)
    return F.sqrt(2 * v * F.log(strata / F.lit(delta)))


def steps_seen(covered: DataFrame, steps: DataFrame) -> DataFrame:
    """``stratum, step, new, found``: records first found at each step and so far, for every step."""
    first = covered.groupBy("stratum", "record_key").agg(F.min("step").alias("step"))
    new = first.groupBy("stratum", "step").agg(F.count("*").alias("new"))
    grid = covered.select("stratum").distinct().join(F.broadcast(steps))  # occasions are a short list
    return grid.join(new, ["stratum", "step"], "left").withColumn("new", F.coalesce("new", F.lit(0))).withColumn("found", F.expr("sum(new) over (partition by stratum order by step)"))


def realized_variance(seen: DataFrame, beta: float = BETA) -> DataFrame:
    """Adds ``v``: running sum of squared increments."""
    c = Y_CAP * (1 + beta) / F.greatest("found", F.lit(1))
    return seen.withColumn("_c", c * c).withColumn("v", F.expr("sum(_c) over (partition by stratum order by step)")).drop("_c")


def capped_novelty(new: Column) -> Column:
    return F.least(new, F.lit(Y_CAP))


def recall(seen: DataFrame) -> DataFrame:
    """Adds ``recall``: share of all records of the stratum found so far."""
    return seen.withColumn("recall", F.expr("found / max(found) over (partition by stratum)"))


def replay_stops(ledger: DataFrame, levels: DataFrame) -> DataFrame:
    """``epsilon, stop_step, reason``: first step at which a run would have stopped.

    ``ledger`` has ``stratum, step, u_hat, psi, n, claimed, certified, hot,
    spent``. At a step the budget is tested before the certificates, which hold
    if every uncertified stratum has all it was said to have, no hot search and
    ``u_hat + psi`` below the level. A level is read only here, so one strict run
    serves all looser ones.
    """
    ok = F.coalesce("certified", F.lit(False)) | ((F.col("n") >= F.coalesce("claimed", F.lit(0))) & ~F.col("hot") & (F.col("u_hat") + F.col("psi") < F.col("epsilon")))
    grid = ledger.join(F.broadcast(levels))  # a handful of levels
    step = grid.groupBy("epsilon", "step").agg(F.bool_and(ok).alias("all_ok"), F.max("spent").alias("spent"))
    hit = step.withColumn("reason", F.when(F.col("spent") >= BUDGET, "budget").when(F.col("all_ok"), "certified"))
    stop = hit.where("reason is not null").groupBy("epsilon").agg(F.min(F.struct("step", "reason")).alias("s"))
    last = step.groupBy("epsilon").agg(F.max("step").alias("last"))
    return last.join(stop, "epsilon", "left").select("epsilon", F.coalesce("s.step", "last").alias("stop_step"), F.coalesce("s.reason", F.lit("max_steps")).alias("reason"))


def reservation_index() -> Column:
    """Worth of issuing a search now; minus infinity once issued or hopeless."""
    return F.when(F.col("issued") | (F.col("p_success") <= 0), F.lit(-math.inf)).otherwise(LAMBDA * F.col("yield_if_success") - F.col("cost") / F.col("p_success"))


def next_searches(formulations: DataFrame, k: int = 1) -> DataFrame:
    """The k searches of highest reservation index; ties by id."""
    return formulations.withColumn("index", reservation_index()).orderBy(F.desc("index"), "formulation_id").limit(k)


def yield_factor(formulations: DataFrame) -> DataFrame:
    """One row: realized over predicted yield of issued searches, kept between 0.25 and 1."""
    issued = formulations.where("issued")
    predicted = F.coalesce("p0", "p_success") * F.col("yield_if_success")
    x = (F.coalesce(F.sum("realized_yield"), F.lit(0)) + 1.0) / (F.coalesce(F.sum(predicted), F.lit(0.0)) + 1.0)
    return issued.agg(F.greatest(F.lit(0.25), F.least(F.lit(1.0), x)).alias("factor"))


def recalibrated(formulations: DataFrame) -> DataFrame:
    """Scales the first success estimate of pending searches that no gap asked for."""
    f = formulations.join(F.broadcast(yield_factor(formulations)))  # one row
    scale = ~F.col("issued") & ~F.col("gap_directed")
    return f.withColumn("p_success", F.when(scale, F.coalesce("p0", "p_success") * F.col("factor")).otherwise(F.col("p_success"))).drop("factor")


def hot_strata(strata: DataFrame, formulations: DataFrame, eta: float = ETA) -> DataFrame:
    """Adds ``hot``: a pending search of this stratum, or of none, still promises ``eta``."""
    hot = formulations.where(residual_yield() >= eta)
    own = hot.where("stratum is not null").select("stratum").distinct().withColumn("own", F.lit(True))
    free = hot.where("stratum is null").agg((F.count("*") > 0).alias("free"))
    return strata.join(own, "stratum", "left").join(F.broadcast(free)).withColumn("hot", F.coalesce("own", F.lit(False)) | F.col("free")).drop("own", "free")  # one row


def novel_queries(new: DataFrame, old: DataFrame) -> DataFrame:
    """Of ``query`` texts, those whose words no old one and no earlier new one has."""
    keyed = new.withColumn("query_key", query_key(F.col("query")))
    keyed = keyed.join(old.select(query_key(F.col("query")).alias("query_key")).distinct(), "query_key", "left_anti")
    return keyed.groupBy("query_key").agg(F.min("query").alias("query"))


def pruned(formulations: DataFrame, certified: DataFrame) -> DataFrame:
    """Pending searches of certified strata lose their hope."""
    done = certified.select("stratum").distinct().withColumn("_done", F.lit(True))
    f = formulations.join(done, "stratum", "left")
    stop = F.coalesce("_done", F.lit(False)) & ~F.col("issued")
    return f.withColumns({"p_success": F.when(stop, 0.0).otherwise(F.col("p_success")), "p0": F.when(stop, 0.0).otherwise(F.col("p0"))}).drop("_done")


def interpolated(curve: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """Recall at each budget on a piecewise linear curve ``cost, recall``; flat beyond its ends."""
    by = ", ".join(keys)
    c = curve.selectExpr(*keys, "cost", "recall", f"lead(cost) over (partition by {by} order by cost) as cost2", f"lead(recall) over (partition by {by} order by cost) as recall2", f"min(cost) over (partition by {by}) as first")
    b = c.join(F.broadcast(budgets), ((F.col("budget") >= F.col("cost")) & (F.col("cost2").isNull() | (F.col("budget") < F.col("cost2")))) | ((F.col("budget") < F.col("first")) & (F.col("cost") == F.col("first"))))
    share = F.greatest(F.lit(0.0), (F.col("budget") - F.col("cost")) / (F.col("cost2") - F.col("cost")))
    return b.select(*keys, "budget", F.when(F.col("cost2").isNull(), F.col("recall")).otherwise(F.col("recall") + share * (F.col("recall2") - F.col("recall"))).alias("recall"))


def fallback_search(formulations: DataFrame) -> DataFrame:
    """The pending search of greatest residual yield; ties by id."""
    return formulations.where("not issued").withColumn("residual", residual_yield()).orderBy(F.desc("residual"), "formulation_id").limit(1)


def eras(mentions: DataFrame) -> DataFrame:
    """``stratum, eras``: the years that a stratum's mentions cover, in order."""
    return mentions.where("year is not null").groupBy("stratum").agg(F.array_sort(F.collect_set("year")).alias("eras"))


def attributed_steps(mentions: DataFrame, ledger: DataFrame, proposed: DataFrame) -> DataFrame:
    """Adds ``step`` and ``fell_back``: the first step of a mention's search in the ledger, else the step that proposed it, else 1."""
    first = ledger.groupBy("formulation_id").agg(F.min("step").alias("_s"))
    d = mentions.join(first, "formulation_id", "left").join(proposed.select("formulation_id", F.when(F.col("proposed") != 0, F.col("proposed")).alias("_p")), "formulation_id", "left")
    return d.withColumns({"step": F.coalesce("_s", "_p", F.lit(1)), "fell_back": F.col("_s").isNull()}).drop("_s", "_p")
