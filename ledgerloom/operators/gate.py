"""Which extracted mentions to accept: two readers' agreement, a conformal gate, and its audit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.values import canonical_value
from ledgerloom.operators.ranks import running


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions of two readers paired one to one on equal keys: ``..keys, status, conf``.

    Rows of one key are numbered on either side by ``id``, so the pairing is a
    multiset one; what stays alone is ``a_only`` or ``b_only``. Confidence of a
    pair is the lesser of both.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    x = a.select(*keys, F.col("conf").alias("conf_a"), n.alias("n"))
    y = b.select(*keys, F.col("conf").alias("conf_b"), n.alias("n"))
    j = x.join(y, [*keys, "n"], "full")
    status = F.when(F.col("conf_b").isNull(), "a_only").when(F.col("conf_a").isNull(), "b_only").otherwise("agreed")
    return j.select(*keys, status.alias("status"), F.least("conf_a", "conf_b").alias("conf"))


def nonconformity(pred: Column, true: Column, conf: Column) -> Column:
    """1 - confidence of a right value; relative distance above 1 of a wrong number, 2 of any other."""
    p, t = canonical_value(pred), canonical_value(true)
    x, y = p.try_cast("double"), t.try_cast("double")
    return F.when(p == t, 1 - conf).when(x.isNotNull() & y.isNotNull(), F.least(1 + F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-9)), F.lit(2.0))).otherwise(F.lit(2.0))


def threshold(scores: DataFrame, delta: float = 0.05) -> DataFrame:
    """One row ``n, t_hat``: the calibrated quantile; its rank is clamped to the greatest score.

    Ranks come from the counts of equal scores, summed part by part.
    """
    by = scores.groupBy("score").agg(F.count("*").alias("m"))
    total = by.agg(F.sum("m").alias("n"))
    run = running(by, ["score"], "m", "upto")
    k = F.least(F.col("n"), F.ceil((1 - F.lit(delta)) * (F.col("n") + 1)))
    return run.join(F.broadcast(total)).where(F.col("upto") >= k).groupBy("n").agg(F.min("score").alias("t_hat"))  # one row


def accepted(mentions: DataFrame, t_hat: DataFrame) -> DataFrame:
    """Adds ``accepted`` and ``flag``; without a threshold all pass, flagged ``gate_uncalibrated``."""
    t = t_hat.agg(F.max("t_hat").alias("_t"))  # one row, null if there is none
    m = mentions.join(F.broadcast(t))
    return m.withColumns({"accepted": F.col("_t").isNull() | (1 - F.col("conf") <= F.col("_t")), "flag": F.when(F.col("_t").isNull(), "gate_uncalibrated")}).drop("_t")


def audit_stripes(rejected: DataFrame, per_stripe: int, stripes: int = 4, seed: int = 0) -> DataFrame:
    """A systematic sample of rejected rows: every fourth of the score order is a stripe, each gives as many."""
    order = running(rejected, ["score", "id"]).withColumn("stripe", (F.col("place") - 1) % stripes)
    # Each task keeps its own first few of a stripe before any row is moved.
    w = Window.partitionBy("stripe").orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("id").cast("string"))), "id")
    return order.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_stripe).drop("r")


def upper_bound(misses: int, audited: int, delta: float = 0.05) -> float:
    """Clopper-Pearson upper limit of a rate, by bisection on the binomial distribution."""
    if audited == 0 or misses >= audited:
        return 1.0

    def at_most(p: float) -> float:
        return sum(math.exp(math.lgamma(audited + 1) - math.lgamma(i + 1) - math.lgamma(audited - i + 1) + i * math.log(p) + (audited - i) * math.log1p(-p)) for i in range(misses + 1))

    low, high = 1e-15, 1 - 1e-15
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(mid) > delta else (low, mid)
    return high


def upper_bounds(counts: DataFrame, delta: float = 0.05) -> DataFrame:
    """Adds ``upper`` to ``counts(..., misses, audited)``, which are few rows."""

    @F.pandas_udf("double")
    def of(misses, audited):
        import pandas as pd

        return pd.Series([upper_bound(int(m), int(n), delta) for m, n in zip(misses, audited)])

    return counts.withColumn("upper", of("misses", "audited"))


def preview(scores: DataFrame, t_hat: DataFrame) -> DataFrame:
    """One row ``n, t_hat, least_conf, wrong``: what a gate fitted on these scores would accept; wrong are scores of 1 and more."""
    a = scores.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 1).alias("wrong"))
    t = t_hat.agg(F.max("t_hat").alias("t_hat"))
    return a.join(F.broadcast(t)).select("n", "t_hat", (1 - F.col("t_hat")).alias("least_conf"), "wrong")  # one row


def pair_sample(pairs: DataFrame, sizes: dict[str, int], seed: int = 0) -> DataFrame:
    """A seeded sample of pairs ``(a, b, theta)`` for labelling, so many from each band: low, middle and high."""
    band = F.when(F.col("theta") <= 0.15, "low").when(F.col("theta") >= 0.85, "high").otherwise("middle")
    w = Window.partitionBy("band").orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))), "a", "b")
    p = pairs.withColumn("band", band).withColumn("_r", F.row_number().over(w))
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col("band") == name) & (F.col("_r") <= n))
    return p.where(keep).drop("_r")


def halves(cohort: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``half``: calibration for the first half of the entities in a seeded order, validation for the others."""
    key = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("entity").cast("string")))
    r = running(cohort.select("entity").distinct().withColumn("_k", key), ["_k", "entity"])
    n = r.agg(F.count("*").alias("n"))
    h = r.join(F.broadcast(n)).select("entity", F.when(F.col("place") <= F.floor(F.col("n") / 2), "calibration").otherwise("validation").alias("half"))  # one row
    return cohort.join(h, "entity")


def holdout(losses: DataFrame, eps: float) -> DataFrame:
    """One row ``n, mean_loss, rate_within, p``: losses of the untouched half held against the certified level."""
    m = F.avg("loss")
    a = losses.agg(F.count("*").alias("n"), m.alias("mean_loss"), F.avg((F.col("loss") <= eps).cast("int")).alias("rate_within"))
    p = F.when(F.col("n") == 0, 1.0).when(F.col("mean_loss") < eps, F.exp(-2 * F.col("n") * F.pow(F.lit(eps) - F.col("mean_loss"), F.lit(2)))).otherwise(1.0)
    return a.withColumn("p", p)
