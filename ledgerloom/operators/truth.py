"""Registry filings as truth, grading against it, and the certificate that follows.

``filings(accession, previous, entity, filing_date, first_sale, amount)``: an
amendment names the filing that it amends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ledgerloom.storage import stored

# Grading tolerance of amounts, certificate level and target.
AMOUNT_TOLERANCE, DELTA_F, EPS_TARGET = 0.05, 0.05, 0.10


def collapsed_chains(filings: DataFrame) -> DataFrame:
    """``entity, root, amount, first_sale, n_filings, snapshots, partial``: one round a chain of amendments.

    A chain is named by the filing that its links lead back to. Its newest filing
    gives the amount (0 if it states none), the first in filing order that states
    a first sale the date; snapshots are its other amounts. A chain whose first
    filing is missing is partial, under that name.
    """
    f = filings.join(chain_roots(filings), "accession")
    known = filings.select(F.col("accession").alias("previous"), F.lit(True).alias("known"))
    f = f.join(known, "previous", "left")
    order = F.struct(F.coalesce(F.col("filing_date").cast("string"), F.lit("")), F.col("accession"))
    g = f.groupBy("entity", "root").agg(F.max_by("amount", order).alias("amount"), F.min_by("first_sale", F.when(F.col("first_sale").isNotNull(), order)).alias("first_sale"), F.count("*").alias("n_filings"), F.array_sort(F.collect_set("amount")).alias("amounts"), F.bool_or(F.col("previous").isNotNull() & F.col("known").isNull()).alias("partial"))
    g = g.withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    return g.select("entity", "root", "amount", "first_sale", "n_filings", F.array_except("amounts", F.array("amount")).alias("snapshots"), "partial")


def chain_roots(filings: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``accession, root`` by pointer doubling: after r rounds a filing points 2**r links back."""
    p = stored(filings.select("accession", F.coalesce("previous", "accession").alias("root")).distinct(), "chains")
    for _ in range(max_rounds):
        up = p.select(F.col("accession").alias("root"), F.col("root").alias("next"))
        moved = Observation()
        q = p.join(up, "root", "left").select("accession", F.coalesce("next", "root").alias("to"), "root")
        q = stored(q.observe(moved, F.count_if(F.col("to") != F.col("root")).alias("n")).select("accession", F.col("to").alias("root")), "chains")
        if not moved.get["n"]:
            return q
        p = q
    raise RuntimeError("filings amend each other in a circle")


def truth_sums(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("entity").agg(F.sum("amount").alias("true_sum"), F.count("*").alias("true_count"))


def aligned_by_key(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``found(entity, key, id, amount)`` against ``truth(entity, key, amount)``: the first record of a key gets its round."""
    w = Window.partitionBy("entity", "key").orderBy("id")
    f = found.withColumn("r", F.row_number().over(w))
    t = truth.groupBy("entity", "key").agg(F.max("amount").alias("true_amount"))
    return f.join(t, ["entity", "key"], "left").select("entity", "key", "id", "amount", F.when(F.col("r") == 1, F.col("true_amount")).alias("true_amount"))


def aligned_by_amount(found: DataFrame, truth: DataFrame, tolerance: float = AMOUNT_TOLERANCE) -> DataFrame:
    """``entity, id, key``: greedy closest-first matches of amounts within tolerance, one to one.

    Candidates come from an equi-join on logarithmic buckets as wide as the
    tolerance, each with its neighbours; only an entity's candidates meet in one task, which takes
    them in order, entity after entity, and holds the matches of one.
    """
    width = math.log1p(tolerance) * 2
    bucket = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1e-9))) / width)
    f = found.withColumn("b", F.explode(F.sequence(bucket("amount") - 1, bucket("amount") + 1)))
    t = truth.select("entity", "key", F.col("amount").alias("true_amount")).withColumn("b", bucket("true_amount"))
    c = f.join(t, ["entity", "b"]).withColumn("off", F.abs(F.col("amount") - F.col("true_amount")) / F.abs(F.col("true_amount"))).where(F.col("off") <= tolerance)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, keys = None, set(), set()
        for batch in batches:
            kept = []
            for n, (e, i, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if e != at:
                    at, ids, keys = e, set(), set()
                if i not in ids and k not in keys:
                    ids.add(i)
                    keys.add(k)
                    kept.append(n)
            yield batch.select([0, 1, 2]).take(pa.array(kept, pa.int64()))

    kinds = {x.name: x.dataType.simpleString() for x in found.schema}
    c = c.select("entity", "id", "key", "off").repartition("entity").sortWithinPartitions("entity", "off", "key", "id")
    return c.mapInArrow(match, f"entity {kinds['entity']}, id {kinds['id']}, key {truth.schema['key'].dataType.simpleString()}")


def close_amounts(rounds: DataFrame, tolerance: float = AMOUNT_TOLERANCE) -> DataFrame:
    """Pairs of an entity's rounds whose amounts differ by twice the tolerance at most: neighbours in a bucket join."""
    width = math.log1p(2 * tolerance) * 2
    bucket = F.floor(F.log(F.greatest(F.col("amount"), F.lit(1e-9))) / width)
    a = rounds.select("entity", F.col("key").alias("a"), F.col("amount").alias("x"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    b = rounds.select("entity", F.col("key").alias("b"), F.col("amount").alias("y"), bucket.alias("bucket"))
    rel = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs(F.col("x")), F.abs(F.col("y")))
    return a.join(b, ["entity", "bucket"]).where((F.col("a") < F.col("b")) & (rel <= 2 * tolerance)).select("entity", "a", "b")


def fidelity_loss(graded: DataFrame) -> DataFrame:
    """``entity, loss`` from ``(entity, amount, true_amount, true_sum)``: misstated matched plus spurious amounts, over the truth, 1 at most."""
    hit = F.col("true_amount").isNotNull()
    off = F.abs(F.sum(F.when(hit, F.col("amount")).otherwise(0.0)) - F.sum(F.coalesce("true_amount", F.lit(0.0))))
    extra = F.sum(F.when(~hit, F.col("amount")).otherwise(0.0))
    g = graded.groupBy("entity").agg(off.alias("off"), extra.alias("extra"), F.max("true_sum").alias("true_sum"))
    return g.select("entity", F.least(F.lit(1.0), F.try_divide(F.col("off") + F.col("extra"), F.col("true_sum"))).alias("loss"))


def hoeffding(mean: Column, n: Column, eps: float = EPS_TARGET) -> Column:
    return F.when(mean < eps, F.exp(-2 * n * F.pow(F.lit(eps) - mean, F.lit(2)))).otherwise(F.lit(1.0))


def fixed_sequence(losses: DataFrame, eps: float = EPS_TARGET, delta: float = DELTA_F) -> DataFrame:
    """``config, mean_loss, p, certified`` from ``losses(config, entity, loss)``: tests in order stop at the first failure."""
    g = losses.groupBy("config").agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("n"))
    g = g.withColumn("p", hoeffding(F.col("mean_loss"), F.col("n"), eps))
    return g.select("config", "mean_loss", "p", F.expr(f"min(p <= {delta}) over (order by config)").alias("certified"))


def fallback_level(rho: float, delta_e: float, delta_b: float, v_split: float, alpha: float, v_merge: float, delta_c: float, delta_t: float, total: float) -> float:
    """Fidelity level as a sum of the stages' levels, split and merge errors weighted by their share of the total."""
    share = lambda v: v / total if total else 0.0
    return rho + delta_e + delta_b * share(v_split) + alpha * share(v_merge) + delta_c + delta_t


def cohort_needed(eps: float = EPS_TARGET, delta: float = DELTA_F) -> int:
    return math.ceil(math.log(1 / delta) / (2 * eps * eps))


def floor_of(n: int, delta: float = DELTA_F) -> float:
    """The level that n entities without any loss reach."""
    return math.sqrt(math.log(1 / delta) / (2 * n))
