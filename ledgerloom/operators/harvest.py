"""Labels for the gate, taken from the registry where it can decide and from people where it can't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.values import canonical_value, number_text, numeric

#: Fixed value: relative distance from a filed amount that still is a right reading.
LABEL_TOLERANCE = 0.02


def legitimate(filed: DataFrame) -> DataFrame:
    """``entity, amount``: every amount that any filing of an entity has carried."""
    return filed.where("amount is not null").select("entity", F.col("amount").cast("double").alias("amount")).distinct()


def labelled(mentions: DataFrame, legit: DataFrame, tolerance: float = LABEL_TOLERANCE) -> DataFrame:
    """``mention_id, label, true_value, distance`` of ``mentions(mention_id, entity, value, value_num)`` whose entity has filed amounts.

    registry_exact: the value is one of them in spelling; registry_tol: the nearest is
    within tolerance, and the reading itself counts as true; review: farther off, or no
    number, with the nearest (of all, the least) amount beside it. The nearest is found
    by one sort of an entity's mentions and amounts together, not by pairing them.
    """
    m = mentions.select("mention_id", "entity", "value", canonical_value(F.col("value")).alias("canon"), numeric(F.col("value"), F.col("value_num")).alias("x"))
    exact = legit.select("entity", number_text(F.col("amount")).alias("canon"), F.col("amount").alias("same"))
    m = m.join(exact, ["entity", "canon"], "left")
    least = legit.groupBy("entity").agg(F.min("amount").alias("least"))
    m = m.join(least, "entity")
    both = m.where("x is not null").select("entity", "mention_id", "x", F.lit(None).cast("double").alias("filed")).unionByName(legit.select("entity", F.lit(None).cast(m.schema["mention_id"].dataType).alias("mention_id"), F.col("amount").alias("x"), F.col("amount").alias("filed")))
    w = Window.partitionBy("entity").orderBy("x")
    below = F.last("filed", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("filed", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.withColumns({"lo": below, "hi": above}).where("mention_id is not null")
    pick = F.when(F.col("hi").isNull() | (F.col("x") - F.col("lo") <= F.col("hi") - F.col("x")), F.col("lo")).otherwise(F.col("hi"))
    near = near.select("mention_id", pick.alias("near"))
    d = m.join(near, "mention_id", "left")
    off = F.abs(F.col("x") - F.col("near")) / F.greatest(F.abs("near"), F.lit(1e-9))
    label = F.when(F.col("same").isNotNull(), "registry_exact").when(off <= tolerance, "registry_tol").otherwise("review")
    true = F.when(label == "registry_tol", F.col("value")).otherwise(number_text(F.coalesce("same", "near", "least")))
    return d.select("mention_id", label.alias("label"), true.alias("true_value"), F.when(label == "registry_exact", 0.0).otherwise(off).alias("distance"))


def human_labels(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``mention_id, pred, true_value`` of reviewed readings: a faithful one is true as it is, else the nearest filed amount is."""
    d = queue.join(verdicts.select("mention_id", "faithful"), "mention_id").where("faithful is not null")
    return d.select("mention_id", F.col("value").alias("pred"), F.when(F.col("faithful"), F.col("value")).otherwise(F.col("true_value")).alias("true_value"))


def assert_calibration_half(cohort: DataFrame, entity) -> None:
    """Raises unless the entity is in the half that may feed the gate (``cohort(entity, half)``)."""
    halves = {r.half for r in cohort.where(F.col("entity") == entity).select("half").distinct().collect()}
    if halves != {"calibration"}:
        raise ValueError(f"{entity} is not in the calibration half")


def assert_ungated(mentions: DataFrame) -> None:
    """Raises if a fitted gate accepted any of the mentions ``(flags)``: it would be calibrated on what it had cut itself."""
    if not mentions.where(~F.array_contains("flags", "gate_uncalibrated")).isEmpty():
        raise ValueError("mentions were accepted by a fitted gate")
