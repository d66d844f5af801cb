"""Which source classes hold which attributes of a record, and whether one class would do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.values import CLASSES

# Share of records that one class must cover, and least records for that.
GAMMA, LEAST_RECORDS = 0.90, 8


def coverage(mentions: DataFrame) -> DataFrame:
    return mentions.select("record", "attribute", "source_class").distinct()


def coverage_matrix(cover: DataFrame) -> DataFrame:
    """A row a record and attribute, a 0/1 column a class; rows may be repeated."""
    held = lambda c: F.coalesce(F.max((F.col("source_class") == c).cast("int")), F.lit(0)).alias(c)
    return cover.groupBy("record", "attribute").agg(*map(held, CLASSES))


def cases(cover: DataFrame) -> DataFrame:
    """``record, attributes, case, best_class, density``.

    One class with all attributes makes a scan sufficient (most attributes
    first, then class order); an attribute that only one class has makes the
    record fragmented; otherwise it is redundant.
    """
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("source_class"))
    per_class = cover.groupBy("record", "source_class").agg(F.count("*").alias("k"))
    best = per_class.groupBy("record").agg(F.max(F.struct("k", (-rank).alias("r"), "source_class")).alias("b"))
    per_attr = cover.groupBy("record", "attribute").agg(F.count("*").alias("c"))
    u = per_attr.groupBy("record").agg(F.count("*").alias("attributes"), F.min("c").alias("least"), F.sum("c").alias("cells"))
    case = F.when(F.col("b.k") == F.col("attributes"), "scan_sufficient").when(F.col("least") == 1, "fragmented").otherwise("redundant")
    return u.join(best, "record").select("record", "attributes", case.alias("case"), F.when(F.col("b.k") == F.col("attributes"), F.col("b.source_class")).alias("best_class"), (F.col("cells") / (F.col("attributes") * len(CLASSES))).alias("density"))


def single_class(cased: DataFrame) -> DataFrame:
    """One row: the class that suffices for most records, its share, and whether searches may keep to it."""
    n = cased.agg(F.count("*").alias("records"))
    by = cased.where("best_class is not null").groupBy("best_class").agg(F.count("*").alias("k"))
    top = by.orderBy(F.desc("k"), "best_class").limit(1)
    r = top.join(F.broadcast(n)).withColumn("share", F.col("k") / F.col("records"))  # one row
    return r.select("best_class", "share", ((F.col("share") >= GAMMA) & (F.col("records") >= LEAST_RECORDS)).alias("prune"))


def weak_links(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Halves a belief and flags it where none of the asserting pages names the entity.

    ``values(record, belief)``; ``pages(record, text, surfaces)``; a name counts
    from four letters on, in any case.
    """
    named = F.exists("surfaces", lambda s: (F.length(s) >= 4) & F.lower("text").contains(F.lower(s)))
    p = pages.groupBy("record").agg(F.bool_or(named).alias("named"))
    v = values.join(p, "record", "left").withColumn("_n", F.coalesce("named", F.lit(False)))
    return v.select("record", F.when(F.col("_n"), F.col("belief")).otherwise(F.col("belief") * 0.5).alias("belief"), F.when(~F.col("_n"), "weak_entity_link").alias("flag"))
