"""Mentions of the same record: keys compared by their kind, links within an entity, components at a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.graph import connected_components

# Days over which a date's similarity falls to nothing, weights of date and number.
DAYS, DATE_WEIGHT, NUMBER_WEIGHT = 1.5, 0.7, 0.3


def date_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(a, b)) / DAYS)


def number_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def _reach(least: float) -> int:
    """Days that two mentions which score ``least`` can be apart."""
    return int(DAYS * (1 - (least - NUMBER_WEIGHT) / DATE_WEIGHT))


def _next_scores(mentions: DataFrame) -> DataFrame:
    """``mention_id, entity, date, number, score``: the score with the mention before it in the order of a day's numbers.

    Numbers of one day that are farther apart score less, but for opposite signs and missing numbers, which all
    score the date's weight alone. So where links need one day, the links of neighbours connect what all links do.
    """
    w = Window.partitionBy("entity", "date").orderBy("number", "mention_id")
    m = mentions.select("mention_id", "entity", F.col("date").cast("date").alias("date"), "number").where("mention_id is not null and entity is not null and date is not null")
    m = m.withColumns({"_last": F.lag("number").over(w), "_id": F.lag("mention_id").over(w)})
    return m.withColumn("score", F.when(F.col("_id").isNotNull(), F.round(DATE_WEIGHT + NUMBER_WEIGHT * number_similarity(F.col("_last"), F.col("number")), 9))).drop("_last", "_id")


def _repeated(mentions: DataFrame) -> bool:
    return not mentions.groupBy("mention_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components_at(mentions: DataFrame, tau: float) -> DataFrame:
    """``mention_id, record``: the least mention that links of score ``tau`` reach, without making the links where they need one day."""
    if _reach(tau) > 0:
        return record_components(mentions, record_links(mentions, tau))
    w = Window.partitionBy("entity", "date").orderBy("number", "mention_id")
    m = _next_scores(mentions).withColumn("part", F.sum(F.when(F.col("score") >= tau, 0).otherwise(1)).over(w))
    m = m.select("mention_id", F.min("mention_id").over(Window.partitionBy("entity", "date", "part")).alias("record"))
    if _repeated(mentions):  # a mention of two days or numbers connects both
        return record_components(mentions, m.select(F.col("mention_id").alias("a"), F.col("record").alias("b")))
    return m.unionAll(mentions.where("mention_id is null or entity is null or date is null").select("mention_id", F.col("mention_id").alias("record")))


def sweep_at(mentions: DataFrame, thresholds: list[float]) -> DataFrame:
    """As ``threshold_sweep``, from one pass over the mentions where links need one day and no mention is repeated."""
    if any(_reach(t) > 0 for t in thresholds) or _repeated(mentions):
        return threshold_sweep(mentions, record_links(mentions, min(thresholds)), thresholds)
    s = _next_scores(mentions).agg(*(F.count_if(F.col("score") >= t).alias(f"l{i}") for i, t in enumerate(thresholds)))
    n = mentions.agg(F.count("*").alias("n")).join(F.broadcast(s))  # one row
    row = lambda i, t: F.struct(F.lit(t).alias("tau"), (F.col("n") - F.col(f"l{i}")).alias("records"), F.lit(max(0.05, 0.05 + 0.75 * (0.9 - t))).alias("eps_er"))
    return n.select(F.inline(F.array(*(row(i, t) for i, t in enumerate(thresholds)))))


def record_links(mentions: DataFrame, least: float) -> DataFrame:
    """``a, b, score`` of an entity's mentions ``(mention_id, entity, date, number)`` that score ``least`` or more.

    The number weighs too little to reach a threshold above its weight alone, so
    dates must be near: candidates come from an equi-join on the day and its neighbours.
    """
    if least <= NUMBER_WEIGHT:
        raise ValueError(f"a threshold of {NUMBER_WEIGHT} or less would pair all mentions of an entity")
    reach = _reach(least)
    day = F.datediff("date", F.lit("1970-01-01"))
    a = mentions.select("entity", F.col("mention_id").alias("a"), F.col("date").alias("da"), F.col("number").alias("na"), F.explode(F.sequence(day - reach, day + reach)).alias("day"))
    b = mentions.select("entity", F.col("mention_id").alias("b"), F.col("date").alias("db"), F.col("number").alias("nb"), day.alias("day"))
    score = DATE_WEIGHT * date_similarity(F.col("da"), F.col("db")) + NUMBER_WEIGHT * number_similarity(F.col("na"), F.col("nb"))
    return a.join(b, ["entity", "day"]).where("a < b").select("a", "b", score.alias("score")).where(F.round("score", 9) >= least)


def record_components(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """``mention_id, record``: the least mention that links reach."""
    roots = connected_components(links.select("a", "b")).withColumnRenamed("node", "mention_id")
    return mentions.select("mention_id").join(roots, "mention_id", "left").select("mention_id", F.coalesce("root", "mention_id").alias("record"))


def threshold_sweep(mentions: DataFrame, links: DataFrame, thresholds: list[float]) -> DataFrame:
    """``tau, records, eps_er``: how many records each threshold leaves, and the error it is charged with.

    One set of links serves all thresholds, which are a handful.
    """
    out = None
    n = mentions.select("mention_id").distinct().agg(F.count("*").alias("n"))
    for tau in thresholds:
        roots = connected_components(links.where(F.round("score", 9) >= tau).select("a", "b"))
        merged = roots.agg(F.count("*").alias("m"), F.countDistinct("root").alias("k"))
        row = n.join(F.broadcast(merged)).select(F.lit(tau).alias("tau"), (F.col("n") - F.col("m") + F.col("k")).alias("records"), F.lit(max(0.05, 0.05 + 0.75 * (0.9 - tau))).alias("eps_er"))  # one row
        out = row if out is None else out.unionByName(row)
    return out
