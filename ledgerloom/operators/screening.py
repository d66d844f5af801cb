"""Which registered filer a candidate's name means, and how sure that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.values import screen_name

# Scores of a sure and of a weak match, score of a name that lacks some of the registered words, alternates that are kept.
SURE, WEAK, PART, ALTERNATES = 0.90, 0.60, 0.75, 3


def scored_matches(matches: DataFrame) -> DataFrame:
    """Adds ``score`` to ``matches(candidate_name, registered, ...)``.

    1 for equal cores, 0.75 where the registered name has all words and more, else
    the share of matching stretches of characters; 0 where either core is empty. Only pairs that
    the words don't decide go to Python, each different pair once.
    """
    m = matches.withColumns({"_c": F.coalesce(screen_name(F.col("candidate_name")), F.lit("")), "_r": F.coalesce(screen_name(F.col("registered")), F.lit(""))})
    cw, rw = F.array_distinct(F.split("_c", " ")), F.array_distinct(F.split("_r", " "))
    part = (F.size(F.array_except(cw, rw)) == 0) & (F.size(rw) > F.size(cw))
    known = F.when((F.col("_c") == "") | (F.col("_r") == ""), 0.0).when(F.col("_c") == F.col("_r"), 1.0).when(part, PART)
    m = m.withColumn("_known", known)

    @F.arrow_udf("double")
    def ratio(a, b):
        from difflib import SequenceMatcher

        import pyarrow as pa

        return pa.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    rest = m.where("_known is null").select("_c", "_r").distinct().withColumn("_ratio", ratio("_c", "_r"))
    return m.join(rest, ["_c", "_r"], "left").withColumn("score", F.coalesce("_known", "_ratio")).withColumn("_words", F.size(F.split("_r", " "))).drop("_c", "_known", "_ratio", "_r")


def screened(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """``candidate, verdict, cik, registered, score, alternates``: a row a candidate.

    ``matches(candidate, cik, registered)``. The best match by score, then by fewer
    words, then by name and key; ok from 0.90, weak_match from 0.60, else no_match, which
    has no key. Alternates are the next three that are at least weak.
    """
    s = scored_matches(matches.join(candidates.select("candidate", F.col("name").alias("candidate_name")), "candidate"))
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "_words", "registered", "cik")
    top = s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 1 + ALTERNATES)
    first = lambda c: F.max(F.when((F.col("_n") == 1) & (F.col("score") >= WEAK), F.col(c))).alias(c)
    others = F.array_sort(F.collect_list(F.when((F.col("_n") > 1) & (F.col("score") >= WEAK), F.struct("_n", "registered"))))
    g = top.groupBy("candidate").agg(first("cik"), first("registered"), first("score"), F.transform(others, lambda x: x["registered"]).alias("alternates"))
    d = candidates.select("candidate").join(g, "candidate", "left")
    verdict = F.when(F.col("score") >= SURE, "ok").when(F.col("score") >= WEAK, "weak_match").otherwise("no_match")
    none = F.array().cast("array<string>")
    return d.select("candidate", verdict.alias("verdict"), "cik", "registered", "score", F.when(F.col("score").isNotNull(), F.col("alternates")).otherwise(none).alias("alternates"))
