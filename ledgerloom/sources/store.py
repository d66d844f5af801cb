"""Tables of a run, and files that grow without repeating themselves.

A table is a folder of Parquet files. Appends compare keys by an anti-join, so
running one again adds nothing; upserts append and the latest row counts.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Columns of the screening sheet, in order.
SHEET = ["candidate", "verdict", "cik", "registered_name", "match_score", "n_formd", "n_original_d", "first_formd", "last_formd", "human_verdict", "note"]


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unseen(new: DataFrame, *old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, each key once, whose keys none of the old tables has."""
    out = new.dropDuplicates(keys)
    for o in old:
        out = out.join(o.select(*keys).distinct(), keys, "left_anti")
    return out


def with_new_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labelled pairs and the new ones that are not among them; labels that were given stay."""
    return old.unionByName(unseen(new, old, keys=["pair_id"]).withColumn("label", F.lit("")))


class RunStore:
    """Tables of one run under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, run: str) -> None:
        self.spark, self.base = spark, f"{folder.rstrip('/')}/{run}"

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.base}/{table}")

    def table(self, table: str) -> DataFrame | None:
        """None before the first append."""
        try:
            return self.spark.read.parquet(f"{self.base}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def append_unseen(self, table: str, rows: DataFrame, keys: list[str], *others: str) -> None:
        """Append what neither this table nor the others hold."""
        old = [t for t in map(self.table, (table, *others)) if t is not None]
        self.append(table, unseen(rows, *old, keys=keys))

    def mentions(self, accepted_only: bool = False) -> DataFrame:
        m = self.table("mentions")
        return m.where("accepted") if accepted_only else m

    def save_certificate(self, domain: str, level: float, model: str) -> None:
        row = self.spark.createDataFrame([(domain, level, model)], "domain string, eps_f double, model string").withColumn("at", F.current_timestamp())
        self.append("certificates", row)

    def certificate(self, domain: str, model: str) -> tuple[float, bool] | None:
        """The domain's last level, and whether another model than the present one earned it."""
        t = self.table("certificates")
        rows = latest(t.where(F.col("domain") == domain), ["domain"], "at").collect() if t is not None else []
        return (rows[0].eps_f, rows[0].model != model) if rows else None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, a line each; blank lines and those that begin with # are none."""
    line = F.btrim("value", F.lit(" \t\r"))
    return spark.read.text(path).select(line.alias("candidate")).where("candidate <> '' and not startswith(candidate, '#')")


def write_sheet(rows: DataFrame, path: str) -> None:
    """The screening sheet as CSV with its fixed columns; missing ones are empty."""
    have = set(rows.columns)
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in SHEET)).write.mode("overwrite").csv(path, header=True)


def truth(spark: SparkSession, path: str, attribute: str = "amount") -> DataFrame:
    """``entity, n, total, mean`` of truth files ``{entity_id, records: [{...}]}``, one or a folder of them."""
    t = spark.read.schema(f"entity_id string, records array<struct<{attribute}: double>>").json(path, multiLine=True)
    r = t.select(F.col("entity_id").alias("entity"), F.explode_outer("records").alias("r"))
    return r.groupBy("entity").agg(F.count("r").alias("n"), F.sum(f"r.{attribute}").alias("total"), F.avg(f"r.{attribute}").alias("mean"))


def truth_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds in the order of their dates, undated ones last, then of accession; numbered from 1 in each entity."""
    w = Window.partitionBy("entity").orderBy(F.coalesce(F.col("first_sale").cast("string"), F.lit("9999")), "root")
    return rounds.withColumn("place", F.row_number().over(w))


PAYLOADS = {
    "relevance": "relevant boolean, confidence double",
    "extract": "mentions array<struct<surface: string, kind: string, attribute: string, value: string, currency: string, passage: string, confidence: double>>, claims array<struct<surface: string, functional: string, value: double, scope: string, passage: string>>",
    "adjudicate": "match boolean, confidence double",
    "searches": "queries array<struct<query: string, p_success: double, yield: double>>",
}


def payloads(replies: DataFrame, kind: str) -> DataFrame:
    """Replies ``(id, reply)`` of a reader as structs; ``bad`` where the text does not hold the fields."""
    parsed = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), PAYLOADS[kind])
    first = json.loads(replies.sparkSession.createDataFrame([], PAYLOADS[kind]).schema.json())["fields"][0]["name"]
    return replies.select("id", parsed.alias("payload"), (parsed.isNull() | parsed[first].isNull()).alias("bad"))
