"""Discovery as a stream: each batch of events updates which searches found which records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators.frontier import frequency_of_frequencies
from ledgerloom.storage import fresh


def occasions(events: DataFrame) -> DataFrame:
    """``stratum, record_key, formulation_id`` of an event; the day of valid time is the search."""
    return events.select(F.col("event_type").alias("stratum"), F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.col("event_id") % 97 / 10).cast("bigint").cast("string")).alias("record_key"), F.datediff("ts", F.lit("2024-01-01")).cast("string").alias("formulation_id"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Runs all available events through a stream and returns the state's frequencies.

    Rows seen before are dropped by the stream's own state, so the sink gets each
    (record, search) once, whenever and however often it arrives. Sink and
    checkpoint lie in the shared scratch folder, so a lost executor costs one batch.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).format("parquet").load(path.rsplit("/", 1)[0] + "/events.parquet*")
    out = fresh(spark, "occasions")
    q = occasions(stream).dropDuplicates(["stratum", "record_key", "formulation_id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return frequency_of_frequencies(spark.read.parquet(out))
