"""Connected components of graphs that do not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ledgerloom.storage import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge; root is the component's least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges stop changing. Each round is two aggregations with map-side combine
    and two equi-joins, which adaptive execution can split when a node is a hub;
    nothing but two numbers a round reaches the driver. Self loops and edges
    with a null end are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("two"))
    e = e.where("two").select("a", "b").distinct()
    before = None
    for _ in range(max_rounds):
        seen = Observation()
        e = stored(e.observe(seen, F.count("*").alias("n"), F.expr("cast(sum(cast(xxhash64(a, b) as decimal(38, 0))) as string)").alias("of")), "edges")
        if seen.get == before or not seen.get["n"]:
            break
        before = seen.get
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = small.select("e.a", "e.b").where("a <> b").distinct()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b").distinct())
