"""Minimax contiguous sharding of atomic groups.

Equal texts form one group. Groups stand in the order of their MD5, and are cut
into contiguous shards so that the largest shard is as small as any cut allows.
The smallest feasible capacity is found by binary search with a greedy check;
the greedy cuts at that capacity are the shards.

The order is never collected. The driver holds sums over hash prefixes
("atoms"): 65,536 at first, and 256 more for each that a cut might fall into,
until every such atom is a single group. That is a few rounds whatever the
input, and gives the same cuts as a search over all groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import narrow
from ledgerloom.storage import stored


def greedy(sums: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (counts of atoms) of shards filled one after another; None if more are needed."""
    ends, base = [], 0
    for _ in range(shards):
        i = int(np.searchsorted(sums, base + capacity, "right"))
        ends.append(i)
        if i == len(sums):
            return ends
        base = int(sums[i - 1]) if i else 0
    return None


def capacity_of(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity at which the ordered sizes fit into so many contiguous shards."""
    if not len(sizes):
        return 0
    sums = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(sums[-1]) // shards)), int(sums[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sums, mid, shards) else (mid + 1, high)
    return low


def cut_keys(groups: DataFrame, shards: int, digits: int = 4, step: int = 2) -> list[str]:
    """For ``groups(g, bytes)``, the first key of every shard but the first; missing ones are empty shards."""

    def atoms(of: DataFrame, n: int) -> list[tuple]:
        found = of.groupBy(F.substring("g", 1, n).alias("k")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m"))
        return [(r.k, r.b, r.n, r.m) for r in found.collect()]

    known = sorted(atoms(groups, digits))
    while known:
        sizes = np.array([b for _, b, _, _ in known], np.int64)
        sums = np.cumsum(sizes)
        begins, total = sums - sizes, int(sums[-1])
        low, high = max(max(m for *_, m in known), -(-total // shards)), capacity_of(sizes, shards)
        a = z = 0
        unsure: set[int] = set()
        for _ in range(shards):  # the true cut lies between a and z
            i = int(np.searchsorted(sums, a + low, "right"))
            a = total if i == len(sums) else int(begins[i])
            j = int(np.searchsorted(sums, z + high, "left"))
            z = total if j >= len(sums) else int(sums[j])
            unsure |= {k for k in range(i, min(j + 1, len(known))) if known[k][2] > 1}
        if not unsure:
            break
        by_length: dict[int, list[str]] = {}
        for k in unsure:
            by_length.setdefault(len(known[k][0]), []).append(known[k][0])
        new = [x for n, ks in by_length.items() for x in atoms(groups.where(F.substring("g", 1, n).isin(ks)), n + step)]
        known = sorted([x for k, x in enumerate(known) if k not in unsure] + new)
    if not known:
        return []
    sizes = np.array([b for _, b, _, _ in known], np.int64)
    ends = greedy(np.cumsum(sizes), capacity_of(sizes, shards), shards)
    return [known[i][0] for i in ends if i < len(known)]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; equal texts share a shard.

    size: UTF-8 bytes plus 1. A null text counts as the empty one. slot numbers
    a shard's rows from 0 without gaps, in order of the id's MD5, then id, then
    text. Repeated rows each get a slot. With fewer groups than shards, the last
    shards are empty; a group larger than a shard's even share fills its shard alone.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    d = narrow(docs, doc_id=docs[id_col].cast("bigint"), size=(F.octet_length(text) + 1).cast("bigint"), text_crc32=F.crc32(text.cast("binary")), g=F.md5(text.cast("binary")))
    d = stored(d.withColumn("m", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "texts")
    groups = stored(d.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    number = F.lit(0)
    for key in cut_keys(groups, shards):
        number = number + (F.col("g") >= key).cast("int")
    rows = d.withColumns({"shard": number, "bucket": F.substring("m", 1, 3)})
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    # At most 4096 buckets a shard, whatever the input.
    rows = rows.join(F.broadcast(offsets), ["shard", "bucket"])
    slot = F.expr("before + row_number() over (partition by shard, bucket order by m, doc_id, g) - 1")
    return rows.select("doc_id", "size", "text_crc32", "shard", slot.cast("bigint").alias("slot"))
