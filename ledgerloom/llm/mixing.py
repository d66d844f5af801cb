"""Mixing sources to target weights with an exact splitting tree.

Each source's documents are cut into ``BLOCKS`` blocks by a keyed hash, so a
block is a random part of its source and no source, however large, meets in one
task. A source's target in words becomes a quota of block draws: whole passes
over all blocks, then blocks in a random order as long as they fit, then part of
the smallest that does not (found by descending through the hash's digits) and
one last document that best fills what is left. Draws are whole documents.

The quotas of all sources go down a binary tree over the output shards; each
node splits its quotas between its halves by one multivariate hypergeometric
draw, so every shard gets its share of every source and the totals stay exact.
A shard takes the next of each source's permuted draws, disjoint from all
others', and orders its documents by a hash of its own.

The driver holds one row a source and block, so there may be ``MOST_SOURCES``
sources at most; more are an error that says so.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import STREAMED, WORD, free, narrow, streamed
from ledgerloom.storage import stored

#: Blocks of a source, and parts that a block is cut into where only some of it is drawn.
BLOCKS, PARTS = 256, 4096

#: Sources that the driver plans for: 256 sums each, and a broadcast row of as many lists.
MOST_SOURCES = 20_000

_OWN = "_ledgerloom_mix"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``most`` times its size.

    What is above is shared again by weight among those below, until none is above.
    """
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * unit > most * sizes[i]}
        for i in full or free:
            out[i] = float(most * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) counts that add up to ``quotas``; shard sizes differ by one at most."""
    if shards == 1:
        return quotas[None, :]
    half, total = shards // 2, int(quotas.sum())
    n = sum(total // shards + (i < total % shards) for i in range(half))
    left = rng.multivariate_hypergeometric(quotas, n, method="marginals")
    return np.concatenate([split_quotas(left, half, rng), split_quotas(quotas - left, shards - half, rng)])


def _fill(sizes: np.ndarray, room: float, seed: list[int], orders: int = 64) -> tuple[float, list[int], int | None]:
    """Words left, blocks drawn and the block to cut: blocks in a random order as long as they fit.

    Of a few orders the one that fills best is taken, which matters where a
    source has few documents; one in a thousand left is good enough.
    """
    best: tuple[float, list[int], int | None] | None = None
    for k in range(orders):
        left, drawn_, large = room, [], []
        for b in np.random.default_rng([*seed, 2, k]).permutation(BLOCKS).tolist():
            if sizes[b] <= left:
                drawn_.append(b)
                left -= int(sizes[b])
            else:
                large.append((int(sizes[b]), b))
        if best is None or left < best[0]:
            best = left, drawn_, min(large)[1] if large and left > 0 else None
        if best[0] <= 0.001 * room:
            break
    return best


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 17) -> DataFrame:
    """Every input row with its part in the mix.

    Adds to the input's columns, last, one struct ``mix``: ``size`` (words), ``source_size``,
    ``target`` (its source's), ``taken`` (size times the number of draws) and
    ``draws``, an array of (shard, epoch, place), place ordering a shard's rows.
    Where the input has a column of that name, underscores are appended.
    Explode the draws for the mix itself (``drawn``).

    Weights repeat over the sources in code point order, null last. A null or
    blank text has size 0; sources without words have target 0. Repeated rows
    share a hash and are drawn together. The same input and seed give the same mix.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.lit(seed), docs[id_col].cast("bigint"), docs[text_col])
    d = narrow(docs, source=docs[source_col].cast("string"), size=word_count(docs[text_col]), h=h)
    d = stored(d.withColumns({"block": F.pmod("h", F.lit(BLOCKS)).cast("int"), "part": F.pmod(F.shiftright("h", 8), F.lit(PARTS)).cast("int")}), "sizes")

    sums: dict[str | None, np.ndarray] = {}
    for r in streamed(d.groupBy("source", "block").agg(F.sum("size").alias("n"))):
        sums.setdefault(r.source, np.zeros(BLOCKS, np.int64))[r.block] = r.n
        if len(sums) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources: mix by a coarser column")
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    want = targets([int(sums[s].sum()) for s in names], [float(weights[i % len(weights)]) for i in range(len(names))], share, most)

    plans = []
    for i, (s, t) in enumerate(zip(names, want)):
        n, total = sums[s], int(sums[s].sum())
        passes = int(t // total) if total else 0
        left, extra, edge = _fill(n, t - passes * total, [seed, i]) if total else (0.0, [], None)
        draws = [(b, e) for e in range(passes) for b in range(BLOCKS)] + [(b, passes) for b in extra]
        plans.append({"source": s, "size": total, "target": t, "passes": passes, "draws": draws, "edge": edge, "left": left})
    _cut_edges(d, plans)

    quotas = np.array([len(p["draws"]) + (p["edge"] is not None) for p in plans], np.int64)
    dealt = split_quotas(quotas, shards, np.random.default_rng(seed)) if len(plans) else []
    rows = []
    for i, p in enumerate(plans):
        all_draws = p["draws"] + ([(p["edge"], p["passes"])] if p["edge"] is not None else [])
        shard = np.repeat(np.arange(shards), dealt[:, i])
        where: list[list] = [[] for _ in range(BLOCKS)]
        edge = None
        for j, k in enumerate(np.random.default_rng([seed, i, 1]).permutation(len(all_draws))):
            b, epoch = all_draws[k]
            if k == len(p["draws"]):
                edge = (int(shard[j]), epoch)
            else:
                where[b].append((int(shard[j]), epoch))
        rows.append((p["source"], p["size"], p["target"], where, p["edge"], *p.get("cut", (None, None, None)), edge))
    plan = spark.createDataFrame(rows, "_s string, _size long, _target double, _where array<array<struct<shard:int,epoch:int>>>, _edge int, _part int, _h long, _last long, _draw struct<shard:int,epoch:int>")

    names_in = docs.columns
    own = free(names_in, _OWN)
    plan = plan.select(F.struct("*").alias(free([*names_in, own], "_ledgerloom_plan")))
    side = docs.select("*", narrow_struct(docs, source_col, text_col, h).alias(own))
    m, plan_col = side[own], plan[plan.columns[0]]
    joined = side.join(F.broadcast(plan), m["source"].eqNullSafe(plan_col["_s"]), "left")  # a row a source
    plan = plan_col
    inside = (m["block"] == plan["_edge"]) & ((m["part"] < plan["_part"]) | ((m["part"] == plan["_part"]) & (m["h"] <= plan["_h"])) | (m["h"] == plan["_last"]))
    draws = F.concat(F.get(plan["_where"], m["block"]), F.when(F.coalesce(inside, F.lit(False)), F.array(plan["_draw"])).otherwise(F.array().cast("array<struct<shard:int,epoch:int>>")))
    placed = F.transform(draws, lambda x: F.struct(x["shard"].alias("shard"), x["epoch"].alias("epoch"), F.xxhash64(F.lit(seed), x["shard"], x["epoch"], m["h"]).alias("place")))
    out = F.struct(m["size"].alias("size"), plan["_size"].alias("source_size"), plan["_target"].alias("target"), (m["size"] * F.size(draws)).alias("taken"), placed.alias("draws"))
    return joined.withColumn(mixed := free([*names_in, own, "_ledgerloom_plan"], "mix"), out).select(*(side[f"`{c}`"] for c in names_in), mixed)


def narrow_struct(docs: DataFrame, source_col: str, text_col: str, h: Column) -> Column:
    return F.struct(docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"), h.alias("h"), F.pmod(h, F.lit(BLOCKS)).cast("int").alias("block"), F.pmod(F.shiftright(h, 8), F.lit(PARTS)).cast("int").alias("part"))


def _cut_edges(d: DataFrame, plans: list[dict]) -> None:
    """Where each source's last block is cut: its part, the last hash taken whole, and one more document.

    Two narrow passes over the edge blocks: words by part, then a running sum
    within one part, which holds about one in a million of a source's rows.
    """
    spark = d.sparkSession
    edges = [(p["source"], p["edge"], int(math.floor(p["left"]))) for p in plans if p["edge"] is not None]
    if not edges:
        return
    e = spark.createDataFrame(edges, "s string, b int, words long")
    rows = d.join(F.broadcast(e), d["source"].eqNullSafe(e["s"]) & (d["block"] == e["b"]))  # a row a source
    sums: dict = {}
    for r in streamed(rows.groupBy("s", "part").agg(F.sum("size").alias("n")), max(STREAMED, len(edges) * PARTS >> 19)):
        sums.setdefault(r.s, np.zeros(PARTS, np.int64))[r.part] = r.n
    parts = []
    for s, _, words in edges:
        total = np.cumsum(sums[s])
        part = int(np.searchsorted(total, words, "right"))
        parts.append((s, part, words - int(total[part - 1] if part else 0)))
    c = spark.createDataFrame(parts, "s2 string, cut int, room long")
    rows = rows.join(F.broadcast(c), rows["s"].eqNullSafe(c["s2"]))  # a row a source
    inside = rows.where("part = cut").groupBy("s", "h", "room").agg(F.sum("size").alias("size"))
    run = inside.withColumn("sum", F.expr("sum(size) over (partition by s order by h)"))
    taken = {r.s: r for r in run.where("sum <= room").groupBy("s").agg(F.max("h").alias("h"), F.max("sum").alias("sum")).collect()}
    rest = [(s, cut, room - (taken[s]["sum"] if s in taken else 0), taken[s]["h"] if s in taken else None) for s, cut, room in parts]
    g = spark.createDataFrame(rest, "s3 string, cut3 int, gap long, last long")
    later = rows.join(F.broadcast(g), rows["s"].eqNullSafe(g["s3"])).where("part > cut3 or (part = cut3 and (last is null or h > last))")  # a row a source
    later = later.groupBy("s", "h", "gap").agg(F.sum("size").alias("size"))
    best = later.where("abs(gap - size) < gap").groupBy("s").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "h")).alias("x"))
    more = {r.s: r.x.h for r in best.collect()}
    for p in plans:
        if p["edge"] is not None:
            cut = next(x for x in rest if x[0] == p["source"])
            p["cut"] = (cut[1], cut[3], more.get(p["source"]))


def drawn(mixed: DataFrame, shards: int = 16, per_shard: int = 4) -> DataFrame:
    """The mix from ``mix``'s result with as many ``shards``: a row for each draw, with ``shard``, ``epoch`` and ``place``, shuffled shard by shard.

    All of a shard's rows come together and are ordered by place, a hash of the
    draw, so neighbours are of any source. A shard is ``per_shard`` partitions in
    order, cut at even steps of that hash, so none has to fit into one task; a
    document's copies in a shard lie wherever their places are. Where the input has columns
    of the three names, underscores are appended to the new ones.
    """
    *names, struct = mixed.columns
    d = free(mixed.columns, "_ledgerloom_draw")
    rows = mixed.withColumn(d, F.explode(f"{struct}.draws"))
    shard, epoch, place = (free(names, x) for x in ("shard", "epoch", "place"))
    rows = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"{d}.shard").alias(shard), F.col(f"{d}.epoch").alias(epoch), F.col(f"{d}.place").alias(place))
    # The place is a uniform 64-bit hash: its top bits cut a shard evenly, without a look at the data.
    cut = F.floor((F.shiftright(place, 32) + F.lit(1 << 31)) * per_shard / F.lit(1 << 32)).cast("int")
    part = free(rows.columns, "_ledgerloom_part")
    rows = rows.withColumn(part, F.col(shard) * per_shard + cut)
    return rows.repartitionById(shards * per_shard, F.col(part)).sortWithinPartitions(shard, place).drop(part)
