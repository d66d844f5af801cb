"""Exact top-k by inner product over KD-trees, one tree a shard.

Candidates are dealt to shards of about ``SHARD`` vectors. A shard's tree splits
at the median of its widest dimension and keeps each node's tight box. For a
query, a node's bound is the greatest inner product any point of its box can
have; nodes are visited best first, and none whose bound is below the query's
k-th score so far. The k-th scores that a first shard gives are written beside
the queries and carried to all others, so their searches start with a bound.

Each tree is built once and written to the shared folder, as is each block of
queries. A task reads one tree and one block of at most ``QUERIES`` queries after
another, so its memory is fixed and no vector is shuffled after the trees stand.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import narrow
from ledgerloom.llm.files import make_dir, opened, size_of, writing
from ledgerloom.storage import fresh, stored

SHARD, LEAF, QUERIES = 16_384, 256, 2_048
#: Tasks that pairs of trees and query runs are dealt to at most; beyond, a task gets several.
MOST_TASKS = 20_000


class KDTree:
    """Integer vectors in tree order. Node i has children 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf: int = LEAF) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, len(ids)) / leaf))) if vecs.shape[1] else 0
        order, spans = np.arange(len(ids)), [(0, len(ids))]
        for node in range((1 << self.depth) - 1):
            a, b = spans[node]
            mid = (a + b) // 2
            if b - a > 1:
                part = vecs[order[a:b]]
                dim = int(np.argmax(part.max(0) - part.min(0)))
                order[a:b] = order[a:b][np.argpartition(part[:, dim], mid - a)]
            spans += [(a, mid), (mid, b)]
        self.ids, self.whole, self.spans = ids[order], vecs[order], spans
        self.vecs = self.whole.astype(np.float64)
        self.low = np.array([self.vecs[a:b].min(0) if b > a else self.vecs[:1].sum(0) * 0 for a, b in spans])
        self.high = np.array([self.vecs[a:b].max(0) if b > a else self.vecs[:1].sum(0) * 0 for a, b in spans])

    @classmethod
    def of(cls, ids: np.ndarray, vecs: np.ndarray, spans: np.ndarray, low: np.ndarray, high: np.ndarray) -> KDTree:
        """A tree as it was written."""
        tree = cls.__new__(cls)
        tree.ids, tree.whole, tree.vecs, tree.low, tree.high = ids, vecs, vecs.astype(np.float64), low, high
        tree.spans, tree.depth = spans.tolist(), (len(spans) + 1).bit_length() - 2
        return tree

    def search(self, qids: np.ndarray, queries: np.ndarray, floors: list, k: int) -> list[tuple[int, int, int]]:
        """(query, vec, score) of each query's best k, none below its floor."""
        q = queries.astype(np.float64)
        bounds = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        most = float(np.abs(self.vecs).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        exact = most < 2**53
        if not exact:  # scores as Python integers, boxes with room for rounding
            bounds = bounds + most * 1e-12
            whole, queries = self.whole.astype(object), queries.astype(object)
        first_leaf, out = (1 << self.depth) - 1, []
        for i, own in enumerate(qids.tolist()):
            best: list[tuple[int, int]] = []  # least first: (score, -id)
            floor, b = floors[i], bounds[i]
            open_ = [(-b[0], 0)]
            while open_ and -open_[0][0] >= floor:
                _, node = heapq.heappop(open_)
                if node < first_leaf:
                    for child in (2 * node + 1, 2 * node + 2):
                        if b[child] >= floor and self.spans[child][1] > self.spans[child][0]:
                            heapq.heappush(open_, (-b[child], child))
                    continue
                a, z = self.spans[node]
                scores = self.vecs[a:z] @ q[i] if exact else (whole[a:z] * queries[i]).sum(1)
                near = np.flatnonzero((scores >= floor) & (self.ids[a:z] != own))
                if len(near) > k:
                    kth = np.sort(scores[near])[len(near) - k]
                    near = near[scores[near] >= kth]
                for s, v in zip(scores[near].tolist(), self.ids[a:z][near].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
                if len(best) == k:
                    floor = max(floor, best[0][0])
            out += [(own, -v, int(s)) for s, v in best]
        return out


def _scaled(scale: int):
    """Rows (vec_id, dim, vec): floor(scale * x) as bytes of int64; vectors that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vecs = [], [], []
            for v, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if v is None or not x.is_valid:
                    continue
                y = np.floor(scale * np.array([math.nan if c is None else c for c in x.as_py()], np.float64))
                if not np.isfinite(y).all():
                    continue
                if (np.abs(y) >= 2**62).any():
                    raise OverflowError(f"vector {v}: a component times {scale} does not fit in 64 bits")
                ids.append(v)
                dims.append(len(y))
                vecs.append(y.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "vec"])

    return run


def _save(path: str, **arrays: np.ndarray) -> None:
    held = io.BytesIO()
    np.savez(held, **arrays)
    with writing(path) as out:
        out.write(held.getvalue())


def _load(path: str) -> dict[str, np.ndarray] | None:
    """None if there is no such file."""
    if size_of(path) is None:
        return None
    with opened(path) as source:
        return dict(np.load(io.BytesIO(source.read())))


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("vec").to_pylist()), "<i8").reshape(t.num_rows, dim)


def _write_tree(folder: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        tree = KDTree(np.repeat(t.column("vec_id").to_numpy(), t.column("copies").to_numpy()), np.repeat(_matrix(t, dim), t.column("copies").to_numpy(), axis=0))
        _save(f"{folder}/tree-{dim}-{shard}", ids=tree.ids, vecs=tree.whole, spans=np.array(tree.spans), low=tree.low, high=tree.high)
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    return run


def _write_queries(folder: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, block = (x.as_py() for x in key)
        _save(f"{folder}/queries-{dim}-{block}", ids=t.column("vec_id").to_numpy(), vecs=_matrix(t, dim))
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    return run


_OUT = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def _search(folder: str, k: int, dims: list[tuple[int, int, int]], home: bool):
    """From rows (dim, shard, first block, last block): what each block finds in that tree.

    A block's home is tree ``block mod shards``. The home round writes each
    query's k-th score beside its block; the other round reads it.
    """
    shards_of = {d: s for d, s, _ in dims}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, shard, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                found = _load(f"{folder}/tree-{dim}-{shard}")
                tree = KDTree.of(**found) if found else None
                for block in range(first, last + 1):
                    if (block % shards_of[dim] == shard) != home:
                        continue
                    q = _load(f"{folder}/queries-{dim}-{block}")
                    if q is None:
                        continue
                    floors = [-math.inf] * len(q["ids"])
                    if not home:
                        known = _load(f"{folder}/floors-{dim}-{block}")
                        floors = [s if ok else -math.inf for s, ok in zip(known["kth"].tolist(), known["ok"].tolist())]
                    rows = tree.search(q["ids"], q["vecs"], floors, k) if tree else []
                    if home:
                        scores: dict[int, list[int]] = {}
                        for i, _, s in rows:
                            scores.setdefault(i, []).append(s)
                        full = [scores.get(i, []) for i in q["ids"].tolist()]
                        _save(f"{folder}/floors-{dim}-{block}", kth=np.array([min(s) if len(s) == k else 0 for s in full], np.int64), ok=np.array([len(s) == k for s in full]))
                    columns = list(zip(*rows)) if rows else [[] for _ in _OUT]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for (_, t), c in zip(_OUT, columns)], [n for n, _ in _OUT])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best others by inner product.

    Components become floor(scale * x). Queries: ids divisible by ``every``.
    Ties go to the smaller vec_id. A query compares with vectors of its own
    length, an empty one with empty ones at score 0. Vectors that are null or
    hold a null or non-finite component take no part, nor do those with a null
    id. A component whose scaled size is 2**62 or more is an error, as is a
    score that does not fit in 64 bits; all below is exact. Candidates with
    the query's own id are never its results; a repeated id counts once for each
    row, of which more than k equal ones can't matter. A repeated id with other
    vectors asks once for each, and its best k together are its result.
    """
    spark = vectors.sparkSession
    folder = fresh(spark, "topk")
    make_dir(folder)
    v = narrow(vectors, vec_id=F.col(id_col).cast("bigint"), vec=F.col(vec_col))
    v = v.mapInArrow(_scaled(scale), "vec_id long, dim int, vec binary")
    v = stored(v.groupBy("vec_id", "dim", "vec").agg(F.least(F.count("*"), F.lit(k)).alias("copies")), "scaled")
    asks = F.pmod("vec_id", F.lit(every)) == 0
    # A row a length of vector.
    sizes = v.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asks).alias("m")).where("m > 0").collect()
    dims = [(r.dim, max(1, math.ceil(r.n / SHARD)), max(1, math.ceil(r.m / QUERIES))) for r in sizes]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    plan = F.broadcast(spark.createDataFrame(dims, "dim int, shards int, blocks int"))
    v = v.join(plan, "dim")
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vec"), F.col(n)).cast("int")
    trees = v.withColumn("shard", dealt(0, "shards")).select("dim", "shard", "vec_id", "vec", "copies")
    trees.groupBy("dim", "shard").applyInArrow(_write_tree(folder), "n long").agg(F.sum("n")).collect()
    asked = v.where(asks).withColumn("block", dealt(1, "blocks")).select("dim", "block", "vec_id", "vec")
    asked.groupBy("dim", "block").applyInArrow(_write_queries(folder), "n long").agg(F.sum("n")).collect()

    def met(home: bool) -> DataFrame:
        # Rows (tree, run of blocks), never vectors; a run is cut short where trees alone would not fill the cluster.
        run = 1 if home else 8
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(run))).alias("first")
        rows = plan.select("dim", "shards", "blocks", block).select("dim", F.pmod("first", "shards").alias("shard") if home else F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "first", F.least(F.col("first") + run - 1, F.col("blocks") - 1).alias("last"))
        tasks = sum(-(-b // run) * (1 if home else s) for _, s, b in dims)
        rows = rows.repartition(min(tasks, MOST_TASKS))
        return rows.mapInArrow(_search(folder, k, dims, home), "query_id long, vec_id long, score long")

    seen = stored(met(True), "first")
    if any(s > 1 for _, s, _ in dims):
        seen = seen.unionAll(met(False))
    ranked = seen.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
