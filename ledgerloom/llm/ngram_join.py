"""Exact n-gram Jaccard join: a grouped prefix join over word shingles.

How it stays linear where copies and shared passages abound:

1. Every document becomes the set of 64-bit hashes of its distinct word
   shingles. A fixed-size table of shingle counts, taken over all documents,
   orders shingles from rare to frequent. Its cells fill up as the input grows, so
   shingles that are common in a part of the texts are named and come last:
   otherwise shared passages would reach the prefixes and tie everything together.
2. Two sets that reach the threshold share a shingle among their rarest
   ``n - ceil(t n) + 1`` (the prefix). Documents with the same size and prefix
   form one group.
3. Groups that stand in one posting list are candidates. A list of at most
   ``LIST`` groups gives its pairs of fitting sizes, each once, and bitmaps of
   the sets remove those that provably can't link. A longer list of k groups
   gives at most k - 1 ties instead, never its pairs. The components of pairs
   and ties hold every candidate pair.
4. Each component's groups are expanded to their different texts, whose sets
   are read again from the documents, once each. Components are cut into
   blocks; a task gets two blocks and finds their links by exact intersection
   sizes. It returns a spanning forest of the links, not the links.
5. Components of those links, then the least doc_id of each.

Equal texts (after lower-casing and splitting) count once from step 3 on.
Nothing is dropped or capped; the part of the texts that names common shingles
decides the order alone, and any order gives the same links. Hashes: texts by 128 bits throughout,
shingles by 64; a false link would need a collision of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import Forest, as_int64, marked, narrow, pieces, stored, summed
from ledgerloom.operators.graph import connected_components

#: Cells of the table of shingle counts (8 MB in a task, 1 MB of levels in a broadcast).
CELL_BITS = 20
#: One different text in PART tells which shingles are common: those that COMMON of its texts have, and of these
#: the MOST commonest at most (9 MB in a broadcast). A shingle left out keeps its level, which costs time only.
PART, COMMON, MOST = 8, 3, 1 << 20
#: Levels of cells are below this one, ranks of common shingles from here to 255.
RANKS = 240
#: Cells of the bitmap that keeps texts without candidates from being read again (1 MB).
SEEN_BITS = 23
#: Texts of a block; a task holds two blocks.
BLOCK = 512
#: Groups of a posting list that gives its pairs; longer lists give ties.
LIST = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_x64 = xxhash.xxh64_intdigest


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of fewer words, the whole sequence is one."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([_x64(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_x64, words), np.uint64, len(words))
    m = len(h) - k + 1
    a = h[:m].copy()
    for j in range(1, k):
        a ^= a >> np.uint64(29)
        a *= _MIX
        a += h[j : j + m]
    a ^= a >> np.uint64(32)
    a *= _MIX
    a ^= a >> np.uint64(29)
    a.sort()
    return a[np.concatenate(([True], a[1:] != a[:-1]))]


def needed(n: int, num: int, den: int) -> int:
    """Least overlap that a set of n shingles can link with: ceil(n * num / den)."""
    return -(-n * num // den)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _text_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _common(d: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common shingles of ``d`` (text, hash) and their ranks from RANKS to 255, the commonest highest.

    Equal texts count once. A rank is the binary logarithm of the count; from the
    highest rank down, those ranks are taken whose shingles are MOST together at most.
    """
    texts = d.where(F.col("text").isNotNull() & (F.pmod("hash", F.lit(PART)) == 0)).dropDuplicates(["hash"]).select("text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingle_hashes(words_of(t.as_py()), k) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([as_int64(np.concatenate(found))], ["token"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (token.astype(np.int64), rank.astype(np.uint8))], ["token", "rank"])

    counts = texts.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    counts = stored(counts.select("token", F.least(F.lit(255), F.lit(RANKS) + F.floor(F.log2("c"))).cast("int").alias("rank")), "common")
    lowest, total = 256, 0
    for r in sorted(counts.groupBy("rank").count().collect(), reverse=True):  # 16 rows at most
        total += r["count"]
        if total > MOST:
            break
        lowest = r["rank"]
    rows = [(bytes(r.token), bytes(r["rank"])) for r in counts.where(F.col("rank") >= lowest).mapInArrow(packed, "token binary, rank binary").collect()]  # MOST at most, packed
    token, rank = np.frombuffer(b"".join(x for x, _ in rows), np.uint64), np.frombuffer(b"".join(x for _, x in rows), np.uint8)
    order = np.argsort(token)
    return token[order], rank[order]


def _prefixes(levels: np.ndarray, common: np.ndarray, ranks: np.ndarray, k: int, num: int, den: int):
    """Rows (doc_id, hash, key, n, gid, prefix, bits); the last two only where the task meets a group first.

    gid is 64 bits of the group's hash, to keep posting lists small. Groups that
    happen to share it both send their prefixes, so that they only look for
    partners together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            keys, ns, gids, prefixes, bits = [], [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                h = shingle_hashes(words, k)
                n = len(h)
                keys.append(_text_key(words))
                ns.append(n)
                if not n:
                    gids.append(None)
                    prefixes.append(None)
                    bits.append(None)
                    continue
                size = n - needed(n, num, den) + 1
                level = levels[_cells(h)]
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    level = np.where(common[at] == h, ranks[at], level)
                order = (level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                p = np.sort(h[np.argpartition(order, size - 1)[:size]] if size < n else h)
                group = xxhash.xxh3_128_intdigest(p.tobytes(), seed=n)
                gids.append((group & (1 << 64) - 1) - (1 << 63))
                if group in seen:
                    prefixes.append(None)
                    bits.append(None)
                else:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(group)
                    prefixes.append(p.view(np.int64))
                    bits.append(_signature(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(gids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "hash", "key", "n", "gid", "prefix", "bits"])

    return run


def _candidates(num: int, den: int):
    """From rows (token, n, gid) in that order: rows (a, b, tie) of groups that share a token.

    A list of up to LIST groups gives its pairs of fitting sizes, each once a
    task. A longer one gives ties between neighbours of fitting sizes, whose
    components hold all its pairs; of these the task keeps a spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, pairs, done = Forest(), set(), set()
        token, held, long = None, [], False  # the list that the next rows may continue

        def close() -> None:
            if long:
                return
            for (n, a), (m, b) in combinations(held, 2):
                if a != b and den * n >= num * m:
                    pairs.add((a, b) if a < b else (b, a))

        def extend(ns: list[int], gs: list[int]) -> None:
            nonlocal held, long
            held += zip(ns, gs)
            if len(held) > LIST:
                for (n, a), (m, b) in zip(held, held[1:]):
                    if a != b and den * n >= num * m:
                        forest.join(a, b)
                long, held = True, held[-1:]

        for batch in batches:
            if not batch.num_rows:
                continue
            t, n, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
            size = np.diff(cuts)
            two = cuts[1:-2][size[1:-1] == 2] if len(size) > 2 else cuts[:0]
            two = two[(den * n[two] >= num * n[two + 1]) & (g[two] != g[two + 1])]
            pairs.update(zip(np.minimum(g[two], g[two + 1]).tolist(), np.maximum(g[two], g[two + 1]).tolist()))
            runs = np.unique(np.concatenate(([0], np.flatnonzero(size > 2), [len(size) - 1])))
            for r in runs.tolist():
                i, j = int(cuts[r]), int(cuts[r + 1])
                if t[i] != token:
                    close()
                    token, held, long = t[i], [], False
                for at in range(i, j, LIST):
                    ns, gs = n[at : min(j, at + LIST)].tolist(), g[at : min(j, at + LIST)].tolist()
                    if long:
                        for (x, a), (y, b) in zip([held[-1], *zip(ns, gs)], zip(ns, gs)):
                            if a != b and den * x >= num * y:
                                forest.join(a, b)
                        held = [(ns[-1], gs[-1])]
                    else:
                        extend(ns, gs)
            if len(pairs) > 50_000:
                yield _pair_rows(pairs - done, False)
                done = pairs if len(done) > 1_000_000 else done | pairs
                pairs = set()
            if len(forest.up) > 1_000_000:
                yield _forest_rows(forest)
                forest = Forest()
        close()
        yield _pair_rows(pairs - done, False)
        yield _forest_rows(forest)

    return run


def _pair_rows(pairs, tie: bool) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([tie] * len(a), pa.bool_())], ["a", "b", "tie"])


def _signature(h: np.ndarray) -> bytes:
    """Bitmap of a set: bit ``hash mod size`` for each shingle, at least two bits a shingle."""
    bits = np.zeros(max(64, 1 << int(2 * len(h) - 1).bit_length()), np.uint8)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(n: int, x: bytes, m: int, y: bytes, num: int, den: int) -> bool:
    """False only if the bitmaps prove that the sets can't link.

    A bit of one that the other lacks is a shingle that the other lacks, so it
    bounds the overlap from above. The larger bitmap is folded to the smaller.
    """
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)
    elif len(b) > len(a):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    c = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return den * c >= num * (n + m - c)


def _fitting(num: int, den: int):
    """Rows (a, b, n, x, m, y): those whose bitmaps allow a link; an unknown size or bitmap does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [None in (n, x, m, y) or may_link(n, x, m, y, num, den) for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _forest_rows(forest: Forest) -> pa.RecordBatch:
    pairs = [(x, r) for x in forest.up if (r := forest.find(x)) != x]
    return _pair_rows(pairs, True)


def _sets_of(marks: np.ndarray, k: int):
    """Rows (rep, key, words' set as bytes) of the documents that the bitmap marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = len(marks) * 8 - 1
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64) & mask
            rows = np.flatnonzero(marks[ids >> 3] & (1 << (ids & 7)).astype(np.uint8))
            out, held = [], 0
            for i in rows.tolist():
                words = words_of(batch.column(1)[i].as_py())
                if not words:
                    continue
                s = shingle_hashes(words, k).tobytes()
                out.append((batch.column(0)[i].as_py(), _text_key(words), s))
                held += len(s)
                if held > 16_000_000:
                    yield _set_rows(out)
                    out, held = [], 0
            if out:
                yield _set_rows(out)

    return run


def _set_rows(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["rep", "key", "shingles"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of every set on the left with every one on the right."""
    both = np.concatenate(left + right)
    tokens, where = np.unique(both, return_inverse=True)
    count = np.bincount(where)
    keep = np.full(len(tokens), -1, np.int64)
    often = np.flatnonzero(count > 1)
    keep[often] = np.arange(len(often))
    col = keep[where]
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    row, col = row[col >= 0], col[col >= 0]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 4096
    for at in range(0, len(often), step):
        i, j = np.searchsorted(col, (at, at + step))
        m = np.zeros((len(left) + len(right), min(step, len(often) - at)), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total


def _links(num: int, den: int):
    """Rows (cluster, i, j, block, key, shingles) sorted by the first three: forest of links of each task's pair of blocks."""

    def solve(rows: list) -> list[tuple[bytes, bytes]]:
        texts = {r[4]: r for r in rows}
        if len(texts) < 2:
            return []
        sides: tuple[list, list] = ([], [])
        for r in texts.values():
            sides[int(r[3] != r[1])].append((r[4], np.frombuffer(r[5], np.uint64)))
        left, right = sides
        forest = Forest()
        if not right and len(left) <= 8:
            for (a, x), (b, y) in combinations(left, 2):
                if len(x) * num <= len(y) * den and len(y) * num <= len(x) * den and forest.find(a) != forest.find(b):
                    c = len(np.intersect1d(x, y, assume_unique=True))
                    if den * c >= num * (len(x) + len(y) - c):
                        forest.join(a, b)
        else:
            other = right or left
            c = overlaps([x for _, x in left], [x for _, x in other])
            n, m = (np.array([len(x) for _, x in s], np.float64) for s in (left, other))
            for i, j in zip(*np.nonzero(den * c.astype(np.float64) >= num * (n[:, None] + m[None, :] - c))):
                if left[i][0] != other[j][0]:
                    forest.join(left[i][0], other[j][0])
        return [(x, r) for x in forest.up if (r := forest.find(x)) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] != at:
                    found += solve(rows)
                    at, rows = r[:3], []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])
        found = solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    return run


def _rooted(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Rows (doc_id, hash, n, key, gid, root, least): root names the class of linked texts, least is its least doc_id; all three are null without words."""
    spark = docs.sparkSession
    d = narrow(docs, doc_id=docs[id_col].cast("bigint"), text=text_col, hash=F.xxhash64(docs[text_col]))
    texts = d.where(F.col("text").isNotNull()).select("text")

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        found = [shingle_hashes(words_of(t.as_py()), k) for t in batch.column(0)]
        return _cells(np.concatenate(found)) if found else np.empty(0, np.int64)

    counts = summed(texts, cells, CELL_BITS, "shingles")
    levels = np.minimum(RANKS - 1, np.round(8 * np.log2(counts + 1))).astype(np.uint8)
    shared = spark.sparkContext.broadcast((levels, *_common(d, k)))

    def prefixes(batches):
        return _prefixes(*shared.value, k, num, den)(batches)

    parts = stored(d.mapInArrow(prefixes, "doc_id long, hash long, key binary, n long, gid long, prefix array<long>, bits binary"), "prefixes")
    lists = parts.where("prefix is not null").select(F.explode("prefix").alias("token"), "n", "gid")
    lists = lists.repartition("token").sortWithinPartitions("token", "n", "gid")
    found = stored(lists.mapInArrow(_candidates(num, den), "a long, b long, tie boolean"), "candidates")
    pairs = found.where("not tie").select("a", "b").distinct()
    # A group of several texts has no bitmap that holds for all of them.
    of = parts.where("gid is not null").groupBy("gid").agg(F.when(F.min("n") == F.max("n"), F.min("n")).alias("n"), F.when(F.min("key") == F.max("key"), F.first("bits", ignorenulls=True)).alias("bits"))
    of = stored(of.join(pairs.select(F.explode(F.array("a", "b")).alias("gid")), "gid", "left_semi"), "bitmaps")
    pairs = pairs.join(of.selectExpr("gid as a", "n", "bits as x"), "a").join(of.selectExpr("gid as b", "n as m", "bits as y"), "b").select("a", "b", "n", "x", "m", "y")
    pairs = pairs.mapInArrow(_fitting(num, den), "a long, b long")
    clusters = connected_components(pairs.unionAll(found.where("tie").select("a", "b")))

    # Different texts, each with the document that stands for it; those with no possible partner go.
    classes = parts.where("gid is not null").groupBy("key", "gid").agg(F.min("doc_id").alias("rep"))
    placed = classes.join(clusters.withColumnRenamed("node", "gid"), "gid", "left").select("key", "rep", F.coalesce("root", "gid").alias("cluster"))
    placed = stored(placed, "classes")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(placed.join(sizes, "cluster").withColumn("q", F.ceil(F.col("m") / BLOCK)), "members")

    def slot(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64) & ((1 << SEEN_BITS) - 1)

    marks = spark.sparkContext.broadcast(marked(members.select("rep"), slot, SEEN_BITS))

    def sets(batches):
        return _sets_of(marks.value, k)(batches)

    sets_of = d.select("doc_id", "text").mapInArrow(sets, "rep long, key binary, shingles binary")
    full = sets_of.alias("s").join(members.alias("m"), (F.col("s.key") == F.col("m.key")) & F.col("s.rep").eqNullSafe(F.col("m.rep")))
    block = F.expr("cast(pmod(xxhash64(m.key), m.q) as int)")
    full = full.select("m.cluster", block.alias("block"), F.expr("cast(m.q as int)").alias("q"), "m.key", "s.shingles")
    dealt = full.withColumn("other", F.explode(F.expr("sequence(0, q - 1)"))).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "shingles")
    links = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_links(num, den), "a binary, b binary")
    linked = connected_components(links).withColumnRenamed("node", "key")

    # One row a different text first; only then the documents, in one join.
    rooted = placed.join(linked, "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    rooted = rooted.join(least, "root").select("key", "root", "least")
    rows = parts.select("doc_id", "hash", "n", F.when(F.col("gid").isNotNull(), F.col("key")).alias("key"), "gid").join(rooted, "key", "left")
    return stored(rows, "rooted")


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Classes of documents whose shingle sets link at ``den * intersection >= num * union``.

    One row per input row: ``doc_id, n_shingles, component_id, key``, where
    key names the lower-cased word sequence by 128 bits (null without words) and
    component_id is the least doc_id that links reach. A null or blank text has no
    shingles and links with nothing: it is its own component. Rows with a null doc_id
    take part by their text; a component without any doc_id has a null one. Repeated
    rows stay.
    """
    rows = _rooted(docs, id_col, text_col, k, num, den)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("gid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The input's rows and columns, one row of each class: that of the least doc_id.

    A null doc_id comes last; equal ids are ordered by a hash of the text, and of
    repeated rows with the same id and text one stays. Rows without words link
    with nothing and all stay.
    """
    rows = _rooted(docs, id_col, text_col, k, num, den).where("gid is not null")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "hash")).alias("w"))
    same = rows.groupBy("doc_id", "hash").agg(F.count("*").alias("copies"))
    kept = first.select(F.col("w.doc_id").alias("_id"), F.col("w.hash").alias("_hash"))
    kept = kept.join(same, kept["_id"].eqNullSafe(same["doc_id"]) & (kept["_hash"] == same["hash"])).select("_id", "_hash", "copies")
    words = F.btrim(F.coalesce(docs[text_col], F.lit("")), F.lit(" \t\n\x0b\f\r")) != ""
    names = docs.columns
    found = docs.where(words).join(kept, (F.xxhash64(docs[text_col]) == kept["_hash"]) & docs[id_col].cast("bigint").eqNullSafe(kept["_id"]))
    once = found.where(kept["copies"] == 1).select(*(docs[c] for c in names))
    more = found.where(kept["copies"] > 1).withColumn("_ledgerloom_row", F.row_number().over(Window.partitionBy(kept["_hash"], kept["_id"]).orderBy(F.lit(0))))
    more = more.where("_ledgerloom_row = 1").select(*(docs[c] for c in names))
    return docs.where(~words).unionAll(once).unionAll(more)
