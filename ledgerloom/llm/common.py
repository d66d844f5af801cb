"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerloom.storage import stored

#: The bytes that separate words: space and tab to carriage return. ``bytes.split`` splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts in which rows reach the driver one after another.
STREAMED = 8


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **cols) -> DataFrame:
    """Only the named inputs, under names of our own, so extra or clashing columns can't matter."""
    return df.select(*(df[c].alias(k) if isinstance(c, str) else c.alias(k) for k, c in cols.items()))


def free(names: list[str], want: str) -> str:
    """``want``, with underscores appended while a column has that name in any case."""
    taken = {n.lower() for n in names}
    while want.lower() in taken:
        want += "_"
    return want


def as_int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task derives from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Forest:
    """Union-find over hashable nodes; a root is its tree's least node."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def streamed(df: DataFrame, parts: int = STREAMED) -> Iterator:
    """Rows for the driver, a part after another: each part is a job, so they are few, however many partitions ``df`` has."""
    return df.repartition(parts).toLocalIterator()


def _gathered(df: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], np.ndarray], join: np.ufunc, size: int, kind: type) -> np.ndarray:
    """The arrays ``cells(batches)`` of all tasks, of ``size`` numbers each, joined by ``join``.

    Each task sends its own compressed in blocks; the blocks are joined by block
    number. What reaches the driver is always ``size`` numbers, whatever the
    input, so one job fetches it: a job a partition would fill the driver with their records.
    """
    block = min(size, 1 << 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells(batches)
        if own.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(size // block), pa.int32()), "v": pa.array([pack(x.tobytes()) for x in own.reshape(-1, block)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = join(total.get(k, kind(0)), np.frombuffer(unpack(v), kind))
        pack = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_pydict({"k": pa.array(total, pa.int32()), "v": pa.array([pack(x.tobytes()) for x in total.values()], pa.binary())})

    out = np.zeros(size, kind).reshape(-1, block)
    unpack = zstandard.ZstdDecompressor().decompress
    for row in df.mapInArrow(count, "k int, v binary").repartition(min(16, size // block), "k").mapInArrow(add, "k int, v binary").collect():
        out[row.k] = np.frombuffer(unpack(row.v), kind)
    return out.reshape(-1)


def summed(df: DataFrame, slots: Callable[[pa.RecordBatch], np.ndarray], bits: int, name: str) -> np.ndarray:
    """Counts of ``slots(batch)`` over all rows, in ``2**bits`` cells."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        cells = np.zeros(size, np.int64)
        for batch in pieces(batches):
            cells += np.bincount(slots(batch), minlength=size)
        return cells

    return _gathered(df, count, np.add, size, np.int64)


def marked(df: DataFrame, slots: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Which of ``2**bits`` cells some row has among its ``slots(batch)``: a bit a cell, the lowest of a byte first."""

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        cells = np.zeros(1 << bits, np.bool_)
        for batch in batches:
            cells[slots(batch)] = True
        return np.packbits(cells, bitorder="little")

    return _gathered(df, mark, np.bitwise_or, max(1, (1 << bits) // 8), np.uint8)


__all__ = ["WORD", "Forest", "as_int64", "free", "marked", "narrow", "pieces", "stored", "streamed", "summed", "table", "F", "pa", "np"]
