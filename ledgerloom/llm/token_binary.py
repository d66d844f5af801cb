"""Token ids in compressed planes: a binary format, its writer and its reader.

File layout, all numbers little-endian:

    magic "LLPLANE1"
    chunks: for each, its planes one after another, each compressed with zstandard
    index:  zstandard of numpy int64 rows: for each chunk (offset, ids, plane sizes...),
            then for each document (doc_id, has_id, first id, ids)
    footer: chunks, documents, planes, index size (int64 each), plane kind, magic

A chunk holds ``block`` ids (the last may hold fewer). Its 32-bit ids are
transposed: plane p has byte p (or bit p) of every id, so the high planes are
almost constant and vanish under compression. A document may run over several
chunks; the index finds the chunks of any id range.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import narrow
from ledgerloom.llm.files import make_dir, opened, size_of, writing
from ledgerloom.storage import fresh, stored

MAGIC = b"LLPLANE1"
#: Ids of a chunk.
BLOCK = 65_536
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000

_FOOTER = struct.Struct("<qqqq8s8s")
#: A run of letters that the tokenizer leaves alone, then punctuation that it always parts from them.
_PLAIN = re.compile(r"([a-zß-öø-ÿāăąćĉċčďđēĕėęěőœśšźżž]+)([.,!?%&*$#|;:]*)\Z")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte or bit planes of 32-bit ids."""
    b = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(b[:, p]).tobytes() for p in range(4)]
    bits = np.unpackbits(b, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(n, 4).view("<u4").reshape(n)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(n)


class PlaneWriter:
    """Writes documents one after another; holds one chunk at most."""

    def __init__(self, stream, kind: str = "byte", block: int = BLOCK, level: int = 3) -> None:
        self.stream, self.kind, self.block = stream, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.chunks: list[int] = []
        self.docs: list[int] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs += (doc_id or 0, int(doc_id is not None), self.n_ids, len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(ids[i : i + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.pack(p) for p in to_planes(ids, self.kind)]
        self.chunks += (self.at, len(ids), *map(len, packed))
        for p in packed:
            self.stream.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        planes = 4 if self.kind == "byte" else 32
        index = self.pack(np.array(self.chunks + self.docs, "<i8").tobytes())
        self.stream.write(index)
        self.stream.write(_FOOTER.pack(len(self.chunks) // (planes + 2), len(self.docs) // 4, planes, len(index), self.kind.encode(), MAGIC))


class PlaneReader:
    """Reads a file by its index: any range of ids, or document after document."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - _FOOTER.size)
        chunks, docs, planes, length, kind, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        self.kind = kind.rstrip(b"\0").decode()
        source.seek(size - _FOOTER.size - length)
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), "<i8")
        self.chunks = index[: chunks * (planes + 2)].reshape(chunks, planes + 2)
        self.docs = index[chunks * (planes + 2) :].reshape(docs, 4)
        self.ends = np.cumsum(self.chunks[:, 1])
        self.kept: tuple[int, np.ndarray] | None = None

    def chunk(self, i: int) -> np.ndarray:
        if not self.kept or self.kept[0] != i:
            self.source.seek(int(self.chunks[i, 0]))
            unpack = zstandard.ZstdDecompressor().decompress
            self.kept = i, from_planes([unpack(self.source.read(int(n))) for n in self.chunks[i, 2:]], int(self.chunks[i, 1]), self.kind)
        return self.kept[1]

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from ``first``; only the chunks that hold them are read."""
        i, out = int(np.searchsorted(self.ends, first, "right")), []
        while n > 0:
            part = self.chunk(i)
            begin = first - (int(self.ends[i]) - len(part))
            out.append(part[begin : begin + n])
            first, n, i = first + len(out[-1]), n - len(out[-1]), i + 1
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for doc_id, known, first, n in self.docs.tolist():
            yield doc_id if known else None, self.ids(first, n)


class _Remembered(dict):
    """Ids as bytes by key; an unknown key is worked out once, and all are forgotten when there are too many."""

    def __init__(self, work) -> None:
        self.work = work

    def __missing__(self, key):
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[key] = self.work(key)
        return ids


class WordEncoder:
    """Ids of whole texts by a tokenizer that always splits at white space.

    Words repeat, so each different word is encoded once and its ids are
    remembered as bytes. A plain lower-case word goes straight to the
    tokenizer's own merge model, which normaliser and splitter would hand the
    same characters; any other word takes the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.mapped = _byte_letters()
        self.words, self.plain, self.other = _Remembered(self._word), _Remembered(self._plain), _Remembered(self._other)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "surrogatepass").split())) if text else b""

    def forget(self) -> None:
        """Give the memory back; a worker outlives its task."""
        for known in (self.words, self.plain, self.other):
            known.clear()

    def _word(self, word: bytes) -> bytes:
        if b"<" not in word and (m := _PLAIN.match(word.lower().decode("utf-8", "replace"))):
            letters, marks = m.groups()
            return self.plain[letters] + self.other[marks] if marks else self.plain[letters]
        return self.other[word.decode("utf-8", "replace")]

    def _plain(self, s: str) -> bytes:
        ids = [t.id for t in self.merge(s if s.isascii() else "".join([self.mapped[b] for b in s.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _other(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encode every whole text and write the ids in ascending id order.

    Range-partitions by id and a hash of the text, so each file holds an id range,
    files in order of ``part`` hold all, and an id that many rows share (a null one,
    say) is spread over files. Returns the manifest: ``part, path, size, n_docs, n_ids``,
    a row a file. A null text is empty, an empty one has only the end id; null
    ids come first; repeated rows are written as often as they occur. Ties of
    id are ordered by that hash, then by text. A task that is lost is run again and
    replaces its file.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = narrow(docs, doc_id=F.col(id_col).cast("bigint"), text=text, h=F.xxhash64(text))
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), next(batches, None)
        if first is None:
            return
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        path = f"{folder}/part-{part:06d}.planes"
        with writing(path) as stream:
            out = PlaneWriter(stream, kind, block)
            batch = first
            while batch is not None:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    out.add(doc_id.as_py(), np.frombuffer(enc.encode(text.as_py()) + end, "<u4"))
                batch = next(batches, None)
            out.close()
        enc.forget()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "size": [size_of(path)], "n_docs": [len(out.docs) // 4], "n_ids": [out.n_ids]})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = d.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return dealt.select("doc_id", "text").mapInArrow(write, "part long, path string, size long, n_docs long, n_ids long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, over all files. The
    manifest has a row a file; their running total is the only global step.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.select("part", "path", "size", "n_ids").collect())
    rows, before = [], 0
    for f in files:
        rows.append((f.part, f.path, f.size, before))
        before += f.n_ids
    plan = spark.createDataFrame(rows, "part long, path string, size long, before long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, before in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                with opened(path) as source:
                    r, out = PlaneReader(source, size), []
                    for (_, _, first, n), (doc_id, ids) in zip(r.docs.tolist(), r):
                        out.append((doc_id, before + first, n, zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        if len(out) == 10_000:
                            yield _doc_rows(out)
                            out = []
                    yield _doc_rows(out)

    return plan.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _doc_rows(out: list) -> pa.RecordBatch:
    columns = zip(*out) if out else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_binary(docs: DataFrame, tokenizer: str, kind: str = "byte", **columns) -> DataFrame:
    """Write all documents' ids into the shared scratch folder, then read them back."""
    manifest = stored(write_tokens(docs, fresh(docs.sparkSession, "tokens"), tokenizer, kind=kind, **columns), "manifest")
    return read_tokens(manifest)
