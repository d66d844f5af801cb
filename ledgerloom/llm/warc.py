"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader does not need an index: a
task gets a byte range, scans it for the gzip magic, and takes a candidate as a
member only if what it decodes to begins with a WARC version line and a whole
header. It owns the records that start inside its range, reads the last one
past the range's end, and skips a member once it is read, so magic bytes
inside compressed data are met only at a range's start, where they fail to
decode. Every record is read by exactly one task, wherever the ranges are cut.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import narrow
from ledgerloom.llm.files import make_dir, opened, size_of, writing
from ledgerloom.storage import fresh, stored

#: Least payload for which an equal one is written as a revisit.
REVISIT_BYTES = 1000
#: Bytes of a read range.
RANGE = 4 << 20
#: Parts of a payload's pages when they look for its response.
SALTS = 16
#: Tasks that ranges are dealt to at most.
MOST_TASKS = 50_000
PIECE = 1 << 18

_GZIP = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not yet compressed. A revisit keeps the HTTP header, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 6) -> DataFrame:
    """Write one record a row; returns the manifest ``part, path, size, records``, a row a file.

    Payload: the html in UTF-8, a null one empty. Of equal payloads of at least
    1000 bytes the one with the largest id is a response, others revisit it;
    repeated rows of that id are responses too. A null id is below all others.
    A null url leaves out the target header.
    """
    p = narrow(pages, page_id=F.col(id_col).cast("bigint"), url=F.col(url_col), payload=F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary")))
    p = p.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    # Narrow rows only: digests that occur more than once, with the response of each.
    keys = p.where(F.col("bytes") >= REVISIT_BYTES).select("digest", "page_id")
    last = keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    # Salted, as one payload may stand on a third of all pages.
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(last, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("digest").alias("d2"), F.col("page_id").alias("p2"), "last").distinct()
    rows = p.join(again, (p["digest"] == again["d2"]) & p["page_id"].eqNullSafe(again["p2"]), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "last", F.col("d2").isNotNull().alias("revisit"))
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, n = TaskContext.get().partitionId(), 0
        path = f"{folder}/part-{part:06d}.warc.gz"
        with writing(path) as stream:
            batch = first
            while batch is not None:
                for page_id, url, payload, digest, last, revisit in zip(*batch.columns):
                    stream.write(gzip_member(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), last.as_py(), revisit.as_py()), level))
                    n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "size": [size_of(path)], "records": [n]})

    return rows.mapInArrow(write, "part long, path string, size long, records long")


class _Window:
    """The bytes of a file from some position on, read piece by piece."""

    def __init__(self, source, size: int, at: int) -> None:
        self.source, self.size, self.at, self.data = source, size, at, b""

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes from ``at`` are there."""
        while len(self.data) < n and self.at + len(self.data) < self.size:
            self.source.seek(self.at + len(self.data))
            self.data += self.source.read(max(PIECE, n - len(self.data)))
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(source, size: int, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` decodes to and its end; None if none is there or no WARC record begins in it."""
    unpack, w, out, sure = zlib.decompressobj(31), _Window(source, size, at), [], False
    head = b""
    try:
        while not unpack.eof:
            if not w.fill(1):
                return None
            piece, n = w.data, len(w.data)
            got = unpack.decompress(piece)
            out.append(got)
            if not sure:
                head += got
                if not head.startswith(b"WARC/1."[: len(head)]) or (len(head) > 65_536 and b"\r\n\r\n" not in head):
                    return None
                sure = b"\r\n\r\n" in head
            w.skip(n - len(unpack.unused_data))
            if unpack.eof:
                break
    except zlib.error:
        return None
    return (b"".join(out), w.at) if sure else None


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the WARC records that start in [start, end)."""
    w = _Window(source, size, start)
    while w.at < end:
        w.fill(PIECE)
        i = w.data.find(_GZIP)
        if i < 0 or w.at + i >= end:
            if w.at + len(w.data) >= min(end + len(_GZIP), size) or i >= 0:
                return
            w.skip(max(1, len(w.data) - len(_GZIP) + 1))
            continue
        at = w.at + i
        if found := _member(source, size, at):
            yield at, found[0]
            w = _Window(source, size, found[1])
        else:
            w.skip(i + 1)


def parsed(data: bytes) -> dict:
    """Header fields (lower-case names), HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    http, _, payload = rest[: int(fields.get("content-length", 0))].partition(b"\r\n\r\n")
    return {"fields": fields, "http": http, "payload": payload}


_ID = re.compile(r"<urn:page:(-?\d*)>")
_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def _page(urn: str | None) -> int | None:
    return int(m[1]) if urn and (m := _ID.fullmatch(urn)) and m[1] else None


def read_warc(manifest: DataFrame, span: int = RANGE) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload`` of every record.

    Size and digest of a response are taken of its payload; a revisit states
    those of the full payload, which it leaves out (payload null). Ranges of
    ``span`` bytes are dealt to tasks, one each up to ``MOST_TASKS``; a range's task
    needs only the path. An empty archive gives no rows.
    """
    n = manifest.agg(F.sum(F.ceil(F.col("size") / span))).first()[0]
    ranges = manifest.select("path", "size", F.explode(F.expr(f"sequence(0, size - 1, {span})")).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + span, F.col("size")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                out, held = [], 0
                with opened(path) as source:
                    for _, data in records_in(source, size, start, end):
                        r = parsed(data)
                        f, revisit = r["fields"], r["fields"].get("warc-type") == "revisit"
                        n = int(m[1]) if revisit and (m := _LENGTH.search(r["http"])) else len(r["payload"])
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(r["payload"]).hexdigest()
                        out.append((_page(f.get("warc-record-id")), n, digest, f.get("warc-type"), _page(f.get("warc-refers-to")), f.get("warc-target-uri"), None if revisit else r["payload"]))
                        held += len(data)
                        if held > 16 << 20:
                            yield _rows(out)
                            out, held = [], 0
                yield _rows(out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    # With a number, so that adaptive execution does not take these small rows together in one task.
    return ranges.repartition(max(1, min(n or 0, MOST_TASKS))).mapInArrow(read, schema)


_TYPES = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]


def _rows(out: list) -> pa.RecordBatch:
    columns = zip(*out) if out else ([],) * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for (_, t), c in zip(_TYPES, columns)], [n for n, _ in _TYPES])


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages as archives in the shared scratch folder and read them back."""
    return read_warc(stored(write_warc(pages, fresh(pages.sparkSession, "warc"), **columns), "manifest"))
