import hashlib
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import oracles
from ledgerloom.llm.registry import op5_warc
from ledgerloom.llm.warc import gzip_member, parsed, read_warc, record, records_in, warc_round_trip, write_warc
from ledgerloom.storage import stored


def archive(n=40):
    rng = random.Random(5)
    parts = []
    for i in range(n):
        payload = rng.randbytes(rng.randrange(3000)) + b"\x1f\x8b\x08\x00WARC/1.1\r\n" * rng.randrange(3)
        parts.append(gzip_member(record(i, f"http://x/{i}", payload, "0", None, False), level=rng.choice([0, 6])))
    return b"".join(parts)


@pytest.mark.parametrize("span", [1, 7, 100, 1000, 10**9])
def test_every_record_belongs_to_one_range(span):
    data = archive(12 if span < 10 else 40)
    whole = list(records_in(io.BytesIO(data), len(data), 0, len(data)))
    assert len(whole) == (12 if span < 10 else 40)
    cut = [r for s in range(0, len(data), span) for r in records_in(io.BytesIO(data), len(data), s, min(s + span, len(data)))]
    assert cut == whole


def test_garbage_and_truncation():
    data = archive(3)
    assert list(records_in(io.BytesIO(b""), 0, 0, 0)) == []
    assert list(records_in(io.BytesIO(b"\x1f\x8b\x08" * 50), 150, 0, 150)) == []
    assert len(list(records_in(io.BytesIO(b"junk" + data + b"tail"), len(data) + 8, 0, len(data) + 8))) == 3
    assert len(list(records_in(io.BytesIO(data[:-5]), len(data) - 5, 0, len(data) - 5))) == 2
    other = gzip_member(b"no record")
    assert len(list(records_in(io.BytesIO(other + data), len(data + other), 0, len(data + other)))) == 3


def test_record_round_trip():
    r = parsed(record(7, "http://a b\r\nX: y", "é\r\n\r\nz".encode(), "d", None, False))
    assert r["payload"].decode() == "é\r\n\r\nz" and r["fields"]["warc-record-id"] == "<urn:page:7>" and "x" not in r["fields"]


def test_edge_rows(spark):
    long = "y" * 1200
    rows = [(1, "u", long, "q"), (2, "u", long, "q"), (9, None, long, None), (9, None, long, None), (3, "u", None, "q"), (4, "u", "", "q"), (5, "u", "short", "q"), (6, "u", "short", "q"), (None, "u", long, "q"), (7, "u", "é" * 300_000, "q")]
    got = sorted(map(tuple, warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).drop("url", "payload").collect()), key=str)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), *(("revisit", 9) if h == long and p != 9 else ("response", None))) for p, _, h, _ in rows]
    assert got == sorted(want, key=str)
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reading_is_split(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", rng.randbytes(1500).hex() if i % 3 else "same " * 400) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = read_warc(stored(write_warc(df, str(tmp_path)), "manifest"), span=20_000)
    assert got.rdd.getNumPartitions() > 8
    assert sorted(r.page_id for r in got.collect()) == list(range(200))
    assert len({r.p for r in got.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 4
    assert {r.refers_to for r in got.where("record_type = 'revisit'").collect()} == {198}


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view pages as select * from '{d}/pages.parquet'")
    want = duckdb.sql(oracles.WARC).fetchall()
    assert sorted(map(tuple, op5_warc(spark, d).collect()), key=str) == sorted(want, key=str)
