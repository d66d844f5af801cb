"""Each stage against a plain restatement, on the smallest tables."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerloom.llm.token_binary import encoder
from ledgerloom.storage import stored
from tests.llm.test_mixing import plain_targets
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(9001, None, None, "src0", 0), (9002, "123 !?", "en", None, 6), (9003, "", "en", "src1", 0), (9004, "Привет мир, это русский текст о погоде", None, "src1", 38)], docs.schema)
    df, columns, rows = docs.unionAll(more), docs.columns, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = [r.asDict() for r in df.collect()]
        out = stage(spark, df, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        df = spark.read.parquet(f"{tmp_path}/{i}")
        rows[name] = before, [r.asDict() for r in df.collect()]
        if i + 1 < len(pipeline.STAGES):
            assert df.columns == columns

    before, after = rows["language"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {9001, 9002, 9003, 9004}
    told = {r["doc_id"]: r["lang"] for r in before}
    assert all(r["lang"] for r in after) and np.mean([r["lang"] == told[r["doc_id"]] for r in after if told[r["doc_id"]]]) > 0.97

    before, after = rows["near_duplicates"]
    classes = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in classes.values()})

    before, after = rows["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in after}
    assert not any(t in r["text"] for r in after for t in items)
    lost = [r for r in before if r["doc_id"] not in kept]
    grams = {tuple(w[i : i + 8]) for w in (t.lower().split() for t in items) for i in range(len(w) - 7)}
    assert all(any(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7)) for w in (r["text"].lower().split() for r in lost))

    before, after = rows["mixture"]
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in before}
    sources = sorted({r["source"] for r in before})
    sizes = [sum(size[r["doc_id"]] for r in before if r["source"] == s) for s in sources]
    want = plain_targets(sizes)
    for s, t in zip(sources, want):
        # Draws are whole documents, so a source of a handful can miss by half of one.
        assert abs(sum(size[r["doc_id"]] for r in after if r["source"] == s) - t) <= max(size[r["doc_id"]] for r in before if r["source"] == s) / 2

    before, after = rows["token_files"]
    enc, start, expect = encoder(pipeline.vocabulary("word_bpe_49k.json")).tokenizer, 0, []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        ids = np.array([*enc.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        expect.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in after), key=lambda x: x[1]) == expect


def test_empty_table(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, df, DATA).count() == 0


def test_wanted_languages(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "LANGUAGES", {"de"})
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert {r.lang for r in pipeline.language(spark, docs, DATA).collect()} == {"de"}


def test_edge_rows(spark):
    """Nulls, blanks, repeated rows, a very long text and columns named like the stages' own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    long = " ".join(docs.where("lang = 'en'").agg(F.concat_ws(" ", F.collect_list("text"))).first()[0].split() * 12)
    more = [(None, None, None, None, None), (1, "", "en", "", 0), (90007, " \n ", None, None, 3), (90008, long, "en", "s", 1), (90009, long, "en", "s", 1), (90009, long, "en", "s", 1), (90010, f"The end. {item} The end.", "en", "s", 1)]
    df = docs.unionAll(spark.createDataFrame(more, docs.schema))
    own = ["mix", "Shard", "epoch", "place", "language", "quality_score", "root", "key", "h", "text_hash", "_ledgerloom_mix"]
    df = df.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in own))
    for name, stage in pipeline.STAGES[:-1]:
        before = df
        df = stored(stage(spark, df, DATA), name)
        assert df.columns == before.columns
        rows = df.collect()
        assert rows and all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in own)
        ids = [r.doc_id for r in rows]
        if name == "language":
            assert None not in ids and 90007 not in ids and ids.count(90009) >= 2
        if name == "near_duplicates":
            assert ids.count(90008) == 1 and 90009 not in [r.doc_id for r in rows if r.text == long]
        if name == "decontamination":
            assert not [r for r in rows if r.doc_id == 90010 and item in r.text]
    assert pipeline.token_files(spark, df, DATA).count() == df.count()
