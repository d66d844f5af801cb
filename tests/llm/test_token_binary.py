import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm.registry import op8_token_binary, vocabulary
from ledgerloom.llm.token_binary import PlaneReader, PlaneWriter, WordEncoder, encoder, from_planes, to_planes, token_binary, write_tokens

TOKENIZER = vocabulary("word_bpe_49k.json")


def whole(text):
    return encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 64, 1001):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (from_planes(to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_over_chunks(kind):
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, n, dtype=np.uint32)) for i, n in enumerate([0, 1, 99, 100, 101, 350, 0, 3])]
    out = io.BytesIO()
    w = PlaneWriter(out, kind, block=100)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = PlaneReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(d, x.tolist()) for d, x in r] == [(d, x.tolist()) for d, x in docs]
    flat = np.concatenate([x for _, x in docs])
    assert r.ids(95, 210).tolist() == flat[95:305].tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcXYZéÉßñ'.,!<|> \n\t ́ st1²ǅİΣς日-’&"), max_size=40))
def test_words_encode_as_whole_texts(text):
    assert np.frombuffer(encoder(TOKENIZER).encode(text), "<u4").tolist() == whole(text)


def test_special_strings():
    for t in ("a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|endoftext|>y.", "don't We'LL it's"):
        assert np.frombuffer(encoder(TOKENIZER).encode(t), "<u4").tolist() == whole(t)


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["The", "cat,", "Étude", "naïve!", "x1", "don't"]) for _ in range(rng.randrange(60))), "z") for i in rng.sample(range(1000), 80)]
    rows += [(5000, None, "z"), (5001, "", "z"), (5002, "a b", "z"), (5002, "a b", "z"), (None, "n", None), (5003, "long " * 70_000, "z")]
    got = token_binary(spark.createDataFrame(rows, "doc_id long, text string, start string"), TOKENIZER).collect()
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(whole(t) + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_null_ids_are_spread(spark, tmp_path):
    rows = [(None if i % 10 else i, f"word{i} more text") for i in range(1000)]
    files = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), TOKENIZER).collect()
    assert sum(f.n_docs for f in files) == 1000 and max(f.n_docs for f in files) < 500


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("ledgerloom.llm.token_binary.REMEMBERED", 2)
    t = "One two, three four. two THREE one! \u00fcber x<y one"
    assert np.frombuffer(WordEncoder(TOKENIZER).encode(t), "<u4").tolist() == whole(t)


def test_empty_table(spark):
    assert token_binary(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_registered_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op8_token_binary(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in docs:
        ids = np.array(whole(d.text) + [1], "<u4")
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
