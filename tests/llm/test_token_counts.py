import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.registry import op7_token_counts, vocabulary
from ledgerloom.llm.token_counts import attribute, field_tokens, lines, section_tokens

RANKS, PATTERN = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text, ends, rule):
    """Counts by the tokenizers library's own character offsets, for ASCII texts."""
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    spans = t.encode(text, add_special_tokens=False).offsets
    n = [0] * len(ends)
    section = lambda c: next(i for i, e in enumerate(ends) if c < e)
    for a, b in spans:
        hit = [section(c) for c in range(a, b)]
        n[hit[0] if rule == "first" else hit[-1] if rule == "last" else max(sorted(set(hit)), key=hit.count)] += 1
    return n


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_against_offsets(spark, rule):
    rng = random.Random(0)
    rows = [(i, "".join(rng.choice(["word", " ", "\n", "\n\n", "ing", "1234", "!?"]) for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    got = {}
    for r in section_tokens(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.char_end)
    for i, text in rows:
        ends = lines(text)
        assert [got[i][s] for s in range(len(ends))] == list(zip(brute(text, ends, rule), ends))


def test_rules():
    tokens, sections = np.array([2, 6, 7]), np.array([3, 4, 7])
    assert [attribute(tokens, sections, r)[0].tolist() for r in ("first", "last", "most")] == [[2, 0, 1], [1, 0, 2], [1, 0, 2]]


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "é\n日本\n", 5), (None, "x", 5), (4, "long words " * 40_000, 5), (4, "long words " * 40_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, section int")
    got = section_tokens(df, RANKS, PATTERN).collect()
    assert sorted(((r.doc_id, r.section, r.char_start, r.char_end) for r in got), key=str) == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 2), (3, 1, 2, 5), (None, 0, 0, 1), (4, 0, 0, 440_000), (4, 0, 0, 440_000)], key=str)
    assert section_tokens(df.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        section_tokens(df, RANKS, PATTERN, rule="none")


def test_fields(spark):
    df = spark.createDataFrame([(1, "two words", None, "é"), (2, None, None, None)], "id long, a string, b string, field string")
    got = {(r.id, r.field): r.n_tokens for r in field_tokens(df, ["a", "b", "field"], RANKS, PATTERN, "id").collect()}
    assert got[1, "a"] == 3 and sum(v for (i, _), v in got.items() if i == 2) == 1 and len(got) == 6


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    total, ends = {}, {}
    for r in op7_token_counts(spark, d).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.char_end)
    assert total == {k: len(t.encode(v).ids) for k, v in docs.items()} and ends == {k: len(v) for k, v in docs.items()}


def test_long_white_space_splits_as_the_pattern_does(monkeypatch):
    from ledgerloom.llm import token_counts

    enc = token_counts.encoder(RANKS, PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choice([" ", "\n", "\t", " ", "a", "1", "!", "'s"]) * rng.randrange(1, 9) for _ in range(30)) for _ in range(300)]
    want = [enc.encoding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(token_counts, "_RUN", token_counts.re.compile(token_counts._RUN.pattern.replace("50000", "2")))
    assert [enc.ids(t) for t in texts] == want


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, " \n" * 500_000])
def test_a_million_blanks(spark, run):
    got = section_tokens(spark.createDataFrame([(1, f"a{run}b")], "doc_id long, text string"), RANKS, PATTERN, sections=lambda t: [len(t)]).collect()
    assert len(got) == 1 and got[0].char_end == len(run) + 2 and got[0].n_tokens > 2
