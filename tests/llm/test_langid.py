import tracemalloc

import numpy as np

from ledgerloom.llm.langid import CELLS, LanguageModel, family_of, features, has_letter, identify, language_query, train, train_svm
from ledgerloom.llm.registry import op6_language


def test_families():
    assert family_of("en") == family_of("de") == family_of("nl-BE") == "germanic" and family_of("fr") == family_of("es")
    assert family_of("xx") != family_of("yy")


def test_features():
    assert features("Abc ABC").tolist() == features("abc... abc!").tolist()
    assert abs(features("é" * 3_000_000).sum() - 1) < 1e-3
    assert not has_letter("12 !? ²") and not has_letter(None) and has_letter("1é")


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) > 0, 1.0, -1.0)
    assert (np.sign(x @ train_svm(x, y, c=10.0)) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op6_language(spark, d).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97


def test_edge_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 8)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 ?!", "fr", "x"), (None, "the cat", None, None), (103, "der Hund " * 60_000, None, "x"), (103, "der Hund " * 60_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_query(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[k].lang_pred for k in (100, 101, 102)} == {"und"} and by[103].lang_pred == "de" and by[None].lang_pred == "en"
    assert identify(df, train(df)).columns == [*df.columns, "language"]
    assert language_query(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_query(df.where("lang is null")).collect()} == {"und"}


def test_one_language():
    m = LanguageModel(["en"], np.ones((1, CELLS), np.float32))
    assert m.predict("abc") == ("en", 1.0) and m.predict("1") == ("und", 0.0)


def test_shared_ids_and_clashing_names(spark):
    rows = [(None, f"the cat {i} and the dog", "en", "x") for i in range(400)] + [(None, "der Hund und die Katze", "de", "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Language string")
    seen = []
    monkey = LanguageModel.__init__
    LanguageModel.__init__ = lambda self, langs, x: (seen.append(len(langs)), monkey(self, langs, x))[1]
    try:
        model = train(df, sample=40)
    finally:
        LanguageModel.__init__ = monkey
    assert seen == [21]
    found = identify(df, model)
    assert found.columns == [*df.columns, "language_"]
    got = found.select("lang", "language_.lang_pred").collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)


def test_batches_predict_as_single_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for (a, x), (b, y) in zip(model.predict_all([*texts, None]), map(model.predict, [*texts, None])):
        assert a == b and abs(x - y) < 1e-4


def test_unlearned_languages_score_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs)
    foreign = ["Привет мир, это русский текст о погоде", "これは日本語の文章です。", "Ovo je recenica na hrvatskom jeziku o vremenu", "qxzj vkqw zzxq jkqz wvvx"]
    assert [s for _, s in model.predict_all(foreign)] == [0.0] * 4
    own = [r.text for r in docs.where("lang is not null").collect() if has_letter(r.text)]
    assert min(s for _, s in model.predict_all(own)) > 0.1


def test_training_takes_little_memory():
    rng = np.random.default_rng(3)
    x = rng.random((1500, CELLS), np.float32).astype(np.float16)
    langs = [("en", "fr", "de")[i % 3] for i in range(len(x))]
    tracemalloc.start()
    model = LanguageModel(langs, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * x.size  # one copy in single precision and pieces
    plain = x.astype(np.float32)
    assert np.array_equal(model.scale, 1 / (plain.std(0) + 1e-4))
    y = np.array(langs)
    ready, own = model._ready(plain), y != "fr"
    assert np.array_equal(model.weights[-1], train_svm(ready[own], np.where(y[own] == "de", 1.0, -1.0)))
