import numpy as np

from ledgerloom.llm.quality import INPUTS, AttentionModel, passages, quality_query, score, train
from ledgerloom.llm.registry import op3_quality


def test_passages():
    assert passages(None).shape == passages("  ").shape == (1, INPUTS) and not passages("").any()
    assert passages("a " * 129).shape == (3, INPUTS)


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(200):
        b = rng.standard_normal((rng.integers(1, 9), INPUTS)) * 0.1
        if i % 2:
            b[rng.integers(len(b)), 3] += 4
        bags.append(b)
        labels.append(i % 2)
    y = np.array(labels)
    m = AttentionModel().fit(bags[:150], y[:150])
    assert ((m.scores(bags[150:]) >= 0.5) == y[150:]).mean() > 0.9


def test_gradient():
    rng = np.random.default_rng(1)
    x, starts, bag, y, w = rng.standard_normal((6, INPUTS)), np.array([0, 2, 5]), np.array([0, 0, 1, 1, 1, 2]), np.array([0.0, 1, 1]), np.array([0.5, 0.2, 0.3])
    m = AttentionModel()

    def loss():
        p = m._forward(x, starts, bag)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for k, g in m._gradient(x, starts, bag, y, w).items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(5)]:
            kept = m.p[k][at]
            m.p[k][at] = kept + 1e-6
            up = loss()
            m.p[k][at] = kept - 1e-6
            down = loss()
            m.p[k][at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_training_takes_all_passages_and_bounds_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words " * 3200 if i % 2 else "bad stuff " * 10) for i in range(40)] + [(1, f"other text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(AttentionModel, "fit", lambda self, bags, y: seen.append((bags, y)) or self)
    train(docs, labels)
    train(docs, labels, sample=30)
    train(docs, labels, passages_in_all=250)
    assert max(len(b) for b in seen[0][0]) == 100
    assert len(seen[1][0]) <= 30 and sum(map(len, seen[2][0])) <= 250
    assert len(seen[0][0]) > len(seen[1][0])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = op3_quality(spark, d).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    balanced = np.mean([np.mean([s >= 0.5 for s in good]), np.mean([s < 0.5 for s in bad])])
    print("held out", len(held), "auc", auc, "balanced accuracy", balanced)
    assert balanced >= 0.93
    assert len(held) > 900 and auc >= 0.95 and np.mean([(s >= 0.5) == y for s, y in held]) >= 0.93


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 100_000, 0), (None, "x", 0), (4, "fine text here", 0), (4, "fine text here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, text int")
    assert len(quality_query(docs, labels).collect()) == 6
    assert {r.score for r in quality_query(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_query(docs.limit(0), labels).count() == 0
    clash = docs.withColumnRenamed("quality", "Quality_Score")
    assert score(clash, AttentionModel()).columns == [*clash.columns, "quality_score_"]
    assert {r.quality_score_ for r in score(clash, AttentionModel()).collect()} == {0.5}
