"""Document quality by attention over passages.

A document is a bag of passages of ``WORDS`` words. Each passage becomes its
byte frequencies and a few shape figures, goes through a small tanh encoder,
and gets a gated attention weight; the document's representation is the
weighted mean of its passages', and a logistic unit scores it (Ilse et al.,
2018). Everything is learned from document labels alone, by Adam with weight decay
over mini-batches of whole documents, stopped where held-back documents of the
sample fare best. The sample of labelled documents is bounded; training and
scoring read whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import free, narrow, pieces
from ledgerloom.llm.langid import remainder
from ledgerloom.storage import stored

WORDS = 64
#: Labelled documents that training uses at most, and passages that they have together at most (522 bytes each).
SAMPLE, PASSAGES = 3000, 200_000
INPUTS = 256 + 5


def passages(text: str | None) -> np.ndarray:
    """(passages, INPUTS) figures of all of a text; one row of zeros for a blank one."""
    words = text.encode("utf-8", "replace").split() if text else []
    n = -(-len(words) // WORDS)
    if not n:
        return np.zeros((1, INPUTS), np.float32)
    out = np.empty((n, INPUTS), np.float32)
    for i in range(n):
        part = words[i * WORDS : (i + 1) * WORDS]
        data = b" ".join(part)
        b = np.frombuffer(data, np.uint8)
        out[i, :256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
        k = len(part)
        out[i, 256:] = (len(data) / k / 10, len(set(part)) / k, len({w.lower() for w in part}) / k, sum(map(bytes.isalpha, part)) / k, min(1, k / WORDS))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """x -> h = tanh(x E + e); weight = softmax(tanh(h V) * sigmoid(h U) @ w); score = sigmoid(mean(h) @ o + c)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        shape = {"E": (INPUTS, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "o": (hidden,), "c": (1,)}
        self.p = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if k not in "ec" else np.zeros(s)) for k, s in shape.items()}
        self.mean, self.std, self.constant = np.zeros(INPUTS), np.ones(INPUTS), 0.5

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["o"] + p["c"])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 60, rate: float = 0.01, decay: float = 0.2, sparse: float = 1.0, batch: int = 20_000) -> AttentionModel:
        """``steps`` passes over all bags, in batches of about ``batch`` passages and at least eight a pass.

        One label, or none, gives that constant (0.5 without any). Every sixth bag
        is held back; the passage through the data that scores these best is kept.
        """
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(labels) else 0.5
            return self
        x = np.concatenate(bags).astype(np.float32)
        sizes = np.array([len(b) for b in bags])
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.mean, self.std, self.constant = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 0.02, None
        y = labels.astype(np.float64)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        rng = np.random.default_rng(0)
        order = rng.permutation(len(bags))
        held, taught = order[::6], np.delete(order, np.s_[::6])
        if len(set(labels[held].tolist())) < 2 or len(set(labels[taught].tolist())) < 2:
            held = taught = order
        parts = max(min(8, len(taught)), int(sizes[taught].sum()) // batch)

        def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = np.concatenate([np.arange(begins[i], begins[i] + sizes[i]) for i in rows.tolist()])
            starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
            return (x[own] - self.mean) / self.std, starts, np.repeat(np.arange(len(rows)), sizes[rows])

        p, m, v, t, best = self.p, {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0, (math.inf, self.p)
        for _ in range(steps):
            for rows in np.array_split(rng.permutation(taught), parts):
                t += 1
                g = self._gradient(*gathered(rows), y[rows], weight[rows] / len(rows))
                for k in p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
                    step = (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                    p[k] = p[k] - rate * (step + (decay * p[k] if k not in "ec" else 0))
                # An input whose weights stay small is left out altogether.
                p["E"] *= np.maximum(0, 1 - rate * sparse / (np.linalg.norm(p["E"], axis=1, keepdims=True) + 1e-12))
            loss = 0.0
            for rows in np.array_split(held, max(1, int(sizes[held].sum()) // batch)):
                s = np.clip(self._forward(*gathered(rows))["y"], 1e-7, 1 - 1e-7)
                loss -= float((weight[rows] * (y[rows] * np.log(s) + (1 - y[rows]) * np.log(1 - s))).sum())
            if loss < best[0]:
                best = loss, {k: w.copy() for k, w in p.items()}
        self.p = best[1]
        return self

    def _gradient(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted logistic loss, by every parameter."""
        p, f = self.p, self._forward(x, starts, bag)
        d = (f["y"] - y) * weight
        dz = d[:, None] * p["o"]
        g = {"o": f["z"].T @ d, "c": np.array([d.sum()])}
        da = (f["h"] * dz[bag]).sum(1)
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        gate = f["t"] * f["s"]
        g["w"] = gate.T @ da
        dt, ds = da[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * gate * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - f["h"] ** 2
        g["E"], g["e"] = x.T @ dh, dh.sum(0)
        return g

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        sizes = np.array([len(b) for b in bags])
        starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
        return self._forward((np.concatenate(bags) - self.mean) / self.std, starts, bag)["y"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE, passages_in_all: int = PASSAGES) -> AttentionModel:
    """Learn from labelled documents outside the held-out fold, from all their passages.

    The sample: of the different (id, text) that have a label, those of least
    hash, at most ``sample`` and with at most ``passages_in_all`` passages
    together; so what reaches the driver is bounded whatever ids or texts repeat.
    A null id or label, a label other than 0 and 1, and an id whose labels
    contradict each other teach nothing; repeated rows count once.
    """
    y = narrow(labels, id=F.col(id_col).cast("bigint"), y=F.col(label_col).cast("int"))
    y = y.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("id"), folds) != held))
    y = y.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y").orderBy(F.xxhash64("id"), "id").limit(sample)
    d = narrow(docs, id=F.col(id_col).cast("bigint"), text=text_col).join(F.broadcast(y), "id")  # at most `sample` rows
    d = d.groupBy("id", F.xxhash64("text").alias("h"), "y").agg(F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 16):
            found = [passages(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype(np.float16).tobytes() for x in found], pa.binary())], ["id", "h", "y", "n", "x"])

    d = stored(d.mapInArrow(bags, "id long, h long, y int, n long, x binary"), "bags")
    keys = d.select("id", "h", "n").orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample).collect()
    total = np.cumsum([r.n for r in keys])
    keys = keys[: max(1, int(np.searchsorted(total, passages_in_all, "right")))] if len(keys) else keys
    chosen = docs.sparkSession.createDataFrame([(r.id, r.h) for r in keys], "id long, h long")
    rows = sorted((r.id, r.h, r.y, bytes(r.x)) for r in d.join(F.broadcast(chosen), ["id", "h"]).toLocalIterator())
    return AttentionModel().fit([np.frombuffer(r[3], np.float16).reshape(-1, INPUTS) for r in rows], np.array([r[2] for r in rows]))


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """The input's columns and, last, ``quality_score``, from the whole text alone; null and empty texts get a score too.

    Where the input has a column of that name, underscores are appended. Repeated
    rows get the same score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        out = []
        for i in range(0, len(texts), 64):
            out.append(shared.value.scores([passages(t) for t in texts[i : i + 64]]))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select("*", of(docs[text_col]).alias(free(docs.columns, "quality_score")))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = score(narrow(docs, doc_id="doc_id", text="text"), train(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
