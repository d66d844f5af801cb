"""Hierarchical language identification.

A text's features are the frequencies of its hashed byte trigrams, lower-cased,
with everything but letters as a space. Linear one-versus-rest machines choose
the language family; within it, linear one-versus-one machines vote. All are
L2-loss support vector machines trained by dual coordinate descent on a bounded
sample; scoring is one matrix product a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import free, narrow, streamed

#: Trigram cells, and labelled documents that training uses at most (over all languages, evenly).
CELLS, SAMPLE = 4096, 4000
PIECE = 1 << 20
#: Rows or columns of the sample that training copies at a time.
STEP = 256
#: Parts of a language whose least hashes are found first.
SALTS = 64

#: Families of ISO 639-1 languages. A language that stands in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "malay": "id jv mg ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """Frequencies of the text's trigrams; a long text is read piece by piece."""
    data, counts = b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", np.zeros(CELLS, np.int64)
    for at in range(0, len(data) - 2, PIECE):
        b = np.frombuffer(data[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code = code[(b[1:-1] != 32)]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=CELLS)
    return (counts / max(1, counts.sum())).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, passes: int = 20, seed: int = 0, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the bias) of an L2-loss linear SVM; y is +1 or -1.

    ``rows`` are the places in x that y tells of, all by default: x is never copied.
    """
    rng, n = np.random.default_rng(seed), len(y)
    rows = np.arange(n) if rows is None else rows
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(n)
    balance = c * n / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    q = np.concatenate([(x[r] * x[r]).sum(1) for r in np.array_split(rows, n // STEP + 1)]) + 1 / (2 * balance)
    for _ in range(passes):
        for i in rng.permutation(n):
            v = x[rows[i]]
            g = y[i] * float(w @ v) - 1 + alpha[i] / (2 * balance[i])
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * v
                alpha[i] = new
    return w


class LanguageModel:
    """Families, their languages and all machines in one weight matrix.

    Training holds one single-precision copy of x and small pieces besides: the
    driver of a cluster has little memory.
    """

    def __init__(self, langs: list[str], x: np.ndarray) -> None:
        y = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        columns = [slice(at, at + STEP) for at in range(0, CELLS, STEP)]
        self.scale = 1 / (np.concatenate([x[:, c].astype(np.float32).std(0) for c in columns]) + 1e-4) if len(x) else np.ones(CELLS, np.float32)
        # How much likelier each cell is in a language than in noise, in nats.
        self.profile = np.log(0.1 + 0.9 * CELLS * np.array([np.concatenate([x[y == v, c].astype(np.float32).mean(0) for c in columns]) for v in self.langs])) if self.langs else np.zeros((0, CELLS))
        x = self._ready(x)
        of = np.array([family_of(v) for v in langs])
        rows = [train_svm(x, np.where(of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        for a, b in self.pairs:
            own = np.flatnonzero((y == a) | (y == b))
            rows.append(train_svm(x, np.where(y[own] == a, 1.0, -1.0), rows=own))
        self.weights = np.array(rows, np.float32).reshape(len(rows), CELLS + 1)

    def _ready(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), CELLS + 1), np.float32)
        for at in range(0, len(x), STEP):
            v = x[at : at + STEP] * self.scale
            out[at : at + STEP, :CELLS] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and a score from 0 to 1; ``und`` and 0 without a letter.

        The score is also 0 where the text is no likelier in that language than noise is:
        every text gets the nearest learned language, also one in a language never seen.
        """
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``predict`` of each text, by one matrix product."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if not rows:
            return out
        plain = np.stack([features(texts[i]) for i in rows])
        x = self._ready(plain)
        sure = 1 / (1 + np.exp(-4.0 * np.clip(np.einsum("ij,kj->ik", x, self.weights), -50, 50)))
        n = len(self.families) if len(self.families) > 1 else 0
        family = np.argmax(sure[:, :n], axis=1) if n else np.zeros(len(rows), int)
        score = sure[np.arange(len(rows)), family] if n else np.ones(len(rows))
        for f in np.unique(family).tolist():
            own, langs = np.flatnonzero(family == f), self.members[self.families[f]]
            place = {v: j for j, v in enumerate(langs)}
            wins, sums = np.zeros((len(own), len(langs)), int), np.zeros((len(own), len(langs)))
            for j, (a, b) in enumerate(self.pairs):
                if a in place:
                    p = sure[own, n + j]
                    wins[:, place[a]] += p >= 0.5
                    wins[:, place[b]] += p < 0.5
                    sums[:, place[a]] += p
                    sums[:, place[b]] += 1 - p
            best = np.argmax(wins + sums / (len(langs) + 1), axis=1)  # most wins, then the surest
            if len(langs) > 1:
                score[own] *= sums[np.arange(len(own)), best] / (len(langs) - 1)
            for i, j in zip(own.tolist(), best.tolist()):
                known = float(plain[i] @ self.profile[self.langs.index(langs[j])]) > 0
                out[rows[i]] = langs[j], min(1.0, max(0.0, float(score[i]))) if known else 0.0
        return out


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE) -> LanguageModel:
    """Learn from text and language of rows outside the held-out fold.

    The sample has up to ``sample / languages`` different (id, text) of each
    language, those of least hash; of more than ``sample / 2`` languages the most
    frequent ones are learned. So the driver gets at most ``sample`` feature vectors
    of 8 KB, however many rows share an id or have none. Rows with a null language
    or text teach nothing; repeated rows count once.
    """
    d = narrow(docs, id=F.col(id_col).cast("bigint"), text=text_col, lang=F.col(lang_col).cast("string"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("id"), folds) != held))
    langs = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(2, sample // 2)).select("lang").collect()
    if not langs:
        return LanguageModel([], np.empty((0, CELLS), np.float32))
    d = d.withColumn("h", F.xxhash64("id", "text"))
    each = max(2, sample // len(langs))
    # Chosen by hash alone, so the texts of the others are not moved; first within salted parts of a language.
    keys = d.select("lang", "h").where(F.col("lang").isin([r.lang for r in langs])).distinct()
    for part in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        keys = keys.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("h"))).where(F.col("r") <= each).drop("r")
    rows = d.join(F.broadcast(keys), ["lang", "h"])  # at most `sample` keys

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            new = [(v, h, t) for v, h, t in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t) and (v, h) not in seen and not seen.add((v, h))]
            got = [(v, h, features(t).astype(np.float16).tobytes()) for v, h, t in new]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "x"])

    # A task sends a repeated row once, the driver keeps one.
    got = {(r.lang, r.h): bytes(r.x) for r in streamed(rows.select("lang", "h", "text").mapInArrow(vectors, "lang string, h long, x binary"))}
    keys = sorted(got)
    x = np.empty((len(keys), CELLS), np.float16)
    for i, k in enumerate(keys):
        x[i] = np.frombuffer(got.pop(k), np.float16)
    return LanguageModel([v for v, _ in keys], x)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input's columns and, last, a struct of ``lang_pred`` and ``score``, row by row.

    The struct is named ``language``, with underscores appended where the input
    has such a column. Only the text decides. Null, empty and letterless texts
    are ``und`` with score 0, as is everything if the model has learned nothing;
    a text no likelier in its language than noise scores 0 too; repeated rows get
    the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [x for i in range(0, len(texts), 64) for x in shared.value.predict_all(texts.slice(i, 64).to_pylist())]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])

    # Else a filter on the answer would have it worked out a second time, by a second worker.
    predict = predict.asNondeterministic()
    return docs.select("*", predict(docs[text_col]).alias(free(docs.columns, "language")))


def language_query(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    d = narrow(docs, doc_id="doc_id", text="text")
    found = identify(d, train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "language.lang_pred", "language.score")
