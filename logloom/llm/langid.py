"""Language identification: multinomial logistic regression over TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature.

N-grams of one to three characters are hashed into DIM columns; document frequencies are counted over all training rows
and whole texts, and over no others. The classifier is fitted on a bounded sample of the training rows: about SAMPLE documents for each
language, by a hash of the id; nine tenths train the weights and one tenth the temperature. Every language of the
training rows is learned.

Cases: a null text, or one without a letter, is `und` with score 0; equal texts get equal results; without any
training row all are `und`; of languages that score alike the first by name is taken; very long texts are counted whole;
repeated rows and ids come out each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 14
DIM = 1 << BITS
#: Documents of the sample for each language (on average).
SAMPLE = 800
ALPHA, BETA, L1, L2, EPOCHS, SEED = 0.5, 1.0, 1e-4, 1e-4, 3, 5


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns that occur and how often: hashed n-grams of the whole text, lowered."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIM, np.int64)
    for a in range(0, len(c), 1 << 16):
        x = c[a : a + (1 << 16) + 2]
        h = x * np.uint32(0x9E3779B1)
        two = (h[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) + np.uint32(1)
        three = ((two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)) + np.uint32(2)
        n = min(len(x), 1 << 16)
        for g in ((h[:n] * np.uint32(0x2C1B3C6D)), two[:n], three[:n]):
            total += np.bincount((g ^ (g >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(32 - BITS), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def weigh(at, n, idf):
    x = np.log1p(n) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(s):
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for a softmax over `k` classes; L1 makes the weights sparse."""

    def __init__(self, k: int):
        self.z, self.n = np.zeros((k, DIM)), np.zeros((k, DIM))

    def weights(self, at=slice(None)):
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at, x, y):
        w = self.weights(at)
        g = softmax(w @ x)
        g[y] -= 1
        g = g[:, None] * x
        sigma = (np.sqrt(self.n[:, at] + g * g) - np.sqrt(self.n[:, at])) / ALPHA
        self.z[:, at] += g - sigma * w
        self.n[:, at] += g * g


def train(rows: list, idf: np.ndarray, names: list[str]):
    """Weights and temperature from (doc_id, language, columns, counts)."""
    code = {x: i for i, x in enumerate(names)}
    rows = [(d, code[y], at, weigh(at, n, idf)) for d, y, at, n in rows]
    apart = [r for i, r in enumerate(rows) if i % 10 == 9]
    rows = [r for i, r in enumerate(rows) if i % 10 != 9]
    model, rng = Ftrl(len(names)), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            model.learn(rows[i][2], rows[i][3], rows[i][1])
    w = model.weights()
    s = np.array([w[:, at] @ x for _, _, at, x in apart]).reshape(-1, len(names))
    y = np.array([r[1] for r in apart], np.int64)
    grid = np.geomspace(0.02, 5, 60)
    loss = [-np.log(np.maximum(softmax(s / t)[np.arange(len(y)), y], 1e-12)).sum() for t in grid] if len(y) else [0.0]
    return w, float(grid[int(np.argmin(loss))]) if len(y) else 1.0


def fit(docs: DataFrame, sample: int = SAMPLE):
    """Over `docs(doc_id, text, lang)`: names, idf, weights, temperature; None without a training row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learn = own.where("lang is not null and text is not null").where(C.fold_of(F.col("doc_id"), 4) != 2)
    found = learn.groupBy("lang").count().collect()  # every language is learned
    if not found:
        return None
    share = {r.lang: min(1.0, sample / r["count"]) for r in found}
    rates = learn.sparkSession.createDataFrame(list(share.items()), "lang string, rate double")
    rate = F.col("rate")
    chosen = learn.join(F.broadcast(rates), "lang").select("doc_id", "text", "lang", "rate").where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < rate * (1 << 20))
    schema = C.arrow_schema("doc_id long, lang string, at binary, n binary")

    def features(it):
        for b in C.batches_of(it):
            f = [counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([a.astype("<u2").tobytes() for a, _ in f], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in f], pa.binary())], schema=schema)

    def frequencies(it):
        out = np.zeros(DIM + 1)
        for b in C.batches_of(it):
            for t in b.column(0).to_pylist():
                out[-1] += 1
                out[counts(t)[0]] += 1
        return out

    df = C.partial_sums(learn.select("text"), frequencies, DIM + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    rows = sorted((r.doc_id, r.lang, bytes(r["at"]), bytes(r.n)) for r in chosen.mapInArrow(features, "doc_id long, lang string, at binary, n binary").collect())
    rows = [(d, y, np.frombuffer(a, "<u2"), np.frombuffer(n, "<u4")) for d, y, a, n in rows]
    if not rows:
        return None
    names = sorted({r[1] for r in rows})
    return (names, idf, *train(rows, idf, names))


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs(doc_id, text, lang)`."""
    spark = docs.sparkSession
    model = fit(docs, sample)
    shared = spark.sparkContext.broadcast(model)  # languages * DIM numbers
    schema = C.arrow_schema("doc_id long, lang_pred string, score double")

    def run(it):
        model = shared.value
        if model:
            names, idf, w, t = model
        for b in C.batches_of(it):
            lang, score = [], []
            for text in b.column(1).to_pylist():
                if not model or not text or not any(map(str.isalpha, text)):
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, n = counts(text)
                p = softmax((w[:, at] @ weigh(at, n, idf)) / t)
                i = int(p.argmax())
                lang.append(names[i])
                score.append(round(float(p[i]), 9))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(C.fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
