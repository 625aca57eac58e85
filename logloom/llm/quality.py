"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Cases: a null text counts as empty and is scored like an empty one; rows with equal texts get equal scores; very long
texts are measured whole; of repeated labels the larger counts; a repeated id is a row of its own each time; without a
label in the training folds every score is 0.5; an empty table gives an empty result; other columns are ignored by
`score` and kept by `keep_good`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Number of statistics of a document, of Fourier features, of bins of raw scores for calibration.
STATS, FEATURES, BINS = 22, 160, 4096
RIDGE, SEED, THRESHOLD = 1.0, 17, 0.7
SPAN = (-1.0, 2.0)  # of raw scores that are binned; what lies outside goes to the end bins

_UPPER, _LOWER, _DIGIT, _SPACE = (np.array([chr(i) in s for i in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\v\f"))
_STOP, _SHOUT, _PIPE, _HIGH, _CONTROL = (np.array([chr(i) in s for i in range(256)]) for s in (".,", "!?", "|", "".join(map(chr, range(128, 256))), "".join(map(chr, range(32)))))
_PUNCT = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,!?|" for i in range(256)])
_CLASSES = np.array([_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SHOUT, _PIPE, _HIGH, _CONTROL, _PUNCT], dtype=np.float64)


def statistics(text: str | None) -> np.ndarray:
    """Of the whole text: shares of character classes, entropy, word and line repetition, lengths."""
    raw = (text or "").encode()
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    upper, lower, digit, space, stop, shout, pipe, high, control, punct = (_CLASSES @ hist).tolist()
    words = raw.split()
    w, distinct = len(words), len(set(words))
    lines = raw.split(b"\n")
    p = hist[hist > 0] / max(n, 1)
    some = Counter(words).most_common(1)[0][1] if w else 0
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else 1
    return np.array(
        [
            np.log1p(n), upper / max(upper + lower, 1), digit / max(n, 1), space / max(n, 1), stop / max(w, 1), shout / max(w, 1), pipe / max(w, 1),
            high / max(n, 1), control / max(n, 1), punct / max(w, 1), (n - space) / max(w, 1), distinct / max(w, 1), np.log1p(distinct) / np.log1p(max(w, 1)),
            np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), -float(p @ np.log2(p)) if n else 0.0, hist.max() / max(n, 1),
            some / max(w, 1), np.log1p(w), pairs / max(w - 1, 1), w / max(stop + shout, 1),
        ]
    )


def _stats_table(docs: DataFrame) -> DataFrame:
    schema = C.arrow_schema("doc_id long, x binary")

    def run(it):
        for b in C.batches_of(it):
            ids, texts = b.columns
            x = [statistics(t).astype("<f4").tobytes() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(x, pa.binary())], schema=schema)

    return C.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary"), "quality-stats")


def matrix(column) -> np.ndarray:
    x = b"".join(column.to_pylist())
    return np.frombuffer(x, "<f4").reshape(-1, STATS).astype(np.float64)


class Fourier:
    """cos(xW + b) of standardized statistics: inner products approximate a Gaussian kernel."""

    def __init__(self, mean, std, seed=SEED, features=FEATURES):
        rng = np.random.default_rng(seed)
        self.mean, self.std, self.k = mean, std, features
        self.w = rng.normal(size=(STATS, features)) / np.sqrt(STATS)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x):
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.sqrt(2 / self.k) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))])


def isotonic(x, pos, n):
    """Pool adjacent violators over bins in ascending x, one pseudo-observation at the mean in each end; knots to
    interpolate between, so that the calibration never decreases."""
    blocks = []
    base = pos.sum() / n.sum()
    for xi, pi, ni in zip(x, pos, n, strict=True):
        if not ni:
            continue
        blocks.append([xi * ni, pi, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    xs = np.array([b[0] / b[2] for b in blocks])
    ys = np.array([(b[1] + base) / (b[2] + 1) for b in blocks])
    return xs, np.clip(np.maximum.accumulate(ys), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, folds=(0, 1, 3)):
    """`stats(doc_id, x)` and `labels(doc_id, y 0/1)` of training rows only; all of them are used.

    Standardization, then for each fold the sums of z z' and z y, solved without that fold for scores of its rows,
    from whose histogram the calibration is fitted; the final weights come from all folds.
    """
    moments = C.partial_sums(stats.select("x"), _moments, 2 * STATS + 1)
    if not moments[0]:
        return None
    mean = moments[1 : STATS + 1] / moments[0]
    std = np.sqrt(np.maximum(moments[STATS + 1 :] / moments[0] - mean**2, 1e-12))
    std[std < 1e-5] = 1.0
    fourier, d = Fourier(mean, std), FEATURES + STATS + 1
    train = C.materialize(stats.join(labels, "doc_id").select("x", F.col("y").cast("double").alias("y"), C.fold_of(F.col("doc_id"), 4).alias("fold")), "quality-train")
    cell, at = d * d + d + 1, {f: i for i, f in enumerate(folds)}

    def normal(it):
        out = np.zeros((len(folds), cell))
        for b in it:
            z, y, fold = fourier(matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f, i in at.items():
                zf, yf = z[fold == f], y[fold == f]
                out[i, : d * d] += (zf.T @ zf).ravel()
                out[i, d * d : -1] += zf.T @ yf
                out[i, -1] += len(yf)
        return out.ravel()

    sums = C.partial_sums(train, normal, len(folds) * cell).reshape(len(folds), cell)
    if not sums[:, -1].sum():
        return None

    def solve(s):
        return np.linalg.solve(s[: d * d].reshape(d, d) + RIDGE * np.eye(d), s[d * d : -1])

    weights = solve(sums.sum(0))
    apart = [solve(sums.sum(0) - s) for s in sums]

    def histogram(it):
        out = np.zeros((2, BINS))
        for b in it:
            z, y, fold = fourier(matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f, i in at.items():
                k = bins(z[fold == f] @ apart[i])
                out[0] += np.bincount(k, minlength=BINS)
                out[1] += np.bincount(k, weights=y[fold == f], minlength=BINS)
        return out.ravel()

    n, pos = C.partial_sums(train, histogram, 2 * BINS).reshape(2, BINS)
    centers = SPAN[0] + (np.arange(BINS) + 0.5) * (SPAN[1] - SPAN[0]) / BINS
    return fourier, weights, isotonic(centers, pos, n)


def bins(s):
    return np.clip(((s - SPAN[0]) / (SPAN[1] - SPAN[0]) * BINS).astype(np.int64), 0, BINS - 1)


def _moments(it):
    out = np.zeros(2 * STATS + 1)
    for b in it:
        x = matrix(b.column(0))
        out[0] += len(x)
        out[1 : STATS + 1] += x.sum(0)
        out[STATS + 1 :] += (x**2).sum(0)
    return out


def predicted(model, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    fourier, weights, (xs, ys) = model
    return np.round(np.interp(fourier(x) @ weights, xs, ys), 9)


def _training(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y")).where(C.fold_of(F.col("doc_id"), 4) != 2)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that `score` predicts as good, with their columns; all of them where there is no label to learn
    from. Each row is judged by its own text where it stands: no id is looked at, and no row is moved."""
    stats = _stats_table(docs)
    model = fit(stats, _training(labels))
    if model is None:
        return docs
    at = [c.lower() for c in docs.columns].index("text")

    def run(it):
        for b in C.batches_of(it):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], np.float32).astype(np.float64)
            yield b.filter(pa.array(predicted(model, x.reshape(-1, STATS)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs(doc_id, text)`; `labels(doc_id, quality)`."""
    stats = _stats_table(docs)
    model = fit(stats, _training(labels))
    schema = C.arrow_schema("doc_id long, score double")

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predicted(model, matrix(b.column(1))))], schema=schema)

    out = stats.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(C.fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
