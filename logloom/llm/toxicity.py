"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared on windows.

Two dictionaries are trained by zstandard, from a bounded sample of labelled rows: the ordinary one on windows of
ordinary documents, the toxic one on those words of toxic documents that set them apart, as often as they stand there
(on whole toxic documents zstandard keeps what is frequent, which is ordinary text). Both are used as content, ended by
an anchor that every window begins with, so that a first match need not also pay for a compressed block's headers. The
whole running text is cut into windows of a word or two; each is compressed with either dictionary, and the bytes that
the toxic one saves are its distance to ordinary text less that to toxic text. A logistic curve over the strongest
savings and the numbers of windows above each of several thresholds, fitted on documents the dictionaries have not
seen, gives the score.

Cases: null counts as empty; a text without words has no windows, and all its features are 0; equal texts get equal
scores; very long texts are scored whole, and can be in the sample; repeated rows come out each, of repeated labels the
larger counts; without labels of both kinds every score is the base rate (0 without any label); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Documents of the sample for each label (on average), ordinary windows drawn from it, sizes of the dictionaries in bytes.
SAMPLE, DRAWN, ORDINARY_BYTES, TOXIC_BYTES = 1500, 40_000, 16_384, 4_096
#: Bytes of a window; longer words than LONGEST are cut into overlapping parts.
WINDOW, LONGEST, THRESHOLD = 10, 64, 0.7
#: Shortest match of the compressors, so that fragments of words do not match; what windows and dictionaries share.
SHORTEST, ANCHOR = 5, bytes([*range(1, 9), *range(14, 31)]) + b"<=>~^`{}"
#: Windows whose savings a worker remembers; all are forgotten beyond it.
REMEMBERED = 400_000
#: How many of the strongest savings, and which bytes saved, count; how much each counts is fitted.
STRONGEST, SAVINGS = 4, (2, 3, 4, 5, 6, 8)
#: Lengths of runs of characters that are weighed, how much more frequent they must be in toxic texts, how many are kept.
RUNS, LIFT, COVER, SEGMENTS, MARKS = (5, 6, 7, 8, 9, 10), 12, 4, 600, ".,!?*#$%&|"


def words(text: str | None) -> list[bytes]:
    """The words of the whole text, lowered and without MARKS at their ends; a long one as overlapping parts."""
    out = []
    for w in (text or "").lower().split():
        w = w.strip(MARKS).encode()
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return [w for w in out if w]


def windows(text: str | None) -> list[bytes]:
    """The running text in runs of words of about WINDOW bytes."""
    out, line, n = [], [], 0
    for w in words(text):
        if line and n + len(w) > WINDOW:
            out.append(b" " + b" ".join(line) + b" ")
            line, n = [], 0
        line.append(w)
        n += len(w) + 1
    if line:
        out.append(b" " + b" ".join(line) + b" ")
    return out


def runs(text: str) -> set[str]:
    """Runs of RUNS characters within the words of a text, a word's ends being spaces."""
    out = set()
    for w in {w.strip(MARKS) for w in text.lower().split()}:
        w = f" {w} "
        for n in RUNS:
            out.update([w[i : i + n] for i in range(len(w) - n + 1)])
    return out


def toxic_segments(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Segments that set toxic texts apart, the most telling last: of the runs found in at least LIFT times as large a
    share of toxic as of ordinary texts, one after another the run that covers most texts not covered COVER times yet."""
    a: Counter = Counter()
    b: Counter = Counter()
    own = [runs(t) for t in dict.fromkeys(toxic)]
    for r in own:
        a.update(r)
    a = Counter({r: n for r, n in a.items() if n >= max(4, 0.01 * len(own))})
    for t in dict.fromkeys(ordinary):
        b.update(r for r in runs(t) if r in a)
    lift = {r: (n / len(own)) / ((b[r] + 0.5) / (len(ordinary) + 1)) for r, n in a.items()}
    telling = {r for r, x in lift.items() if x >= LIFT}
    left = [[r & telling, COVER] for r in own]
    out: list[str] = []
    gain = Counter(r for rs, _ in left for r in rs)
    while gain and len(out) < SEGMENTS:
        best = max(gain, key=lambda r: (gain[r] * np.log(lift[r]), len(r), r))
        if gain[best] < 3:
            break
        out.append(best)
        for x in left:
            if x[1] and best in x[0]:
                x[1] -= 1
                if not x[1]:
                    gain.subtract(x[0])
        del gain[best]
        for r in [r for r in gain if r in best or gain[r] <= 0]:
            del gain[r]
    return out[::-1]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


class Distances:
    """Bytes that the toxic dictionary saves on each window, compared with the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(3, min_match=SHORTEST, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content):
            d = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

        self.plain, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        plain, toxic, known = self.plain, self.toxic, self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in windows(text):
            v = known.get(w)
            if v is None:
                x = ANCHOR + w
                v = known[w] = len(plain(x)) - len(toxic(x))
            out.append(v)
        return np.array(out, np.int64)


def features(saved: np.ndarray) -> list[float]:
    """The strongest savings, and the logarithms of the numbers of windows that save so much and of all windows."""
    if not len(saved):
        return [0.0] * (STRONGEST + len(SAVINGS) + 1)
    top = [*np.sort(saved)[::-1][:STRONGEST].tolist(), *[0] * STRONGEST][:STRONGEST]
    return [*(min(max(v, -4), 16) / 8 for v in top), *(float(np.log1p((saved >= k).sum())) for k in SAVINGS), float(np.log1p(len(saved)))]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton steps with an L2 penalty; the constant is the last column."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + l2 * len(z) * np.diag([1.0] * x.shape[1] + [1e-6]), z.T @ (p - y) + l2 * len(z) * np.append(w[:-1], 0))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[int, str, int]]):
    """From (doc_id, text, label), sorted: dictionaries and weights. The dictionaries come from two thirds of the
    sample, the curve from the rest, which they have not seen."""
    y = [r[2] for r in sample]
    if not 0 < sum(y) < len(y):
        return None if not y else float(np.mean(y))
    random.Random(11).shuffle(sample)
    cut = 2 * len(sample) // 3
    first, second = (sample[:cut], sample[cut:]) if len(sample) >= 60 else (sample, sample)
    toxic, ordinary = ([t for _, t, v in first if v == k] for k in (1, 0))
    if not toxic or not ordinary or len({r[2] for r in second}) < 2:
        first = second = sample
        toxic, ordinary = ([t for _, t, v in first if v == k] for k in (1, 0))
    drawn = [w for t in ordinary for w in windows(t)]
    drawn = drawn if len(drawn) <= DRAWN else random.Random(2).sample(drawn, DRAWN)
    plain = _dictionary(ORDINARY_BYTES, drawn)
    segments = [x.encode() for x in toxic_segments(toxic, ordinary)]
    telling: dict[bytes, bool] = {}
    occurrences = []
    for t in toxic:
        for w in words(t):
            w = b" " + w + b" "
            if w not in telling:
                telling[w] = any(x in w for x in segments)
            if telling[w]:
                occurrences.append(w)
    toxic_part = _dictionary(TOXIC_BYTES, occurrences)
    d = Distances(plain, toxic_part)
    saved = [d.of(t) for _, t, _ in second]
    label = np.array([r[2] for r in second], float)
    return plain, toxic_part, logistic(np.array([features(s) for s in saved]), label)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs(doc_id, text)`; `labels(doc_id, toxic)`."""
    y = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l")).agg(F.max("toxic").alias("y")).where(C.fold_of(F.col("l"), 3) != 1)
    n = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    rate = F.when(F.col("y") == 1, min(1.0, sample / max(n.get(1, 0), 1))).otherwise(min(1.0, sample / max(n.get(0, 0), 1)))
    chosen = y.where(F.pmod(F.xxhash64("l", F.lit("toxicity")), F.lit(1 << 20)) < rate * (1 << 20))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample's ids are about SAMPLE for each label whatever the input, so the texts stay where they are
    rows = own.where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("l")).select("doc_id", "text", "y").collect()
    model = fit(sorted((r.doc_id, r.text, int(r.y)) for r in rows))
    schema = C.arrow_schema("doc_id long, score double")

    def run(it):
        if isinstance(model, tuple):
            plain, toxic, w = model
            d = Distances(plain, toxic)
        for b in C.batches_of(it):
            if isinstance(model, tuple):
                x = np.array([[*features(d.of(t)), 1.0] for t in b.column(1).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(x.reshape(-1, len(w)) @ w, -30, 30)))
            else:
                s = np.full(b.num_rows, model or 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 9))], schema=schema)

    out = own.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(C.fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
