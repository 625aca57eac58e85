"""I-Match fingerprints: the distinct terms within a band of inverse document frequency, sorted and hashed, for
several randomised subsets of the lexicon.

The lexicon is what lies in the band over all documents: a term in at least LOW and at most HIGH of them (as shares).
So its size is at most (mean number of distinct terms) / LOW however many documents there are; eight bytes for each term
are sent to all tasks. Of a
text, the distinct terms in the lexicon's k-th random subset are sorted and hashed, for k < SUBSETS. Subsets keep
shares from a sixth down, each a fixed factor less than the one before, so that texts of any length have some subsets
with a few of their terms; an empty one is written as zeros. Likeness is the number of equal hashes over the number
of subsets in which either text has a term (whole fingerprints are compared if neither has any; a text without terms
in any subset has the hash of all its terms as its last part).

Terms are what stands between white space, lowered.

Cases: null counts as empty; texts without any term are alike; very long texts are taken whole; repeated rows and ids
come out each, rows of one id (null ids last) in the order of a hash of their text; the table's only row is its own next
one; an empty table gives an empty result; other columns are ignored. Rows of one id are split between tasks by their
texts; rows with both id and text alike are not.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LOW, HIGH, SUBSETS, FACTOR, DIGITS = 0.0005, 0.10, 24, 0.8, 8
#: Rows sampled for each range of ids, to find the ranges' ends; terms that a task remembers (then all are forgotten).
SAMPLED, REMEMBERED = 64, 300_000
LEAST_KEY = -(1 << 63)


def distinct_terms(texts: pa.Array | list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the terms of these texts; and for each text and term in it once: the text's number, the term's."""
    col = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(col))
    words = lists.values.dictionary_encode()
    names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    pairs = np.repeat(np.arange(len(col), dtype=np.int64), sizes) << 32 | words.indices.to_numpy(zero_copy_only=False)
    pairs = np.unique(pairs)
    of, term = pairs >> 32, pairs & 0xFFFFFFFF
    if "" in names:  # around white space at a text's ends
        good = term != names.index("")
        of, term = of[good], term[good]
    return names, of, term


def term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


def subsets_of(h: int) -> int:
    """Bit k: the term is in the k-th subset (a share of FACTOR**k / 6 of all), by a seeded hash of it."""
    d = hashlib.blake2b(h.to_bytes(8, "little", signed=True), digest_size=2 * SUBSETS, key=b"lexicon").digest()
    return sum(1 << k for k in range(SUBSETS) if int.from_bytes(d[2 * k : 2 * k + 2], "little") < FACTOR**k * 10923)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; counts are exact and over all documents."""

    def count(it):
        seen: Counter = Counter()
        n = 0
        for b in C.batches_of_text(it, 0):
            names, _, term = distinct_terms(b.column(0))
            held = np.bincount(term, minlength=len(names))
            seen.update({t: c for t, c in zip(names, held.tolist(), strict=True) if c})
            n += b.num_rows
            if len(seen) > 400_000:
                yield out(seen)
                seen = Counter()
        seen[""] = n  # no term is empty: the number of documents
        yield out(seen)

    def out(seen):
        return pa.RecordBatch.from_arrays([pa.array([term_hash(t) for t in seen], pa.int64()), pa.array([*seen.values()], pa.int64())], names=["term", "n"])

    at = C.store(docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "imatch-df")
    df = docs.sparkSession.read.schema("term long, n long").parquet(at)
    total = (df.where(F.col("term") == term_hash("")).first() or {"n": 0})["n"]
    band = df.where((F.col("term") != term_hash("")) & (F.col("n") >= max(low * total, 2)) & (F.col("n") <= high * total)).select("term")
    words = np.sort(band.toArrow().column("term").to_numpy().astype(np.int64))
    C.drop(docs.sparkSession, at)
    return words


class Fingerprints:
    """Fingerprints of many texts at once; terms met are remembered, up to a bound."""

    def __init__(self, words: np.ndarray):
        self.words, self.known = words, {}

    def _of_terms(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and subsets (as bits; 0 outside the lexicon) of each term."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [t for t in names if t not in known]
        h = np.array([term_hash(t) for t in new], np.int64)
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        hit = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        for t, x, in_lexicon in zip(new, h.tolist(), hit.tolist(), strict=True):
            known[t] = (x, subsets_of(x) if in_lexicon else 0)
        out = np.array([known[t] for t in names], np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    def of_many(self, texts: pa.Array | list) -> tuple[np.ndarray, list[str]]:
        """For each text SUBSETS hashes (0: the subset has no term of it), and with the last part as hexadecimal text."""
        names, of, term = distinct_terms(texts)
        n = len(texts)
        h, bits = self._of_terms(names)
        h, bits = h[term], bits[term]
        inside = bits != 0
        by = np.lexsort((h, of))
        every, all_h = of[by], h[by]
        of, h, bits = (x[by][inside[by]] for x in (of, h, bits))
        some = np.bincount(of, minlength=n) > 0
        parts = np.zeros((n, SUBSETS, DIGITS // 2), np.uint8)
        for k in range(SUBSETS):
            on = bits >> k & 1 == 1
            at = np.searchsorted(of[on], np.arange(n + 1)).tolist()
            data = h[on].tobytes()
            for i in range(n):
                if at[i] < at[i + 1]:
                    parts[i, k] = np.frombuffer(hashlib.blake2b(data[8 * at[i] : 8 * at[i + 1]], digest_size=DIGITS // 2).digest(), np.uint8)
        ends = np.searchsorted(every, np.arange(n + 1)).tolist()
        rest = [hashlib.blake2b(b"" if some[i] else all_h[ends[i] : ends[i + 1]].tobytes(), digest_size=DIGITS // 2).hexdigest() for i in range(n)]
        return parts.view(">u4")[:, :, 0], [parts[i].tobytes().hex() + rest[i] for i in range(n)]


def likeness(a: tuple[np.ndarray, list[str]], b: tuple[np.ndarray, list[str]]) -> np.ndarray:
    """Of fingerprints row by row: equal hashes over the subsets in which either has a term."""
    some = (a[0] != 0) | (b[0] != 0)
    n = some.sum(1)
    whole = np.array([x == y for x, y in zip(a[1], b[1], strict=True)], float)
    return np.where(n > 0, ((a[0] == b[0]) & some).sum(1) / np.maximum(n, 1), whole)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """Ends of n ranges of about equal numbers of rows, from a sample of `keys(k, h)` whose copies are counted, not sent."""
    rate = min(1.0, SAMPLED * n / max(keys.count(), 1))
    some = keys.where(F.pmod(F.xxhash64("k", "h", F.lit("ranges")), F.lit(1 << 30)) < rate * (1 << 30))
    rows = sorted((r.k, r.h, r["count"]) for r in some.groupBy("k", "h").count().collect())
    total, seen, ends, i = sum(r[2] for r in rows), 0, [], 1
    for k, h, c in rows:
        seen += c
        if i < n and seen * n >= total * i:
            ends.append((k, h))
        while i < n and seen * n >= total * i:
            i += 1
    return ends


def _range_of(ends: list[tuple[int, int]]):
    """The number of ends that lie before (k, h), by binary search."""
    if not ends:
        return F.lit(0)
    ks, hs = (F.array(*[F.lit(e[i]).cast("long") for e in ends]) for i in (0, 1))
    half = lambda s: F.floor((s.lo + s.hi) / 2).cast("int")

    def step(s, _):
        k, h = F.get(ks, half(s)), F.get(hs, half(s))
        later = (k < F.col("k")) | ((k == F.col("k")) & (h < F.col("h")))
        return F.when(s.lo >= s.hi, s).when(later, F.struct((half(s) + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), half(s).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1)), start, step, lambda s: s.lo)


def compare(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, next documents by descending doc_id.

    Documents are dealt into ranges of (doc_id, hash of the text), one for each task, and sorted there; the first
    document of each range is copied to the range before it, so each one's next is at hand. The ranges' ends and first
    documents are one row each.
    """
    spark = docs.sparkSession
    n = C.partitions(spark)
    words = spark.sparkContext.broadcast(lexicon(docs, low, high))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_KEY))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.bitwise_not(key).alias("k"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    number = _range_of(_ranges(rows.select("k", "h"), n)).cast("int")
    firsts = rows.select("k", "h").withColumn("bucket", number).groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("f")).collect()
    firsts = sorted((r.bucket, r.f.k, r.f.h) for r in firsts)
    copies = [(*firsts[(i + 1) % len(firsts)][1:], b) for i, (b, _, _) in enumerate(firsts)]
    extra = spark.createDataFrame(copies, "k long, h long, to int")  # one row for each range
    again = rows.join(F.broadcast(extra), ["k", "h"]).dropDuplicates(["to"]).select("k", "h", "doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("copy"))
    own = rows.withColumns({"bucket": number, "copy": F.lit(0)})
    dealt = own.unionByName(again).repartitionById(n, "bucket").sortWithinPartitions("bucket", "copy", "k", "h")
    schema = C.arrow_schema(_OUT)

    def run(it):
        f = Fingerprints(words.value)
        held = None  # doc_id, text and fingerprint of the row that waits for its next one
        for b in C.batches_of_text(it, 1):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            prints = f.of_many(b.column(1))
            if held is not None:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], (np.vstack([held[2][0], prints[0]]), held[2][1] + prints[1])
            held = (ids[-1], texts[-1], (prints[0][-1:], prints[1][-1:]))
            changed = [edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
            if not changed:
                continue
            here, after, other = (prints[0][:-1], prints[1][:-1]), (prints[0][1:], prints[1][1:]), f.of_many(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:-1], pa.int64()), pa.array([*map(len, texts[:-1])], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array(here[1]), pa.array(other[1]), pa.array(likeness(here, other)), pa.array(likeness(here, after)),
                ],
                schema=schema,
            )  # the last row of a range is the copy of the next range's first

    return dealt.select("doc_id", "text").mapInArrow(run, _OUT)
