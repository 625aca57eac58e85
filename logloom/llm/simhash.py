"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into `threshold // 2 + 1` segments (three for a threshold of 4 or 5), so that of two
fingerprints within the threshold some segment differs by one bit at most. Each segment is indexed once for each of
its bits, with that bit wildcarded; two segments within one bit share such a key. Fingerprints that share a key are
verified by their distance and linked. Only distinct fingerprints are indexed, so exact copies cost one row.

Within a key the links are found by search from row to row among those not reached yet, and a spanning forest is
given out, never all pairs; a key with more than BLOCK fingerprints is cut into blocks, and the rest of the pairs is
covered exactly by tasks that each take two blocks.

Cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows and ids come out once
for each row from `classes`; a class that has only null ids has a null component_id; very long texts are hashed whole;
an empty table gives an empty result; other columns, whatever their names, are ignored by `classes` and kept by
`keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD, WORDS, BLOCK = 4, 4, 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half of the shingles' XXH64; the top bit of a hash is the fingerprint's top bit."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    if len(w) <= words:
        h = [xxh64_intdigest(b" ".join(w), 42)]
    else:
        h = [xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(len(w) - words + 1)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(np.array(h[i : i + 4096], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    schema = C.arrow_schema("doc_id long, fp long")

    def run(it):
        for b in C.batches_of(it):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(threshold: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment; with s segments some one differs by at most threshold // s <= 1 bits."""
    s = threshold // 2 + 1
    sizes = [64 // s + (i < 64 % s) for i in range(s)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def variants(fps: DataFrame, threshold: int) -> DataFrame:
    """One row (key, fp) for each fingerprint and bit: which bit, and the bits of its segment without it."""
    keys = [
        F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit))).bitwiseOR(F.lit(shift + bit << 40))
        for shift, bits in segments(threshold)
        for bit in range(bits)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked within `threshold` bits: each row taken from those reached looks only at
    rows not reached yet, so a dense group costs little more than its size."""
    edges, left = [], fps.view(np.uint64)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= threshold
            if near.any():
                got = left[near]
                edges += [(x, y) for y in got]
                todo += [*got]
                left = left[~near]
    return edges


def _links(keyed: DataFrame, key: list[str], threshold: int, most: int | None) -> DataFrame:
    """Spanning forests of the groups of `keyed(*key, fp)`: edges (a, b), `late` null. Rows of a group come one after
    another; one of more than `most` is not looked at but given out as rows (fp, key) with `late` set."""
    ddl, k = "a long, b long, late boolean", len(key)
    schema = C.arrow_schema(ddl)

    def edges_of(fp, ends):
        edges, size = [], np.diff(ends)
        two = ends[:-1][size == 2]
        if len(two):
            x, y = fp[two], fp[two + 1]
            ok = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= threshold
            edges = [np.stack([x[ok], y[ok]], 1)]
        for i in np.flatnonzero(size > 2).tolist():
            if found := forest(fp[ends[i] : ends[i + 1]], threshold):
                edges.append(np.array(found, np.uint64).view(np.int64))
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        return batch(np.unique(np.sort(e, axis=1), axis=0), None)

    def batch(rows, late):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array([late] * len(rows), pa.bool_())], schema=schema)

    def run(it):
        rest, large = None, None  # rows of the last group so far; its key, once it is too large
        for b in it:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)]
            if large is not None:
                n = int(np.argmin(np.append(cols[0] == large, False)))
                yield batch(np.stack([cols[1][:n], cols[0][:n]], 1), True)
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                large = None
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            change = np.zeros(max(len(cols[0]) - 1, 0), bool)
            for c in cols[:k]:
                change |= c[1:] != c[:-1]
            ends = np.concatenate([[0], np.flatnonzero(change) + 1])
            yield edges_of(cols[k], ends)
            rest = [c[ends[-1] :] for c in cols]
            if most and len(rest[0]) > most:
                large = rest[0][0]
                yield batch(np.stack([rest[1], rest[0]], 1), True)
                rest = None
        if rest is not None:
            yield edges_of(rest[k], np.array([0, len(rest[k])]))

    n = C.partitions(keyed.sparkSession)
    return keyed.select(*key, "fp").repartition(n, *key).sortWithinPartitions(*key, "fp").mapInArrow(run, ddl)


def links(fps: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of `fps(fp)`, enough to connect all that are linked."""
    found = C.materialize(_links(variants(fps, threshold), ["key"], threshold, block), "simhash-links")
    edges, late = found.where("late is null").select("a", "b"), found.where("late").select(F.col("a").alias("fp"), F.col("b").alias("key"))
    if late.isEmpty():
        return edges
    counts = C.materialize(late.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "simhash-large")
    own = late.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    pairs = own.select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    both = pairs.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    return edges.unionByName(_links(both, ["key", "p", "q"], threshold, None).select("a", "b"))


def classes(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links."""
    table = C.materialize(fingerprints(docs, words), "simhash-fp")
    fps = C.materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    comp = C.components(links(fps.select("fp"), threshold), "simhash")
    labelled = C.materialize(fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-label")
    least = C.materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    of = C.materialize(labelled.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-of")
    return table.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def of_hashes(h: np.ndarray) -> int:
    """Fingerprint of a set of shingles by their 64-bit hashes: bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def candidates(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of `sets(sid, fp)` that are worth comparing: sets of one fingerprint, each with the least of them,
    and the least ones of fingerprints that the signatures link."""
    one = C.materialize(sets.groupBy("fp").agg(F.min("sid").alias("least")), "simhash-one")
    same = sets.join(one, "fp").where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    edges = links(one.select("fp"), threshold)
    of_a, of_b = one.select(F.col("fp").alias("a"), F.col("least").alias("x")), one.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    near = edges.join(of_a, "a").join(of_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near).distinct()


def keep_one(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without near copies: of those linked by a similarity of 4/5 or more of their `words`-word shingles
    the one with the smallest doc_id stays (a null id, if there is no other), one row of it, with all columns.

    The signatures give the first candidates, which are verified by their whole sets of shingles. What they cannot
    reach (two texts at 4/5 differ in about ten bits of 64) is found by the exact join of `jaccard`, which starts from
    the links that the signatures gave and leaves out pairs that these connect.
    """
    from . import jaccard

    return jaccard.keep_one(docs, words, threshold=threshold)
