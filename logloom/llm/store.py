"""Token-id output as a content-addressed store.

Layout below `path` (Parquet): `chunks` (digest, n, payload) holds each distinct chunk of ids once; `recipes`
(doc_id, start, n_tokens, digests, lengths, root) in ascending doc_id order (nulls first), one row a document, lists
its chunks and the root of the Merkle tree over them, and its position in that order; `manifest` (level, block, start,
documents, n_tokens, root) has for each FAN documents the root over their roots, for each FAN of those the root over
them, and so on up to one root of the store. Chunks end where a rolling hash over the last WINDOW ids has its low bits
zero, so equal passages give equal chunks wherever they stand; payloads are little-endian ids of two bytes where the
vocabulary allows it. `read` holds all three against each other.

Cases: null text counts as empty and has the end id only; repeated rows are documents of their own (their chunks are
stored once); a very long text is one document of many chunks; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import cached

WINDOW, LEAST, MOST, MASK = 8, 64, 2048, (1 << 8) - 1
#: Roots under one root of the manifest; digests that a task remembers as given out (all are forgotten beyond it).
FAN, SEEN = 4096, 400_000
_TOKENS = "rid long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, fresh array<struct<digest: binary, payload: binary>>"
_LEVEL = "block long, start long, documents long, n_tokens long, root binary"


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: the rolling hash over the WINDOW ids before has its low bits zero."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    factor, k = 0xBF58476D1CE4E5B9, 1
    while k < WINDOW:  # the hash over 2k ids from those over k
        x = x[: max(len(x) - k, 0)] * np.uint64(factor) + x[k:]
        factor, k = factor * factor % (1 << 64), 2 * k
    return np.flatnonzero((x >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW


def chosen(ends: list[int], n: int) -> list[int]:
    """Ends of chunks among the boundaries: at least LEAST and at most MOST ids apart (the last may be shorter)."""
    cuts, last = [], 0
    for e in [*ends, n]:
        while e - last > MOST:
            last += MOST
            cuts.append(last)
        if e - last >= LEAST and e < n:
            cuts.append(e)
            last = e
    return cuts if last == n and n else [*cuts, n]


def cut_points(ids: np.ndarray) -> list[int]:
    return chosen(boundaries(ids).tolist(), len(ids))


def cut_many(ids: list[bytes], dtype: np.dtype) -> list[list[int]]:
    """`cut_points` of each document; the hash runs over all of them at once, windows across two are left out."""
    flat = np.frombuffer(b"".join(ids), dtype)
    ends = np.cumsum([len(x) // dtype.itemsize for x in ids])
    b = boundaries(flat)
    of = np.searchsorted(ends, b, side="left")  # a boundary at a document's end is its own
    first = np.concatenate([[0], ends[:-1]])
    good = b - first[of] >= WINDOW
    b, of = b[good], of[good]
    at = np.searchsorted(of, np.arange(len(ids) + 1))
    local = (b - first[of]).tolist()
    sizes = (ends - first).tolist()
    return [chosen(local[at[i] : at[i + 1]], n) for i, n in enumerate(sizes)]


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves; leaves and inner nodes are told apart by a prefix, an odd node moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row for each document; `fresh` has those of its chunks that the task has not given out before, so that a chunk
    of any number of documents leaves a task few times."""
    schema = C.arrow_schema(_TOKENS)

    def lists(values, counts, kind):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), kind)

    def run(it):
        from pyspark import TaskContext

        tok, rid, seen = cached(tokenizer), TaskContext.get().partitionId() << 33, set()
        w = tok.dtype.itemsize
        end = np.array([end_id], tok.dtype).tobytes()
        for b in C.batches_of_text(it, 1):
            ids = [x + end for x in tok.encode_many(b.column(1))]
            cuts = cut_many(ids, tok.dtype)
            digests, roots, fresh, payloads, new = [], [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for x, own in zip(ids, cuts, strict=True):
                at, before, here = 0, len(fresh), []
                for e in own:
                    chunk = x[at : e * w]
                    at = e * w
                    d = hashlib.sha256(chunk).digest()[:20]
                    here.append(d)
                    if d not in seen:
                        seen.add(d)
                        fresh.append(d)
                        payloads.append(chunk)
                digests += here
                roots.append(merkle(here))
                new.append(len(fresh) - before)
            counts = [len(c) for c in cuts]
            lengths = np.concatenate([np.diff([0, *c]) for c in cuts]).astype(np.int32)
            own = pa.StructArray.from_arrays([pa.array(fresh, pa.binary()), pa.array(payloads, pa.binary())], fields=list(schema.field("fresh").type.value_type))
            cols = [
                pa.array(np.arange(rid, rid + len(ids))), b.column(0), pa.array([len(x) // w for x in ids], pa.int64()), lists(digests, counts, pa.array(digests, pa.binary())),
                lists(lengths, counts, pa.array(lengths)), pa.array(roots, pa.binary()), lists(own, new, own),
            ]
            rid += len(ids)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode `docs(doc_id, text)` and write the store below `path`."""
    spark, n = docs.sparkSession, C.partitions(docs.sparkSession)
    at = C.store(_tokenize(docs, tokenizer, end_id), "cas-tokens")
    tokens = spark.read.parquet(at)
    width = cached(tokenizer).dtype.itemsize
    rows = tokens.select(F.explode("fresh").alias("c")).select("c.digest", F.expr(f"octet_length(c.payload) div {width}").alias("n"), "c.payload")
    # a digest comes at most a few times from each task: nothing is left to combine before the shuffle
    rows.repartition(n, "digest").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    order, used = C.ordered_prefix_at(tokens.select("rid", "doc_id", "n_tokens", "digests", "lengths", "root"), ["doc_id", "rid"], "n_tokens", "cas-order", before="start")
    recipes = order.select("rid", "doc_id", "position", "start", "n_tokens", "digests", "lengths", "root").repartitionByRange(n, "start").sortWithinPartitions("start")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    C.drop(spark, used)
    C.drop(spark, at)
    _manifest(spark, path).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Roots of blocks of FAN documents, of FAN such blocks, up to one, computed from the recipes. A task holds FAN roots."""
    schema = C.arrow_schema(_LEVEL)

    def fold(table):
        t = table.sort_by("pos")
        cols = (t.column("block")[0], t.column("start")[0], pc.sum(t.column("documents")), pc.sum(t.column("n_tokens")))
        return pa.table([*(pa.array([c.as_py()], pa.int64()) for c in cols), pa.array([merkle(t.column("root").to_pylist())], pa.binary())], schema=schema)

    rows = spark.read.parquet(f"{path}/recipes").select(F.col("position").alias("pos"), "start", F.lit(1).cast("long").alias("documents"), "n_tokens", "root")
    left, level, out = rows.count(), 0, None
    while left > 1 or level == 0:
        left, level = -(-left // FAN), level + 1
        rows = C.materialize(rows.withColumn("block", F.expr(f"pos div {FAN}")).groupBy("block").applyInArrow(fold, _LEVEL), "cas-level")
        one = rows.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
        rows = rows.withColumnRenamed("block", "pos")
    return out


def _shift_tables() -> np.ndarray:
    """For each k, four tables of 256: a CRC-32 register moved over 2**k zero bytes."""

    def times(mat, v):
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint32(i)) & np.uint32(1), mat[i], np.uint32(0))
        return out

    bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = np.where(bit & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (bit >> np.uint32(1))  # over one zero bit
    mat = one
    for _ in range(3):
        mat = times(mat, mat)
    tables = []
    for _ in range(34):
        tables.append([times(mat, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)])
        mat = times(mat, mat)
    return np.array(tables)


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from their parts' CRCs and sizes in bytes; `first`: where each one's parts begin."""
    if not len(first):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(sizes)
    after = np.repeat(ends[np.append(first[1:], len(sizes)) - 1], np.diff(np.append(first, len(sizes)))) - ends
    c = crcs.astype(np.uint32)
    k = 0
    while (after >> k).any():
        on = (after >> k) & 1 == 1
        v = c[on]
        t = tables[k]
        c[on] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
        k += 1
    return np.bitwise_xor.reduceat(c, first)


def read(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers).

    Every chunk is held against its digest, every recipe against its Merkle root, and the manifest against the recipes;
    a difference stops the job (that of the manifest at once). Chunks are not moved to the documents: the checksum of a
    document follows from those of its chunks.
    """
    has, want = spark.read.parquet(f"{path}/manifest"), _manifest(spark, path)
    if not has.exceptAll(want).isEmpty() or not want.exceptAll(has).isEmpty():
        raise ValueError("the manifest does not agree with the recipes: one of them is damaged")
    schema = C.arrow_schema("digest binary, n long, crc long")

    def chunks(it):
        dt = np.dtype(f"<u{width}")
        for b in C.batches_of(it, 2048):
            crcs = []
            for digest, n, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if hashlib.sha256(payload).digest()[:20] != digest or len(payload) != n * width:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(payload, dt).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], schema=schema)

    crcs = spark.read.parquet(f"{path}/chunks").select("digest", "n", "payload").mapInArrow(chunks, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    used = recipes.select("rid", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    crcs = crcs.select(F.col("digest").alias("chunk"), F.col("n").alias("c_n"), "crc")
    parts = used.join(crcs, used.digest == crcs.chunk, "left").groupBy("rid").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root")), F.collect_list(F.struct("pos", "digest", F.coalesce("c_n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))).alias("parts")
    )
    out = C.arrow_schema("doc_id long, start long, n_tokens long, ids_crc32 long")

    def documents(it):
        tables = _shift_tables()
        for b in C.batches_of(it, 2048):
            column = b.column(4)
            counts = pc.list_value_length(column).to_numpy()
            first = np.cumsum(counts) - counts
            flat = column.flatten()
            by = np.lexsort((flat.field("pos").to_numpy(), np.repeat(np.arange(len(counts)), counts)))
            sizes, crcs = flat.field("n").to_numpy()[by], flat.field("crc").to_numpy()[by]
            digests = flat.field("digest").take(pa.array(by)).to_pylist()
            total = np.add.reduceat(sizes, first) if len(first) else sizes
            if (sizes < 0).any() or (total != b.column(2).to_numpy()).any() or any(merkle(digests[i : i + k]) != root for i, k, root in zip(first.tolist(), counts.tolist(), b.column(3).to_pylist(), strict=True)):
                raise ValueError("a recipe is damaged or a chunk is missing")
            crc = joined_crcs(crcs, sizes * 4, first, tables)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc.astype(np.int64))], schema=out)

    return parts.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, payload: the ids of each document, put together from its chunks."""
    used = spark.read.parquet(f"{path}/recipes").select("rid", "doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    whole = used.join(spark.read.parquet(f"{path}/chunks"), "digest").groupBy("rid", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("p"))
    return whole.select("doc_id", "start", F.expr("unhex(array_join(transform(p, x -> hex(x.payload)), ''))").alias("payload"))


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write a store to the shared folder and read it back."""
    path = C.scratch_path(docs.sparkSession, "cas-store")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, cached(tokenizer).dtype.itemsize)
