"""Packing by lexical retrieval: a sharded BM25 index gives each seed document its unused neighbours.

Documents are put in an order in which those with rare words in common lie near each other wherever they stood, and
cut by running token counts into shards of about SHARD_TOKENS. The order is that of two min-hashes of the token ids,
in which an id counts by the square of its inverse document frequency and the end id and ids of one document alone do
not count; documents that agree in one of BANDS bands of BAND_ROWS further min-hashes are moved together, each to the
smallest of its groups, which lies where its least min-hashes are. In a shard an inverted index over token
ids is built; inverse document frequencies and the mean length are those of the whole corpus (a vector as long as the
vocabulary). A window starts with a seed and is filled with the unused documents that score highest for it; the one
that crosses the end is cut, and its rest is the next seed. What is left at a shard's end is cut into sequences of
power-of-two lengths, which need no padding: no sequence has any.

Cases: null text counts as empty and is the end id alone; repeated rows are documents of their own, also where ids are
repeated or null; documents that score alike come in the shard's order; an empty table gives an empty result; other
columns are ignored; a document longer than a shard is a shard with more windows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import cached

LENGTH, SHARD_TOKENS = 1024, 1 << 18
K1, B = 1.2, 0.75
BANDS, BAND_ROWS, SEED = 8, 4, 7
_TOKENS = "rid long, doc_id long, n long, ids binary"
_NEAR = "rid long, n long, near long, bands array<long>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    schema = C.arrow_schema(_TOKENS)

    def run(it):
        from pyspark import TaskContext

        tok, rid = cached(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([end_id], tok.dtype).tobytes()
        for b in C.batches_of_text(it, 1):
            ids = [x + end for x in tok.encode_many(b.column(1))]
            n = [len(x) // tok.dtype.itemsize for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(ids))), b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=schema)
            rid += len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENS)


def distinct(d: np.ndarray) -> np.ndarray:
    """The distinct ids, ascending; ids of two bytes are sorted by radix."""
    s = np.sort(d, kind="stable")
    return s[np.flatnonzero(np.append(True, s[1:] != s[:-1]))] if len(s) else s


def _neighbourhood(tokens: DataFrame, idf: np.ndarray, shared: np.ndarray, dtype) -> DataFrame:
    """rid, n, lies (where the document's group lies), grp and near, by which the documents are put in order;
    `shared` says which ids count."""
    schema = C.arrow_schema(_NEAR)
    weight = np.where(shared, np.square(idf), 0).astype(np.float32)

    def run(it):
        with np.errstate(divide="ignore"):  # the least of exponential numbers over weights: agrees as often as weights do
            race = np.random.default_rng(SEED).exponential(size=(len(weight), 2 + BANDS * BAND_ROWS)).astype(np.float32) / weight[:, None]
        mix = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.int64) | 1
        for b in C.batches_of(it):
            near, bands = [], []
            for x in b.column(2).to_pylist():
                d = distinct(np.frombuffer(x, dtype))
                d = d[weight[d] > 0]
                if not len(d):
                    near.append((1 << 63) - 1)
                    bands.append([])
                    continue
                first = d[race[d].argmin(0)].astype(np.int64)
                near.append(int(first[0]) << 32 | int(first[1]))
                h = ((first[2:] + 1) * mix).reshape(BANDS, BAND_ROWS).sum(1)
                bands.append(h ^ (h >> 31))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    at = C.store(tokens.select("rid", "n", "ids").mapInArrow(run, _NEAR), "pack-near")
    t = tokens.sparkSession.read.schema(_NEAR).parquet(at)
    each = t.select("rid", "near", F.explode("bands").alias("band"))
    groups = C.materialize(each.groupBy("band").agg(F.count("*").alias("size"), F.min("near").alias("place")).where("size > 1"), "pack-groups")
    of = each.join(groups, "band").groupBy(F.col("rid").alias("r")).agg(F.min(F.struct("size", "band", "place")).alias("g"))
    out = C.materialize(t.join(of, t.rid == of.r, "left").select("rid", "n", F.coalesce("g.place", "near").alias("lies"), F.coalesce("g.band", F.lit(0)).alias("grp"), "near"), "pack-lies")
    C.drop(tokens.sparkSession, at)
    return out


class Index:
    """BM25 over the documents of a shard; each document a list of token ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, n = docs, len(docs)
        sizes = np.array([*map(len, docs)])
        small = len(idf) * n < 1 << 32
        key = np.concatenate(docs).astype(np.uint32 if small else np.uint64) * np.asarray(n, np.uint32 if small else np.uint64)
        key += np.repeat(np.arange(n, dtype=key.dtype), sizes)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf, key = np.diff(np.append(first, len(key))), key[first]
        t, self.owner = (key // n).astype(np.int64), (key % n).astype(np.int64)
        self.weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.owner] / mean))
        self.at = np.searchsorted(t, np.arange(len(idf) + 1))
        # terms of a quarter of the documents or more are kept as rows, whose number is at most four times a document's terms
        self.row = np.full(len(idf), -1, np.int64)
        often = np.flatnonzero(np.diff(self.at) * 4 >= len(docs))
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(docs)))
        r = self.row[t]
        self.rows[r[r >= 0], self.owner[r >= 0]] = self.weight[r >= 0]

    def scores(self, i: int) -> np.ndarray:
        """Of all documents for document i, by all its terms."""
        t = distinct(self.docs[i]).astype(np.int64)
        r = self.row[t]
        out, t = self.rows[r[r >= 0]].sum(0), t[r < 0]
        if not len(t):
            return out
        n = self.at[t + 1] - self.at[t]
        ends = np.cumsum(n)
        where = np.repeat(self.at[t] - (ends - n), n) + np.arange(ends[-1])
        return out + np.bincount(self.owner[where], weights=self.weight[where], minlength=len(self.docs))


def windows(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0."""
    index = Index(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    pieces, sequence, room = [], 0, length
    left = sum(map(len, docs))
    free = 0
    line: list[int] | None = None  # neighbours of the window's seed, the best last

    def capacity():
        return length if left >= length else 1 << (left.bit_length() - 1)

    room = size = capacity()
    doc, at, seed = -1, 0, -1
    while left:
        if doc < 0:
            if line is None and seed >= 0:  # looked up once the seed leaves room
                s = index.scores(seed)
                s[~unused] = -1
                most = min(room, len(s))
                best = np.argpartition(-s, most - 1)[:most] if most < len(s) else np.arange(len(s))
                best = best[s[best] > 0]
                line = best[np.lexsort((-best, s[best]))].tolist()
            while line and not unused[line[-1]]:
                line.pop()
            if line:
                doc = line.pop()
            else:
                while not unused[free]:
                    free += 1
                doc = free
            at = 0
            unused[doc] = False
        n = min(room, len(docs[doc]) - at)
        if room == size:  # the window's seed
            seed, line = doc, None
        pieces.append((doc, at, n, sequence, size - room))
        at, room, left = at + n, room - n, left - n
        if at == len(docs[doc]):
            doc = -1
        if not room:
            sequence += 1
            room = size = capacity() if left else 0
    return pieces


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece; `with_ids` adds its ids (little-endian, the width of the vocabulary)."""
    tok = cached(tokenizer)
    width, dtype = max(tok.tok.get_vocab_size(), end_id + 1), tok.dtype
    tokens = C.materialize(_tokenize(docs, tokenizer, end_id), "pack-tokens")

    def frequencies(it):
        out = np.zeros(width + 2)
        for b in C.batches_of(it):
            for x in b.column(0).to_pylist():
                d = np.frombuffer(x, dtype)
                out[distinct(d)] += 1
                out[-1] += len(d)
                out[-2] += 1
        return out

    stats = C.partial_sums(tokens.select("ids"), frequencies, width + 2)
    count, mean = stats[-2], stats[-1] / max(stats[-2], 1)
    idf = np.log1p((count - stats[:-2] + 0.5) / (stats[:-2] + 0.5)).astype(np.float32)
    shared = (stats[:-2] > 1) & (np.arange(width) != end_id)
    near = _neighbourhood(tokens, idf, shared, dtype)
    order = C.ordered_prefix(near, ["lies", "grp", "near", "rid"], "n", "pack-order")
    shard = order.select(F.col("rid").alias("r"), (F.col("before") / SHARD_TOKENS).cast("long").alias("shard"), F.col("position").alias("place"))
    dealt = tokens.join(shard, tokens.rid == shard.r).select("shard", "place", "doc_id", "ids")
    ddl = _PIECES + (", ids binary" if with_ids else "")
    schema = C.arrow_schema(ddl)

    def fill(table):
        table = table.sort_by("place")
        ids = table.column("doc_id").to_pylist()
        rows = [np.frombuffer(x, dtype) for x in table.column("ids").to_pylist()]
        first = table.column("shard")[0].as_py() << 32
        out: list[list] = [[] for _ in schema]
        for doc, at, n, sequence, offset in windows(rows, idf, mean, length):
            piece = rows[doc][at : at + n]
            row = (ids[doc], at, n, zlib.crc32(piece.astype("<u4").tobytes()), len(rows[doc]), first + sequence, offset, piece.tobytes())
            for c, v in zip(out, row, strict=False):
                c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return dealt.groupBy("shard").applyInArrow(fill, ddl)
