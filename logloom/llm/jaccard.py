"""The exact part of near-duplicate removal (`simhash.keep_one`): texts whose word shingles have a Jaccard similarity of
4/5 or more, starting from the candidates that SimHash signatures give.

The shingles of a text are put in one order that all texts share, those that are frequent in a sample last. Two sets
that are similar enough have a shingle in common among the first fifth of each (prefix filter), and from where their
first common one stands at least 4/9 of both sizes' sum must follow in each (position filter, which covers sizes too).
What the order is does not matter to the result, so the sample costs no pair. Candidates are verified by their whole
sets before they are linked, so that the components are those of brute force.

A shingle shared by many texts would give the square of their number in pairs. Where that is so, its texts are
compared with one of them first, and pairs of texts that are linked by then are left out; ROUNDS times at most, or until
the pairs that are left are no more than DENSE for each document, after which all of them are compared: in groups, by bitmaps, where a pair that shares several
shingles is given out once, and in rounds, in which a set gives out a few pairs at first and more as long as it has more,
so that pairs of texts that earlier ones have linked are left out.

Pairs are first held against bitmaps of the sets' hashes: a bit that only one set has stands for a shingle that the
other lacks, so a pair with too many of these cannot be similar. No similar pair is left out by it, and texts and whole
sets are moved only for what is left.

Cases: a text with fewer than WORDS words is one shingle, one without words too, so these are linked; null counts as
empty; equal sets are one set (told apart by 64 bits); very long texts are compared whole; of rows with one id and text
one stays; an empty table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import _LOWER, THRESHOLD, candidates, of_hashes

WORDS = 5
#: Documents sampled for the order, and the most shingles that it tells apart from rare ones (16 bytes each are broadcast).
SAMPLE, FREQUENT = 8000, 1 << 17
#: Pairs for each row of a shared shingle from which on its texts are compared with one of them first, and how often.
DENSE, ROUNDS = 16, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a set's bitmap.
BITMAP = 16
#: Rows of a group in which pairs are compared come from two blocks at most; pairs looked at together; how many pairs of a
#: set a group gives out by round, all of them in the end.
BLOCK, PAIRS, MOST = 4096, 1 << 20, (4, 64, 1024, 1 << 40)
_PREFIX = "doc_id long, digest long, sid long, n int, first binary, fp long, bits array<long>, wide array<long>"
#: Set ids that a task remembers, so that copies of one set leave it once (all are forgotten beyond it).
SEEN = 400_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `words` words; A-Z lowered."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().translate(_LOWER).split()
    codes = {x: xxh64_intdigest(x, 42) for x in set(w)}
    c = np.array([codes[x] for x in w], np.uint64)
    k = min(words, len(c))
    h = np.full(len(c) - k + 1 if k else 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _MIX + c[i : len(c) - k + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def bitmap(h: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """One bit for each of the hashes, at its lowest bits' place among 64 * words."""
    bits = np.zeros(64 * words, np.uint8)
    bits[(h % np.uint64(64 * words)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def wide_bitmap(h: np.ndarray) -> np.ndarray | None:
    """A bitmap of two to four bits for each hash, for sets that fill more than half of the other; its halves laid over
    each other are the bitmap of half the width."""
    return None if 2 * len(h) <= 64 * BITMAP else bitmap(h, 1 << (2 * len(h) - 1).bit_length() - 6)


def frequent(docs: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles found more than once in a sample of documents, and their counts."""
    rate = min(1.0, sample / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < rate * (1 << 20)).select("text")
    schema = C.arrow_schema("h long")

    def run(it):
        for b in C.batches_of(it):
            h = [shingles(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], schema=schema)

    counts = C.materialize(some.mapInArrow(run, "h long").groupBy("h").count().where("count > 1"), "near-frequent")
    least, total = 2, 0
    for r in sorted(counts.groupBy("count").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > FREQUENT:
            least = r["count"] + 1
            break
    rows = counts.where(F.col("count") >= least).toArrow()
    h = rows.column("h").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], rows.column("count").to_numpy()[by]


def prefixes(docs: DataFrame, words: int, sample: int) -> DataFrame:
    """doc_id, digest (of the text), sid (of the set), n (its size), first (32 bits of each shingle of the prefix),
    fp (SimHash fingerprint of the set), bits (its bitmap), wide (a wider one of a large set, else null)."""
    schema = C.arrow_schema(_PREFIX)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, words, sample))

    def run(it):
        from xxhash import xxh3_64_intdigest

        known, counts = shared.value
        for b in C.batches_of(it):
            sid, n, first, fp, bits, wide = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t, words)
                sid.append(xxh3_64_intdigest(h.tobytes()))
                n.append(len(h))
                fp.append(of_hashes(h))
                bits.append(bitmap(h))
                wide.append(wide_bitmap(h))
                take = len(h) - -(-4 * len(h) // 5) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
                first.append((h[:take] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(first, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, _PREFIX)


def shared_shingles(table: DataFrame) -> DataFrame:
    """Rows (token, sid, n, at) of the prefixes' shingles that several sets have, one of them early enough to count."""
    ddl = "token int, sid long, n int, at int"
    schema = C.arrow_schema(ddl)

    def spread(it):
        seen: set[int] = set()
        for b in C.batches_of(it):
            ids = b.column(0).to_pylist()
            new = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
            if len(seen) > SEEN:
                seen.clear()
            b = b.take(pa.array(new, pa.int64()))
            f = [np.frombuffer(x, "<i4") for x in b.column(2).to_pylist()]
            if not f:
                continue
            size = [len(x) for x in f]
            cols = [np.concatenate(f), np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(1).to_numpy(), size), np.concatenate([np.arange(k, dtype=np.int32) for k in size])]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)

    def run(it):
        # of a shingle early rows come first: whether it counts is known from its first row, and once a second set is
        # met all of its rows are given out as they come; so one row is held, whatever the number of sets
        held = None  # the first row of the last shingle, while it has no second set
        last = (None, None)  # shingle and set of the last row
        counts = False  # the last shingle's first row is early
        for b in it:
            token, sid, n, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(token):
                continue
            head = np.append(token[0] != last[0], token[1:] != token[:-1])
            new = np.append(head[0] or sid[0] != last[1], head[1:] | (sid[1:] != sid[:-1]))
            early = 9 * at.astype(np.int64) <= n
            group = np.cumsum(head)  # 0: the shingle that the batch before ended with
            good = np.append(counts, early[head])
            sets = np.bincount(group, weights=new, minlength=len(good)).astype(np.int64)
            sets[0] += 1 if held is not None else 2  # a second set has been met if none is held
            keep = new & good[group] & (sets[group] > 1)
            out = [c[keep] for c in (token, sid, n, at)]
            if held is not None and good[0] and sets[0] > 1:
                out = [np.append(h, c) for h, c in zip(held, out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, schema, strict=True)], schema=schema)
            if len(good) > 1:
                i = int(np.flatnonzero(head)[-1])
                held = (token[i], sid[i], n[i], at[i]) if sets[-1] == 1 else None
            elif sets[0] > 1:
                held = None
            last, counts = (token[-1], sid[-1]), bool(good[-1])

    rows = table.select("sid", "n", "first").mapInArrow(spread, ddl)
    dealt = rows.repartition(C.partitions(table.sparkSession), "token")
    return dealt.sortWithinPartitions("token", (9 * F.col("at").cast("long") <= F.col("n")).desc(), "sid").mapInArrow(run, ddl)


def verified(pairs: DataFrame, table: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those of `pairs(a, b)` of set ids that are similar by their whole sets. Sets meet row by row in the JVM: no task
    holds more of them than a sort does, and that spills."""
    ids = C.materialize(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "near-ids")
    # one text of each set; by id and digest, which any text with the same set will do for
    one = C.materialize(table.join(ids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("o")).select("sid", "o.doc_id", F.col("o.digest").alias("d")), "near-one")
    texts = docs.select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("t")).withColumn("key", F.xxhash64("i", "t"))
    few = C.sieve(texts, "key", one.select(F.xxhash64("doc_id", "d").alias("key")))  # most texts are not moved
    own = few.join(one, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("d")), "inner")
    schema = C.arrow_schema("sid long, h array<long>")

    def whole(it):
        for b in C.batches_of(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], schema=schema)

    sets = C.materialize(own.select("sid", "text").mapInArrow(whole, "sid long, h array<long>").dropDuplicates(["sid"]), "near-sets")
    x, y = sets.select(F.col("sid").alias("a"), F.col("h").alias("x")), sets.select(F.col("sid").alias("b"), F.col("h").alias("y"))

    both = F.size(F.array_intersect("x", "y"))
    similar = 9 * both >= 4 * (F.size("x") + F.size("y"))  # both / (|x| + |y| - both) >= 4 / 5
    return pairs.join(x, "a").join(y, "b").where(similar).select("a", "b")


def links(table: DataFrame, docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame | None:
    """Components (node, label) of the set ids that are linked; None without any link."""
    sketch = C.materialize(table.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "bits", "wide"))), "near-bits")
    begin = C.mark()
    tested = C.materialize(_possible(candidates(table.select("sid", "fp").distinct(), threshold), sketch), "near-first")
    edges = C.materialize(verified(tested, table, docs, words), "near-found")
    C.sweep(begin, tested, edges)
    comp = None if edges.isEmpty() else C.components(edges, "near")
    cur = C.materialize(_labelled(shared_shingles(table), comp), "near-shared")
    most = DENSE * table.count()
    early = 9 * F.col("at") <= F.col("n")
    fits = lambda p, q: 9 * F.least(F.col(f"{p}.n") - F.col(f"{p}.at"), F.col(f"{q}.n") - F.col(f"{q}.at")) >= 4 * (F.col(f"{p}.n") + F.col(f"{q}.n"))
    bits, before_left = sketch.select("sid", "bits"), None
    for i in range(ROUNDS):
        begin, before = C.mark(), cur
        per = cur.groupBy("token", "label").agg(F.count("*").alias("k"), F.count_if(early).alias("e"))
        size = per.groupBy("token").agg(F.sum("k").alias("s"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("e").alias("e"))
        size = size.where("pairs > 0").select("token", "s", F.least("pairs", F.col("e") * F.col("s")).alias("pairs"))
        size = C.materialize(size.withColumn("dense", F.col("pairs") > DENSE * F.col("s")), "near-size")
        left = size.where("dense").agg(F.sum("pairs")).first()[0]
        # a round that has left nearly all pairs would not be followed by better ones
        last = left is None or left <= most or i == ROUNDS - 1 or before_left is not None and 10 * left > 9 * before_left
        before_left = left
        cur = C.materialize(cur.join(size.select("token", "dense"), "token"), "near-open")
        if cur.isEmpty():
            break
        on = (F.col("p.token") == F.col("q.token")) & (F.col("p.label") != F.col("q.label")) & fits("p", "q")
        both = F.least("p.sid", "q.sid").alias("a"), F.greatest("p.sid", "q.sid").alias("b")
        light = cur.where("not dense")
        pairs = _possible(light.where(early).alias("p").join(light.alias("q"), on).select(*both).distinct(), sketch)
        if left is not None and not last:
            heavy = C.materialize(cur.where("dense").drop("dense").join(bits, "sid"), "near-heavy")
            rank = F.struct((~early).alias("late"), F.xxhash64("sid", F.lit(i)).alias("r"), "sid", "n", "at", "label")
            hub = cur.where("dense").groupBy("token").agg(F.min(rank).alias("h")).select("token", "h.sid", "h.n", "h.at", "h.label")
            first = C.materialize(hub.join(bits, "sid"), "near-hub")
            pairs = pairs.unionByName(_possible(first.alias("p").join(heavy.alias("q"), on & _can_be("p", "q")).select(*both).distinct(), sketch, False))
        pairs = C.materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        found = C.materialize(verified(pairs, table, docs, words), "near-found")
        tested, edges = tested.unionByName(pairs), edges.unionByName(found)
        if not found.isEmpty():
            comp = C.components(edges, "near")
        cur = C.materialize(_labelled(cur.where("dense").select("token", "sid", "n", "at"), comp), "near-next")
        C.sweep(begin, pairs, found, cur, *([] if comp is None else [comp]))
        C.drop(before.sparkSession, before._scratch)
        if last:
            break
    for most in MOST:  # what is left: all pairs, by bitmaps, a few of a set at once
        if cur.isEmpty():
            break
        begin, before = C.mark(), cur
        out = C.materialize(dense_pairs(cur, bits, most), "near-dense")
        pairs = _possible(out.where("token is null").select("a", "b").distinct(), sketch, False)
        pairs = C.materialize(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        found = C.materialize(verified(pairs, table, docs, words), "near-found")
        tested, edges = tested.unionByName(pairs), edges.unionByName(found)
        if not found.isEmpty():
            comp = C.components(edges, "near")
        again = out.where("token is not null").select("token").distinct()
        cur = C.materialize(_labelled(cur.join(again, "token").select("token", "sid", "n", "at"), comp), "near-next")
        C.sweep(begin, pairs, found, cur, *([] if comp is None else [comp]))
        C.drop(before.sparkSession, before._scratch)
    return comp


def dense_pairs(cur: DataFrame, bits: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of sets of `cur(token, sid, n, at, label)` that share a shingle, have different labels and can be
    similar by their bitmaps, with `token` null; a row with `token` for each shingle of which not all such pairs are
    given out, since a set has more than `most` of them. A pair that shares several shingles is given out for the least
    of those that it counts by. Rows of a shingle are dealt in blocks, and each two blocks are a group."""
    ddl = "a long, b long, token int"
    schema = C.arrow_schema(ddl)

    def run(table):
        c = {f: table.column(f).to_numpy() for f in ("sid", "n", "at", "label", "own")}
        by = np.argsort(c["sid"] * np.int64(2 * most + 1), kind="stable")  # another order each round
        sid, n, at, label, own = (c[f][by].astype(np.int64) for f in ("sid", "n", "at", "label", "own"))
        rows = table.take(pa.array(by))
        map_of = lambda f: rows.column(f).combine_chunks()
        b = map_of("bits").flatten().to_numpy().view(np.uint64).reshape(len(sid), BITMAP)
        ones = np.bitwise_count(b).sum(1, dtype=np.int64)
        token, cross = rows.column("token")[0].as_py(), rows.column("p")[0].as_py() != rows.column("q")[0].as_py()
        tokens, ats = map_of("tokens"), map_of("ats")
        owner = np.repeat(np.arange(len(sid)), np.diff(tokens.offsets.to_numpy()))
        tokens, ats = tokens.flatten().to_numpy(), ats.flatten().to_numpy().astype(np.int64)
        less = np.flatnonzero(tokens < token)
        less = less[np.argsort(tokens[less], kind="stable")]
        others = np.split(less, np.flatnonzero(np.diff(tokens[less])) + 1) if len(less) else []

        def counts_by(i, j, x, y):  # whether pairs (i, j) count by a shingle at x and y
            return ((9 * x <= n[i]) | (9 * y <= n[j])) & (9 * np.minimum(n[i] - x, n[j] - y) >= 4 * (n[i] + n[j]))

        found, cut, step = [], False, max(1, PAIRS // len(sid))
        for k in range(0, len(sid), step):
            i = np.arange(k, min(k + step, len(sid)))[:, None]
            j = np.arange(k, len(sid))[None, :]
            ok = (i < j) & (label[i] != label[j]) & counts_by(i, j, at[i], at[j])
            i, j = np.nonzero(ok & (own[i] != own[j]) if cross else ok)
            i, j = i + k, j + k
            both = np.zeros(len(i), np.int64)
            for w in range(BITMAP):
                both += np.bitwise_count(b[i, w] & b[j, w])
            enough = 4 * (n[i] + n[j])
            ok = (9 * (n[i] - ones[i] + both) >= enough) & (9 * (n[j] - ones[j] + both) >= enough)
            i, j = i[ok], j[ok]
            for o in others:
                if not len(i):
                    break
                where = np.full(len(sid), -1)
                where[owner[o]] = ats[o]
                x, y = where[i], where[j]
                ok = (x < 0) | (y < 0) | ~counts_by(i, j, x, y)
                i, j = i[ok], j[ok]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            cut |= bool((nth >= most).any())
            found.append(np.stack([sid[i], sid[j]], 1)[nth < most])
        f = np.sort(np.concatenate(found), axis=1)
        of = [None] * len(f) + [token] * cut
        f = np.concatenate([f, np.zeros((int(cut), 2), np.int64)])
        return pa.table([pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(of, pa.int32())], schema=schema)

    blocks = cur.groupBy("token").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    all_of = cur.groupBy("sid").agg(F.collect_list(F.struct("token", "at")).alias("s")).select("sid", F.col("s.token").alias("tokens"), F.col("s.at").alias("ats"))
    rows = cur.join(blocks, "token").join(all_of, "sid").join(bits, "sid").withColumn("own", F.pmod(F.xxhash64("sid"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("blocks", "other")
    return rows.groupBy("token", "p", "q").applyInArrow(run, ddl)


def _possible(pairs: DataFrame, sketch: DataFrame, narrow: bool = True) -> DataFrame:
    """Those of `pairs(a, b)` that can be similar by their bitmaps; `narrow`: by the narrow ones too."""
    own = pairs.alias("o").join(sketch.alias("p"), F.col("o.a") == F.col("p.sid")).join(sketch.alias("q"), F.col("o.b") == F.col("q.sid"))
    x, y = _folded("p.wide", "q.wide"), _folded("q.wide", "p.wide")
    only = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, k: s + k)
    wide = F.col("p.wide").isNull() | F.col("q.wide").isNull() | _enough("p", "q", only(x, y), only(y, x))
    return (own.where(_can_be("p", "q")) if narrow else own).where(wide).select("a", "b")


def _folded(x: str, y: str):
    """The bitmap `x` at half its width if `y` is narrower. Similar sets have widths that differ by a factor of two at most."""
    n = F.size(y)
    return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseOR(b))).otherwise(F.col(x))


def _can_be(p: str, q: str):
    """Whether two sets can be similar by their bitmaps."""
    only = lambda x, y: sum(F.bit_count(F.col(f"{x}.bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}.bits")[i]))) for i in range(BITMAP))
    return _enough(p, q, only(p, q), only(q, p))


def _enough(p: str, q: str, only_p, only_q):
    """What one set has and the other lacks is at least so many: whether that leaves enough in common."""
    enough = 4 * (F.col(f"{p}.n") + F.col(f"{q}.n"))
    return (9 * (F.col(f"{p}.n") - only_p) >= enough) & (9 * (F.col(f"{q}.n") - only_q) >= enough)


def _labelled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("label", F.col("sid"))
    return rows.join(comp, rows.sid == comp.node, "left").select("token", "sid", "n", "at", F.coalesce("label", "sid").alias("label"))


def keep_one(docs: DataFrame, words: int = WORDS, sample: int = SAMPLE, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id stays (a null id, if the
    component has no other)."""
    digest, key = C.free(docs, "_digest", "_key")
    begin = C.mark()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = C.materialize(prefixes(own, words, sample), "near-prefix")
    comp = links(table, own, words, threshold)
    rows = table.select("doc_id", "digest", "sid")
    if comp is not None:
        rows = rows.join(comp, rows.sid == comp.node, "left").select("doc_id", "digest", F.coalesce("label", "sid").alias("sid"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("k")
    kept = rows.groupBy("sid").agg(best).select(F.col("k.doc_id").alias("j"), F.col("k.digest").alias("e"), F.lit(True).alias("kept"))
    here = table.groupBy(F.col("doc_id").alias("i"), F.col("digest").alias("d")).agg(F.count("*").alias("n"))
    here = here.join(kept, F.col("i").eqNullSafe(F.col("j")) & F.col("d").eqNullSafe(F.col("e")), "left").withColumn("key", F.xxhash64("i", "d"))
    here = C.materialize(here.where("kept is null or n > 1").select("i", "d", "kept", "key"), "near-rows")
    C.sweep(begin, here)
    marked = docs.withColumn(digest, F.xxhash64("text")).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), digest))
    return C.stay(marked, key, here.where("kept is null"), here.where("kept"), digest).drop(digest, key)
