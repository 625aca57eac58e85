"""Exact dedup as a log-structured merge index of digests, in DataFrame operations only.

A memtable is a part of the documents; its flush writes a run: (digest, doc_id), sorted by digest in each file, with
a Parquet Bloom filter on the digest. Compaction merges FANOUT runs at a time, level by level, into runs of one row
for each digest: the identifier that is kept and the number of rows. Digests with several rows are hits: their
documents are found again through a bitmap filter over document ids (where there are few enough of them for it to tell
ids apart) and a semi-join on the digest, and verified by their bytes: they are grouped by digest and text, so that
equal digests of different texts would be told apart. `find` looks single texts up in the merged run, whose Bloom
filters tell in which row groups a digest can be.

Groups are pre-aggregated wherever rows are grouped, so a group of any size costs one row from each task.

Cases: null counts as empty; texts are compared after lowering A-Z alone; a null doc_id is less than any other;
repeated rows come out each (with the same id they are all kept; `keep_one` leaves one); very long texts are digested
whole; an empty table gives an empty result; other columns, whatever their names, are ignored by `groups` and kept by
`keep_one`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MEMTABLES, FANOUT = 8, 4
#: The filter over ids of hits has 16 bits for each, in rows of 4 KiB; with more rows than this (16 MiB) none is used.
FILTER_BUCKETS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """A-Z lowered and nothing else; lower() does just that to a text of ASCII characters, and faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


class DigestIndex:
    """Runs below `path`: level 0 as flushed, further levels as merged. `keep` is max or min of the identifiers."""

    def __init__(self, spark, path: str, keep: str = "max", digest=sha256, filter_buckets: int = FILTER_BUCKETS):
        self.spark, self.path, self.digest, self.filter_buckets = spark, path, digest, filter_buckets
        self.best = {"max": F.max, "min": F.min}[keep]

    def _write(self, df: DataFrame, to: str, *by: str) -> None:
        w = df.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        (w.partitionBy(*by) if by else w).parquet(f"{self.path}/{to}")

    def flush(self, docs: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
        """Write the runs of level 0 (one pass over the texts); returns them: run, digest, doc_id."""
        rows = docs.select(self.digest(normalized(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), (F.spark_partition_id() % memtables).alias("run"))
        self._write(rows.sortWithinPartitions("run", "digest", "doc_id"), "level=0", "run")
        return self.spark.read.schema("digest string, doc_id long, run int").parquet(f"{self.path}/level=0")

    def compact(self, level0: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
        """Merge runs until one is left; returns it: digest, keep_id, n."""
        runs, level, t = memtables, 0, level0.select("run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        while True:
            runs, level = -(-runs // FANOUT), level + 1
            merged = t.groupBy((F.col("run") / FANOUT).cast("int").alias("run"), "digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            self._write(merged.sortWithinPartitions("run", "digest"), f"level={level}", "run")
            t = self.spark.read.schema("digest string, keep_id long, n long, run int").parquet(f"{self.path}/level={level}")
            if runs == 1:
                return t.drop("run")

    def verify(self, docs: DataFrame, level0: DataFrame, merged: DataFrame) -> DataFrame:
        """Of hits: digest, norm (the bytes), keep_id, n. One row for each digest unless digests collide."""
        hits = merged.where("n > 1").select(F.col("digest").alias("d"))
        found = merged.where("n > 1").agg(F.sum("n")).first()[0] or 0
        buckets = -(-16 * found // 32768) or 1
        position = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets * 32768)) + 1
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if buckets <= self.filter_buckets:
            ids = level0.join(hits, level0.digest == hits.d, "left_semi").select(position(F.col("doc_id")).alias("p"))
            bitmap = C.materialize(ids.groupBy(F.bitmap_bucket_number("p").alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")), "exact-filter")
            bit = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(p) % 8 as int)) & 1")
            own = own.withColumn("p", position(F.col("doc_id"))).join(F.broadcast(bitmap), F.bitmap_bucket_number("p") == F.col("slot")).where(bit == 1)
        rows = own.select("doc_id", normalized(F.col("text")).alias("norm")).select(self.digest(F.col("norm")).alias("digest"), "norm", "doc_id")
        same = rows.groupBy("digest", "norm").agg(self.best("doc_id").alias("keep_id"), F.count("*").alias("n"))
        if buckets > self.filter_buckets:  # most rows can be no hits: they go before they are grouped
            rows = rows.join(hits, rows.digest == hits.d, "left_semi")
            return rows.groupBy("digest", "norm").agg(self.best("doc_id").alias("keep_id"), F.count("*").alias("n"))
        return same.join(hits, same.digest == hits.d, "left_semi")

    def find(self, merged: DataFrame, texts: list[str]) -> DataFrame:
        """Rows of the merged run for a few texts: digest, keep_id, n."""
        wanted = [r[0] for r in self.spark.createDataFrame([(t,) for t in texts], "text string").select(self.digest(normalized(F.col("text")))).collect()]
        return merged.where(reduce(or_, [F.col("digest") == d for d in wanted], F.lit(False)))


def groups(docs: DataFrame, keep: str = "max", digest=sha256, memtables: int = MEMTABLES, filter_buckets: int = FILTER_BUCKETS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of `docs(doc_id, text)`."""
    spark = docs.sparkSession
    index = DigestIndex(spark, C.scratch_path(spark, "exact-index"), keep, digest, filter_buckets)
    level0 = index.flush(docs, memtables)
    merged = index.compact(level0, memtables)
    checked = C.materialize(index.verify(docs, level0, merged).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("n")), "exact-checked")
    collided = checked.where("texts > 1").select(F.col("digest").alias("c"))
    m = merged.select(F.col("digest").alias("d"), "keep_id", "n")
    plain = level0.join(m, level0.digest == m.d)
    out = plain.select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest")
    if not collided.isEmpty():  # groups of these digests come from the bytes
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
        rows = ids.join(collided, ids.digest == collided.c, "left_semi")
        best = {"max": F.max, "min": F.min}[keep]
        per = C.materialize(rows.groupBy(F.col("digest").alias("d"), F.col("norm").alias("m")).agg(best("doc_id").alias("keep_id"), F.count("*").alias("n")), "exact-collided")
        apart = rows.join(per, (rows.digest == per.d) & (rows.norm == per.m)).select("doc_id", "keep_id", F.col("n").alias("group_size"), sha256(F.col("norm")).alias("digest"))
        out = out.join(collided, out.digest == collided.c, "left_anti").unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents that stay, with their columns: one row of each text, also where id and text are repeated."""
    sha, key = C.free(docs, "_sha", "_key")
    begin = C.mark()
    rows = groups(docs, keep).groupBy(F.col("doc_id").alias("i"), F.col("text_sha256").alias("d"), "kept")
    rows = rows.agg(F.count("*").alias("n")).where("not kept or n > 1").withColumn("key", F.xxhash64("i"))
    rows = C.materialize(rows, "exact-rows")
    C.sweep(begin, rows)
    own = docs.withColumn(sha, sha256(normalized(F.col("text")))).withColumn(key, F.xxhash64(F.col("doc_id").cast("long")))
    return C.stay(own, key, rows.where("not kept"), rows.where("kept"), sha).drop(sha, key)
