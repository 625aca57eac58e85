"""Shared pieces: scratch tables in the cluster's shared folder, tree sums, distributed prefix sums.

Nothing here depends on a machine's own disk on a cluster: what is kept between jobs is a Parquet table
below `spark.checkpoint.dir`, so a lost executor loses no state.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows turned into Python objects at once; Arrow batches are cut to this, so memory follows the rows' size only.
SLICE = 256

_local: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, and only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="logloom-"))
    return f"file://{_local[0]}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@atexit.register
def release() -> None:
    """Remove the scratch tables of this process. Results read from them are invalid afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            pass


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    _remove(spark, path)
    _written[:] = [x for x in _written if x[1] != path]


#: Shuffle files of a table go once it is written; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, tag: str, codec: str = "zstd") -> str:
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, tag)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return path


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, and the rows are computed once."""
    path = store(df, tag, codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def mark() -> int:
    """Where `sweep` begins: behind the tables written so far."""
    return len(_written)


def sweep(since: int, *keep: DataFrame) -> None:
    """Remove the tables written since `mark`, but for those of `keep` (results of `materialize`)."""
    stay = {getattr(df, "_scratch", None) for df in keep}
    for spark, path in _written[since:]:
        if path not in stay:
            drop(spark, path)


#: The most rows of 4 KiB of a `sieve`'s bitmap.
SIEVE = 1024


def sieve(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose `key` is in the table `keys(key)`, and a few others: by a bitmap of 16 bits for each of its rows
    (4 MiB at most, so with very many of them more others stay). It is broadcast, and `rows` are not moved."""
    return apart(rows, key, keys)[0]


def apart(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `sieve` gives, and the rest of the rows, no key of which is in the table."""
    at, slot, bits = free(rows, "_at", "_slot", "_bits")
    n = 32768 * min(-(-16 * keys.count() // 32768) or 1, SIEVE)
    position = (F.pmod(F.xxhash64(key), F.lit(n)) + 1).alias(at)
    bits_of = keys.select(position).groupBy(F.bitmap_bucket_number(at).alias(slot)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    bit = F.expr(f"getbit(cast(conv(hex(substring({bits}, cast(bitmap_bit_position({at}) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position({at}) % 8 as int))")
    own = rows.withColumn(at, position).join(F.broadcast(materialize(bits_of, "sieve")), F.bitmap_bucket_number(at) == F.col(slot), "left")
    there = F.coalesce(bit, F.lit(0)) == 1
    return own.where(there).select(*rows.columns), own.where(~there).select(*rows.columns)


def stay(docs: DataFrame, key: str, gone: DataFrame, repeated: DataFrame, digest: str) -> DataFrame:
    """`docs` without the rows of `gone(i, d)`, and one row of each of `repeated(i, d)`: id, null like null, and digest.

    `docs` has the `digest` and a `key` that follows from id and digest or id alone; both tables have the key too. Only
    rows whose key a bitmap of theirs has are moved, the others stay where they are."""
    i, d = free(docs, "_i", "_d")
    moved, out = apart(docs, key, gone.unionByName(repeated).select(F.col("key").alias(key)).distinct())
    named = lambda t: t.select(F.col("i").alias(i), F.col("d").alias(d))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(digest) == F.col(d))
    out = out.unionByName(moved.join(named(gone.unionByName(repeated)), same, "left_anti"))
    if not repeated.isEmpty():
        more = moved.join(named(repeated), same, "left_semi").withColumn(i, F.col("doc_id").cast("long"))
        out = out.unionByName(more.dropDuplicates([i, digest]).drop(i))
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of `df` (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def batches_of(it, rows: int = SLICE):
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: Texts worked on together, and their bytes: the more, the fewer times a word is looked up.
ROWS, BATCH_BYTES = 2048, 16 << 20


def batches_of_text(it, column: int):
    """Arrow batches cut to ROWS rows and BATCH_BYTES of the text column, or to one row."""
    for b in it:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(sizes[at - 1]) if at else 0
            n = max(int(np.searchsorted(sizes[at : at + ROWS], before + BATCH_BYTES, side="right")), 1)
            yield b.slice(at, n)
            at += n


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def fold_of(doc_id, k: int):
    """crc32 of the id as text, mod k; null ids belong to no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


#: Vectors that a task, or at the end the driver, adds up.
FAN_IN = 32
_SUMS = "pid int, blob binary"


def partial_sums(df: DataFrame, fn, width: int, fan_in: int = FAN_IN) -> np.ndarray:
    """Sum over partitions of `fn(batches) -> float64[width]`, in a fixed order.

    Each partition gives one vector; they are added `fan_in` at a time, in rounds, until the driver adds the last
    `fan_in`. So no task and no driver holds more than fan_in * width * 8 bytes, whatever the number of partitions.
    """
    schema, spark = arrow_schema(_SUMS), df.sparkSession

    def run(it):
        from pyspark import TaskContext

        blob = np.ascontiguousarray(fn(it), dtype=np.float64).tobytes()
        yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "blob": [blob]}, schema=schema)

    def added(pids, blobs):
        total = np.zeros(width)
        for _, b in sorted(zip(pids, blobs, strict=True)):
            total += np.frombuffer(bytes(b))
        return total

    def merge(table):
        pids = table.column("pid").to_pylist()
        return pa.table({"pid": [pids[0] // fan_in], "blob": [added(pids, table.column("blob").to_pylist()).tobytes()]}, schema=schema)

    at = store(df.mapInArrow(run, _SUMS), "sums")
    left = (spark.read.schema(_SUMS).parquet(at).agg(F.max("pid")).first()[0] or 0) + 1
    while left > fan_in:
        left, before = -(-left // fan_in), at
        at = store(spark.read.schema(_SUMS).parquet(before).groupBy(F.expr(f"pid div {fan_in}")).applyInArrow(merge, _SUMS), "sums")
        drop(spark, before)
    rows = spark.read.schema(_SUMS).parquet(at).collect()
    drop(spark, at)
    return added([r.pid for r in rows], [r.blob for r in rows])


def ordered_prefix(df: DataFrame, order: list, value: str, tag: str, before: str = "before", position: str = "position") -> DataFrame:
    return ordered_prefix_at(df, order, value, tag, before, position)[0]


def ordered_prefix_at(df: DataFrame, order: list, value: str, tag: str, before: str = "before", position: str = "position") -> tuple[DataFrame, str]:
    """`df` with `before`: the sum of `value` over all rows earlier in `order`, and `position`: their number.

    One range shuffle, a running sum in each partition, and one offset for each partition added afterwards; the
    driver sees one row for each partition. Also returns where the table lies that it reads. Nulls in `value` count 0. Rows equal in `order` come in any order.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField(before, T.LongType()), T.StructField(position, T.LongType()), T.StructField("_after", T.LongType())])

    def run(it):
        from pyspark import TaskContext

        pid, total, count = TaskContext.get().partitionId(), 0, 0
        for b in it:
            v = b.column(b.schema.get_field_index(value)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            after = np.cumsum(v, dtype=np.int64) + total
            pos = np.arange(count, count + len(v), dtype=np.int64)
            if len(v):
                total, count = int(after[-1]), count + len(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(after - v), pa.array(pos), pa.array(after)], names=[*b.schema.names, "_pid", before, position, "_after"])

    at = store(ranged.mapInArrow(run, schema), tag)
    t = spark.read.schema(schema).parquet(at)
    rows, sums, s, c = [], t.groupBy("_pid").agg(F.max("_after").alias("s"), F.count("*").alias("c")).collect(), 0, 0
    for r in sorted(sums):
        rows.append((r[0], s, c))
        s, c = s + r.s, c + r.c
    offsets = spark.createDataFrame(rows, "_pid int, _s long, _c long")  # one row for each partition
    out = t.join(F.broadcast(offsets), "_pid").withColumns({before: F.col(before) + F.col("_s"), position: F.col(position) + F.col("_c")})
    return out.drop("_pid", "_s", "_c", "_after"), at


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of `edges(a long, b long)`: rows (node, label), one for each node that has an edge.

    Contraction in rounds: each node points to the least of its neighbours and itself, pointers are doubled once,
    and edges are mapped to what their ends point to; edges shrink by a factor each round since ids are put into a
    pseudo-random order first. Every round's tables are written to the shared folder. `label` is one node of the
    component, the same for all its nodes. No node's neighbours are ever gathered: minima are pre-aggregated, and
    the joins take plain tables on both sides, so that skewed partitions can be split.
    """
    spark, begin = edges.sparkSession, mark()
    code = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
    cur = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    maps = []
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(F.xxhash64("v")).alias("h"))
        near = both.select("u", "v", F.xxhash64("v").alias("h")).groupBy("u", "h").agg(F.min("v").alias("v"))
        p = materialize(
            near.join(least, ["u", "h"]).select("u", F.when(code(F.col("v")) < code(F.col("u")), F.col("v")).otherwise(F.col("u")).alias("p")), f"{tag}-point"
        )
        q = p.select(F.col("u").alias("m"), F.col("p").alias("pp"))
        p2 = materialize(p.join(q, p.p == q.m).select("u", F.col("pp").alias("p")), f"{tag}-jump")
        maps.append(p2)
        pa_, pb_ = p2.select(F.col("u").alias("a"), F.col("p").alias("x")), p2.select(F.col("u").alias("b"), F.col("p").alias("y"))
        half = materialize(cur.join(pa_, "a").select("x", "b"), f"{tag}-half")
        nxt = half.join(pb_, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        cur = materialize(nxt, f"{tag}-edges")
    if not maps:
        return spark.createDataFrame([], "node long, label long")
    last = maps[-1]
    out = last.select(F.col("u").alias("node"), F.col("p").alias("label"))
    for m in reversed(maps[:-1]):  # nodes gone by then keep what they pointed to
        later = out.select(F.col("node").alias("p"), "label")
        last = out = materialize(m.join(later, "p", "left").select(F.col("u").alias("node"), F.coalesce("label", "p").alias("label")), f"{tag}-label")
    sweep(begin, last)
    out._scratch = last._scratch
    return out
