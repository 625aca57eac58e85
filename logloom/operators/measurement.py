"""Counters, gauges, histograms, latency reports and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.codec import clamp_us

#: Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def rollup(metrics: DataFrame) -> DataFrame:
    """`metrics(seq, kind, name, value)`: counters and up-down counters sum, gauges keep the last, high-water the most."""
    g = metrics.groupBy("kind", "name").agg(F.sum("value").alias("s"), F.max_by("value", "seq").alias("l"), F.max("value").alias("m"))
    return g.select("kind", "name", F.when(F.col("kind").isin("counter", "updown"), F.col("s")).when(F.col("kind") == "gauge", F.col("l")).otherwise(F.col("m")).alias("value"))


def histogram(values: DataFrame, name: str, bounds: list[int]) -> DataFrame:
    """Rows in each interval up to a bound; the last interval is open (bucket = number of bounds below the value)."""
    bucket = sum((F.col("v") > b).cast("long") for b in bounds)
    return values.groupBy(name, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def latency_report(values: DataFrame, by: str) -> DataFrame:
    """`values(by, us)`: discrete percentiles of clamped microseconds. One shuffle of counts, not of values: equal
    values are counted first."""
    c = values.groupBy(by, clamp_us(F.col("us")).alias("us")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    t = c.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    rank = {q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("us"))).alias(q) for q, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))}
    return t.groupBy(by).agg(*rank.values(), F.max("us").alias("max"), F.round(F.sum(F.col("us") * F.col("n")) / F.sum("n"), 6).alias("mean"))


def hdr_highest(us, digits_bits: int = 11):
    """The highest value that shares a bucket of a 3-digit histogram: exact below 2048, then 1024 buckets a doubling."""
    width = F.pow(F.lit(2), F.greatest(F.floor(F.log2(us)) - (digits_bits - 1), F.lit(0))).cast("long")
    return F.floor(us / width).cast("long") * width + width - 1


def append_report(records: DataFrame, resolved: DataFrame, seconds: int) -> DataFrame:
    a = records.agg(F.count("*").alias("n"), F.sum("encoded_len").alias("attempted"))
    b = resolved.agg(F.sum("committed").alias("committed"), F.sum("committed_bytes").alias("bytes"))
    return a.crossJoin(b).select(
        "committed", (F.col("committed") / seconds).alias("iops"), F.coalesce(F.round(F.try_divide(F.col("attempted").cast("double"), F.col("bytes")), 9), F.lit(0.0)).alias("write_amplification")
    )  # one row on each side


def open_loop(completions: DataFrame, rate: int) -> DataFrame:
    """`completions(i, done_us)`: sends are due at i / rate; latency counts from the due time."""
    due = F.floor(F.col("i") * 1_000_000 / rate).cast("long")
    return completions.select("i", due.alias("send_us"), (F.col("done_us") - due).alias("latency_us"))


def suite_matrix(spark) -> DataFrame:
    """The benchmark suite's configurations: append shapes by backend, recovery by replay size and by segments."""
    shapes = spark.createDataFrame([("qd1",), ("rate10",), ("loaded",), ("tput",)], "shape string")
    back = spark.createDataFrame([("log",), ("disk0",), ("disk1",), ("disk2",)], "backend string")
    a = shapes.crossJoin(back).selectExpr("'append' AS bench", "backend || '/' || shape AS config", "CAST(4096 AS bigint) AS arg")
    r = spark.createDataFrame([(n,) for n in (0, 1000, 10000, 100000)], "n long").selectExpr("'recovery_replay'", "'log/replay'", "n")
    s = spark.createDataFrame([(n,) for n in (0, 1, 4, 16, 64)], "n long").selectExpr("'recovery_segments'", "'log/segments'", "n")
    return a.union(r).union(s)


PHASES = 16


def phase_deck(spark, seeds: int) -> DataFrame:
    """An order of the phases for each seed: as they are for seed 0, by a hash otherwise."""
    d = spark.range(seeds).withColumnRenamed("id", "seed").withColumn("phase", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PHASES - 1).cast("long"))))
    key = F.when(F.col("seed") == 0, F.lpad(F.col("phase").cast("string"), 2, "0")).otherwise(F.sha2(F.concat_ws("|", "seed", "phase").cast("binary"), 256))
    return d.select("seed", "phase", (F.row_number().over(Window.partitionBy("seed").orderBy(key)) - 1).cast("long").alias("pos"))


def fault_budget(spark, seeds: int, faults: int = 8) -> DataFrame:
    """Opportunities at which a seed's faults fall: each one or two after the one before, by a hash."""
    d = spark.range(seeds).withColumnRenamed("id", "seed").withColumn("fault", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(faults - 1).cast("long"))))
    step = F.when(F.substring(F.sha2(F.concat_ws("|", "seed", "fault").cast("binary"), 256), 1, 1) < "8", 1).otherwise(2).cast("long")
    return d.select("seed", "fault", F.sum(step).over(Window.partitionBy("seed").orderBy("fault").rowsBetween(Window.unboundedPreceding, 0)).alias("opportunity"))


def receipt_matches(receipts: DataFrame, digest: str) -> DataFrame:
    """Receipts of a passed production run of an hour or more, asked for and elapsed, over these sources."""
    r = F.col("passed") & (F.col("requested_s") >= 3600) & (F.col("elapsed_ms") >= 3_600_000) & (F.col("digest") == digest) & (F.col("mode") == "production")
    return receipts.select("seg", F.coalesce(r, F.lit(False)).alias("matches"))


def operation_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(F.count("*").alias("calls"), F.count_if("faulted").alias("faults"))


def recorded(metrics: DataFrame) -> DataFrame:
    """What a benchmark's recorder keeps: counters and gauges by name, whatever their labels; nothing else."""
    return rollup(metrics.where(F.col("kind").isin("counter", "gauge")).select("seq", "kind", "name", "value"))


def recovery_report(marks: DataFrame, counter: DataFrame) -> DataFrame:
    """Percentiles of each phase over iterations, from the marks at which phases begin, `marks(iteration, i, phase,
    at_us)`, and of the whole; the mean growth of a counter, `counter(iteration, seq, value)`, over an iteration."""
    w = Window.partitionBy("iteration").orderBy("i")
    phases = marks.withColumn("us", F.lead("at_us").over(w) - F.col("at_us")).where("us IS NOT NULL").select("iteration", "phase", "us")
    total = marks.groupBy("iteration").agg((F.max("at_us") - F.min("at_us")).alias("us")).select("iteration", F.lit("total").alias("phase"), "us")
    grown = counter.groupBy("iteration").agg((F.max_by("value", "seq") - F.min_by("value", "seq")).alias("reads"))
    both = phases.unionByName(total)
    reads = both.join(grown, "iteration").groupBy("phase").agg(F.round(F.avg("reads"), 6).alias("reads"))
    return latency_report(both, "phase").select("phase", "p50", "p99", "max").join(reads, "phase")


def disk_report(appends: DataFrame) -> DataFrame:
    """Appends to local disks, each with one logical fsync."""
    sums = appends.groupBy("disk").agg(F.count("*").alias("appends"), F.count("*").alias("fsyncs"), F.sum("bytes").alias("bytes"))
    return sums.join(latency_report(appends, "disk").select("disk", "p99"), "disk")
