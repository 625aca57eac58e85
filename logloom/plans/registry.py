"""Queries by name over the tables derived from `events`, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import codec
from logloom.operators import catalog as cat
from logloom.operators import conformance, measurement, quorum, writepath
from logloom.plans import lifecycle
from logloom.plans.oracle import ORACLE  # noqa: F401
from logloom.sources import traces
from logloom.sources.simulated import PER_SEGMENT, QUORUM, ZONES, LogTables, segment_ends
from logloom.streaming import commit

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(LogTables(spark, sf_dir))
    return f


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["replay_range"](spark, sf_dir)


def _ends(t):
    return segment_ends(t.records())


def _resolved(t):
    return quorum.commit_resolution(_ends(t), t.lanes(), QUORUM)


def _tail(t) -> int:
    last = t.records().agg(F.max("record_index")).first()[0]
    return 0 if last is None else last + 1


def _sizes(t):
    """seg, zone, size of observed copies in bytes; a missing one is 0."""
    held = t.frames().groupBy("seg", "zone").agg(F.max("record_end").alias("size"))
    return t.copies().select("seg", "zone").join(held, ["seg", "zone"], "left").select("seg", "zone", F.coalesce("size", F.lit(0)).alias("size"))


@query
def frame_encode(t):
    return t.records().select("record_index", "encoded_len", F.lower(F.hex(codec.frame(F.col("payload")))).alias("frame_hex"))


@query
def segment_boundaries(t):
    return _ends(t).select("seg", "record_index", "record_end")


@query
def chain_ends(t):
    return cat.chain(t.catalog(), _tail(t)).select("seg", "base", "end")


@query
def directory_encode(t):
    return cat.encode_directory(t.catalog().withColumn("dir", F.expr("seg div 50")), "dir")


@query
def directory_decode(t):
    return cat.decode_directory(directory_encode(t), "dir")


@query
def segment_id_codec(t):
    ids = t.segments().select("seg", F.when(F.col("seg") % 13 == 0, F.concat(F.lit("short-"), F.col("seg"))).otherwise(codec.segment_id(F.expr("seg div 7"), F.col("seg"))).alias("id"))
    return ids.select("id", codec.id_epoch(F.col("id")).alias("epoch"))


@query
def quorum_watermark(t):
    return quorum.watermark(t.lanes(), QUORUM)


@query
def commit_resolution(t):
    return _resolved(t)


@query
def streaming_commit(t):
    return commit.resolve(t.spark, t.progress(), _ends(t), t.lanes().select("seg", "zone"), QUORUM)


@query
def commit_feasibility(t):
    return quorum.feasibility(_ends(t), t.lanes(), QUORUM)


@query
def durable_lag(t):
    return quorum.durable_lag(t.lanes())


@query
def lane_progress_merge(t):
    return quorum.merged_progress(t.progress())


@query
def ack_through(t):
    return quorum.acked(_ends(t), t.lanes())


@query
def resend_suffix(t):
    return quorum.resend(_ends(t), t.lanes().withColumn("durable", F.greatest(F.col("durable") - 3, F.lit(0))))


@query
def recovery_size(t):
    return quorum.recovery_size(_sizes(t), ZONES)


@query
def candidate_class(t):
    return quorum.candidate_class(t.copies(), _sizes(t), ZONES)


@query
def canonical_prefix(t):
    return quorum.canonical_prefix(t.frames(), t.copies(), _sizes(t), ZONES)


@query
def exact_finalized_group(t):
    return quorum.exact_finalized_group(t.frames(), t.copies(), QUORUM, t.segments().selectExpr("seg", "CASE WHEN seg % 2 = 0 THEN n END AS expected"))


@query
def stat_quorum(t):
    return quorum.stat_quorum(t.copies(), QUORUM)


@query
def sealed_read_choice(t):
    return quorum.sealed_read_choice(t.copies(), t.frames(), _sizes(t), ZONES)


@query
def quorum_formed(t):
    return quorum.quorum_formed(t.frames(), QUORUM)


@query
def segment_sha256(t):
    return quorum.copy_digests(t.frames()).select("seg", "zone", "digest")


@query
def segment_crc32c(t):
    return t.records().select("record_index", codec.crc32c(codec.frame(F.col("payload"))).alias("crc"))


@query
def record_value(t):
    return t.records().select("record_index", codec.record_value(codec.frame(F.col("payload"))).alias("value"))


@query
def register_validate(t):
    return cat.validate_registers(t.spark.sql(lifecycle.REGISTERS.format(longs="ARRAY<BIGINT>", no_ids="CAST(array() AS ARRAY<STRING>)", no_bases="CAST(array() AS ARRAY<BIGINT>)", segments="{segments}"), segments=t.segments()))


@query
def register_fold(t):
    return cat.fold_register(t.spark.sql(lifecycle.OPERATIONS, records=t.records()), room=8)


@query
def replay_range(t):
    end = _tail(t)
    return cat.replay(t.records(), cat.chain(t.catalog(), end), end // 3, end - 7)


@query
def replay_dense_check(t):
    end = _tail(t)
    return cat.replay_check(t.records(), end // 3, end + 5)


@query
def checkpoint_guards(t):
    c = t.segments().select(F.col("base").alias("checkpoint"))
    return cat.checkpoint_guards(c, 450, 320, 800)


@query
def tombstones(t):
    return cat.chain(t.catalog(), _tail(t)).where("end < 320").select("seg")


@query
def repair_plan(t):
    return cat.repair_plan(cat.chain(t.catalog(), _tail(t)), t.copies(), 320, ZONES)


@query
def repair_report(t):
    return repair_plan(t).groupBy("action").agg(F.count("*").alias("copies"))


@query
def truncate_plan(t):
    return cat.truncate_plan(cat.chain(t.catalog(), _tail(t)), t.copies(), 720, ZONES)


@query
def dead_sweep(t):
    ids = t.catalog().select("seg", "id")
    listed = t.copies().where("observation <> 'missing'").select("seg", "format_ok").join(ids, "seg")
    return cat.dead_sweep(listed, ids.where("seg % 4 <> 0"), t._last() // 7)


@query
def maintenance_coalesce(t):
    c = t.records().selectExpr("seg AS queue", "record_index AS seq", "CASE WHEN ordinal % 17 = 0 THEN 'seal' WHEN ordinal % 3 = 0 THEN 'truncate' ELSE 'repair' END AS kind", "ordinal % 7 AS base", "record_index * 13 % 1009 AS floor")
    return cat.coalesce_commands(c)


@query
def admission_check(t):
    return writepath.admission(t.spark.sql(lifecycle.ATTEMPTS, records=t.records()), 18, 1200)


@query
def in_order_completion(t):
    return writepath.completion(t.records(), _resolved(t), quorum.feasibility(_ends(t), t.lanes(), QUORUM), "seg div 10")


@query
def stall_gaps(t):
    return writepath.stall_gaps(t.progress().where("(seq div 30) % 7 <> 3"), 30)


@query
def rotation_due(t):
    return writepath.rotation_due(_resolved(t), 1500, 3000, 6144)


@query
def greedy_segments(t):
    return writepath.greedy_segments(t.records().withColumn("log", F.expr("seg div 10")), "log", 1000)


@query
def packed_messages(t):
    return writepath.pack_messages(t.records(), 256)


@query
def object_fold(t):
    ops = t.records().selectExpr(
        "seg AS object", "ordinal AS seq", "CASE WHEN ordinal = 0 THEN 'create' WHEN ordinal = 30 THEN 'takeover' WHEN ordinal = 98 THEN 'finalize' ELSE 'append' END AS op",
        "ordinal * 10 AS write_offset", "CAST(10 AS bigint) AS size", "CASE WHEN ordinal < 30 THEN 0 ELSE 1 END AS stream",
    )
    return writepath.fold_objects(ops)


def _trace(t):
    # every assertion reads it, and all group within a trace: it is dealt by trace once and kept, for joins and windows
    # on a trace's keys to take that dealing as it is where the session allows (requireAllClusterKeysForCoPartition)
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return traces.synthetic(t.spark, t.records()).repartition(n, "trace_id")


@query
def trace_structure(t):
    x = _trace(t).where("NOT (trace_id % 10 = 3 AND seq = 17)").withColumn("event", F.expr("CASE WHEN trace_id % 10 = 4 AND seq = 9 THEN 'Nonsense' ELSE event END"))
    return conformance.structure(x)


@query
def trace_field_rules(t):
    x = _trace(t).withColumn("value", F.expr("CASE WHEN trace_id % 10 = 2 AND seq % 50 = 10 THEN NULL ELSE value END"))
    return conformance.field_rules(x)


def _monitor(name, f):
    QUERIES[f"monitor_{name}"] = lambda spark, sf_dir: f(_trace(LogTables(spark, sf_dir)))


for _name, _f in conformance.MONITORS.items():
    _monitor(_name, _f)


@query
def trace_verdict(t):
    return conformance.verdict(_trace(t))


@query
def trace_determinism(t):
    a = _trace(t)
    b = a.withColumn("value", F.expr("CASE WHEN trace_id % 3 = 1 AND seq >= 40 THEN value + 1 ELSE value END"))
    return conformance.first_difference(a, b, ["event", "value", "zone", "logical_offset"])


def _metrics(t):
    return t.records().selectExpr("record_index AS seq", "element_at(array('counter', 'gauge', 'updown', 'high_water'), CAST(seg % 4 AS int) + 1) AS kind", "concat('m', seg % 20) AS name", "(record_index * 37 % 101) - CASE WHEN seg % 4 = 2 THEN 50 ELSE 0 END AS value")


@query
def metric_rollup(t):
    return measurement.rollup(_metrics(t))


@query
def metric_histogram(t):
    v = t.records().selectExpr("seg % 20 AS zone", "record_index * 7919 % 40000 AS v")
    return measurement.histogram(v, "zone", [int(b * 1000) for b in measurement.BOUNDS])


@query
def latency_report(t):
    return measurement.latency_report(t.records().selectExpr("seg % 20 AS run", "record_index * 7919 % 40009 AS us"), "run")


@query
def hdr_buckets(t):
    us = codec.clamp_us(F.expr("record_index * 7919 % 400009"))
    return t.records().select(measurement.hdr_highest(us).alias("highest")).groupBy("highest").agg(F.count("*").alias("n"))


@query
def append_report(t):
    return measurement.append_report(t.records(), _resolved(t), 30)


@query
def open_loop_schedule(t):
    return measurement.open_loop(t.records().selectExpr("record_index AS i", "record_index * 210 + record_index * 31 % 977 AS done_us"), 5000)


@query
def suite_matrix(t):
    return measurement.suite_matrix(t.spark)


@query
def phase_deck(t):
    return measurement.phase_deck(t.spark, 200)


@query
def fault_budget(t):
    return measurement.fault_budget(t.spark, 200)


@query
def generation_ordinal(t):
    """Dense ranks of identifiers by first observation, in a base and overall."""
    o = t.records().selectExpr("seg % 10 AS base", "seg AS id", "record_index AS seq").groupBy("base", "id").agg(F.min("seq").alias("first"))
    from pyspark.sql import Window

    return o.select("base", "id", (F.dense_rank().over(Window.partitionBy("base").orderBy("first")) - 1).cast("long").alias("gen"))


lifecycle.register(query, ORACLE)

assert PER_SEGMENT == 100
