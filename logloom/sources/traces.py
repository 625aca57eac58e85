"""Event traces: the reader's schema and rules, and synthetic traces derived from records (one for each segment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONGS = ("zone logical_offset segment segment_id current_seal_id tail_base seal_base directory_index directory_len gen record_end truncation_floor reader reported_size").split()

#: `value` is an unsigned 64-bit number.
SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("time_ms", T.LongType()), T.StructField("event", T.StringType()), T.StructField("writer", T.LongType()), T.StructField("epoch", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in _LONGS]
    + [T.StructField("value", T.DecimalType(20, 0)), T.StructField("finalized", T.BooleanType())]
)

#: The declared event names, in order.
EVENTS = """SegmentCreateAttempt SegmentCreated SegmentCreateRejected ProducerSpike RecordFormed RecordPersisted CanonicalPersisted
RecordCommitted ProducerAcknowledged RecoveryStarted RecoverySelected RecoveryCompleted DirectoryAdopted SealedCopyRepaired
SegmentFinalized SealQuorumEnforced SegmentSealed RotationGateReleased SegmentOpened TruncationProposed SegmentDeleted
ReplayOpened ReplayRecord ReplayClosed ZoneCrash ZoneRestart DiskCorrupted WriterCrash WriterRestart RpcDropped
RpcUnavailable RpcDeadlineExceeded GetSizeObserved EpochClaimed ViewCommitted FloorCommitted""".split()

#: Names that are accepted and not observed.
IGNORED = "SegmentCreateAttempt SegmentCreateRejected ProducerSpike ZoneCrash ZoneRestart DiskCorrupted WriterCrash WriterRestart RpcDropped RpcUnavailable RpcDeadlineExceeded".split()

#: Fields that an event must have.
REQUIRED = {
    "RecordFormed": "writer logical_offset value segment", "RecordCommitted": "writer logical_offset value segment", "RecoverySelected": "writer logical_offset value segment",
    "RecordPersisted": "zone writer logical_offset value segment", "CanonicalPersisted": "zone writer logical_offset value segment", "ProducerAcknowledged": "writer logical_offset",
    "RecoveryStarted": "writer segment", "RecoveryCompleted": "writer segment logical_offset record_end", "SegmentCreated": "zone writer epoch segment", "SegmentOpened": "segment writer epoch",
    "DirectoryAdopted": "writer segment segment_id directory_index directory_len record_end tail_base truncation_floor", "SegmentFinalized": "zone segment record_end",
    "SealQuorumEnforced": "segment segment_id record_end", "RotationGateReleased": "segment segment_id record_end", "SegmentSealed": "segment record_end", "SealedCopyRepaired": "zone segment record_end",
    "ReplayOpened": "reader logical_offset record_end", "ReplayRecord": "reader logical_offset", "ReplayClosed": "reader", "TruncationProposed": "truncation_floor", "FloorCommitted": "truncation_floor",
    "EpochClaimed": "epoch writer", "ViewCommitted": "epoch logical_offset segment record_end value", "SegmentDeleted": "zone segment record_end truncation_floor", "GetSizeObserved": "zone reported_size finalized",
}


def read(spark: SparkSession, path, pattern: str = "*.jsonl") -> DataFrame:
    """Line-delimited JSON; `trace_id` is the file. Blank lines are skipped, damaged ones stop the job."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(path).withColumn("trace_id", F.col("_metadata.file_path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A list of paths, one a line, relative to the list's folder."""
    names = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    if not names:
        raise ValueError("no traces are listed")
    folder = path.rsplit("/", 1)[0]
    return read(spark, [n if n.startswith("/") or ":" in n else f"{folder}/{n}" for n in names])


def name_parity(listed: DataFrame, declared: list[str]) -> DataFrame:
    """`listed(pos, name)` beside the declared names in their order; a place where they differ, or one lacks, is not same."""
    d = listed.sparkSession.createDataFrame([*enumerate(declared)], "pos long, declared string")
    j = listed.select("pos", F.col("name").alias("listed")).join(d, "pos", "full_outer")
    return j.select("pos", "listed", "declared", F.col("listed").eqNullSafe(F.col("declared")).alias("same"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """pos, name: the lines of a list of event names, blank ones skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")).alias("pos", "name"))
    return lines.select(F.col("pos").cast("long").alias("pos"), "name")


def digests(spark: SparkSession, path, pattern: str = "*.jsonl") -> DataFrame:
    """trace_id, digest: SHA-256 over the lines of each trace as they stand, one trace (a file) a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("trace_id"), F.sha2("content", 256).alias("digest"))


def with_derived(trace: DataFrame) -> DataFrame:
    """`record_count` of repaired copies: records from the segment's base to its end."""
    return trace.withColumn("record_count", F.when(F.col("event") == "SealedCopyRepaired", F.col("record_end") - F.col("segment") + 1))


def write(trace: DataFrame, path: str) -> None:
    """One JSON-lines folder a trace, in the order of seq; nulls are left out."""
    n = trace.sparkSession.conf.get("spark.sql.shuffle.partitions")
    trace.repartition(int(n), "trace_id").sortWithinPartitions("trace_id", "seq").write.partitionBy("trace_id").json(path)


#: A trace for each segment, with one fault in nine of ten (by seg % 10). Runs in either engine; {records} is its input.
FIXTURE = """
WITH n AS (SELECT seg AS trace_id, count(*) AS n FROM {records} GROUP BY seg),
r AS (SELECT seg AS trace_id, ordinal AS o, record_index % 1000003 AS v, seg % 10 AS f FROM {records}),
e AS (
  SELECT trace_id, 0 AS phase, 0 AS o, 0 AS step, 'EpochClaimed' AS event, CAST(NULL AS BIGINT) AS zone, CAST(NULL AS BIGINT) AS logical_offset, CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS segment, CAST(NULL AS BIGINT) AS record_end, CAST(NULL AS BIGINT) AS floor_, CAST(NULL AS BIGINT) AS reported_size, CAST(NULL AS BOOLEAN) AS finalized FROM n
  UNION ALL SELECT trace_id, 0, 0, 1, 'SegmentCreated', 0, NULL, NULL, 0, NULL, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 0, 0, 2, 'SegmentCreated', 1, NULL, NULL, 0, NULL, NULL, NULL, NULL FROM n WHERE trace_id % 10 <> 4
  UNION ALL SELECT trace_id, 0, 0, 3, 'SegmentOpened', NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 1, o, 0, 'RecordFormed', NULL, o, v, 0, NULL, NULL, NULL, NULL FROM r
  UNION ALL SELECT trace_id, 1, o, 1, 'RecordPersisted', 0, o, v, 0, NULL, NULL, NULL, NULL FROM r
  UNION ALL SELECT trace_id, 1, o, 2, 'RecordPersisted', 1, o, v, 0, NULL, NULL, NULL, NULL FROM r WHERE NOT (f = 1 AND o = 50)
  UNION ALL SELECT trace_id, 1, o, 3, 'RecordPersisted', 2, o, v, 0, NULL, NULL, NULL, NULL FROM r WHERE o % 3 = 0
  UNION ALL SELECT trace_id, 1, o, 4, 'RecordCommitted', NULL, CASE WHEN f = 2 AND o = 60 THEN o + 1 ELSE o END, CASE WHEN f = 8 AND o = 70 THEN v + 1 ELSE v END, 0, NULL, NULL, NULL, NULL FROM r
  UNION ALL SELECT trace_id, 1, o, 5, 'ProducerAcknowledged', NULL, o, NULL, NULL, NULL, NULL, NULL, NULL FROM r
  UNION ALL SELECT trace_id, 1, o, 6, 'ProducerAcknowledged', NULL, o, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE f = 7 AND o = 40
  UNION ALL SELECT trace_id, 2, 0, 0, 'SegmentFinalized', 0, NULL, NULL, 0, n - 1, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 2, 0, 1, 'SegmentFinalized', 1, NULL, NULL, 0, n - 1, NULL, NULL, NULL FROM n WHERE trace_id % 10 <> 3
  UNION ALL SELECT trace_id, 2, 0, 2, 'ViewCommitted', NULL, n, 7, 0, n, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 2, 0, 3, 'SegmentSealed', NULL, NULL, NULL, 0, n - 1, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 2, 0, 4, 'GetSizeObserved', 0, NULL, NULL, NULL, NULL, NULL, CASE WHEN trace_id % 10 = 5 THEN 1 ELSE 0 END, FALSE FROM n
  UNION ALL SELECT trace_id, 2, 0, 5, 'SealQuorumEnforced', NULL, NULL, NULL, 0, n - 1, NULL, NULL, NULL FROM n WHERE trace_id % 10 <> 9
  UNION ALL SELECT trace_id, 2, 0, 6, 'DirectoryAdopted', NULL, NULL, NULL, 0, n - 1, 0, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 2, 0, 7, 'ReplayOpened', NULL, 0, NULL, NULL, n, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 3, o, 0, 'ReplayRecord', NULL, o, NULL, NULL, NULL, NULL, NULL, NULL FROM r
  UNION ALL SELECT trace_id, 4, 0, 0, 'ReplayClosed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 4, 0, 1, 'TruncationProposed', NULL, NULL, NULL, NULL, NULL, n, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 4, 0, 2, 'FloorCommitted', NULL, NULL, NULL, NULL, NULL, n, NULL, NULL FROM n
  UNION ALL SELECT trace_id, 4, 0, 3, 'FloorCommitted', NULL, NULL, NULL, NULL, NULL, n - 1, NULL, NULL FROM n WHERE trace_id % 10 = 6
  UNION ALL SELECT trace_id, 4, 0, 4, 'SegmentDeleted', 0, NULL, NULL, 0, n - 1, n, NULL, NULL FROM n
)
SELECT e.trace_id, row_number() OVER (PARTITION BY e.trace_id ORDER BY phase, e.o, step) - 1 AS seq, event, 1 AS writer, 1 AS epoch, zone, logical_offset, value, segment,
       0 AS gen, record_end, floor_ AS truncation_floor, 1 AS reader, reported_size, finalized,
       CASE WHEN event = 'DirectoryAdopted' THEN 0 END AS directory_index, CASE WHEN event = 'DirectoryAdopted' THEN 1 END AS directory_len,
       CASE WHEN event = 'DirectoryAdopted' THEN n.n WHEN event = 'ViewCommitted' THEN logical_offset END AS tail_base,
       CASE WHEN event IN ('DirectoryAdopted', 'SealQuorumEnforced') THEN 100 END AS segment_id, CASE WHEN event = 'DirectoryAdopted' THEN -1 END AS current_seal_id,
       CASE WHEN event = 'DirectoryAdopted' THEN -1 END AS seal_base
FROM e JOIN n ON e.trace_id = n.trace_id
UNION ALL SELECT trace_id, seq, event, writer, epoch, zone, logical_offset, value, segment, gen, record_end, truncation_floor, reader, reported_size, finalized, directory_index, directory_len, tail_base,
       segment_id, current_seal_id, seal_base FROM ({faults}) f
"""

_COLUMNS = "writer epoch zone logical_offset value segment gen record_end truncation_floor reader reported_size directory_index directory_len tail_base segment_id current_seal_id seal_base".split()


def _step(event: str, *values, **more) -> tuple[str, dict]:
    """An event with its required fields in their order; others are 1 for writer, epoch and reader, 0 for gen."""
    own = dict(zip(REQUIRED[event].split(), values, strict=True))
    return event, {"writer": 1, "epoch": 1, "gen": 0, "reader": 1} | own | more


def _record(o: int, v: int = 7, s: int = 0, w: int = 1):
    """Formed, durable in two zones, committed."""
    return [_step("RecordFormed", w, o, v, s), _step("RecordPersisted", 0, w, o, v, s), _step("RecordPersisted", 1, w, o, v, s), _step("RecordCommitted", w, o, v, s)]


def _sealed(end: int, s: int = 0, formed: bool = True):
    """A decision, its finalized quorum and its seal, for a segment of records up to `end`."""
    return [
        *[_step("RecordFormed", 1, o, 7, s) for o in range(s, end + 1) if formed], _step("EpochClaimed", 1, 1), _step("ViewCommitted", 1, end + 1, s, end + 1, 3),
        _step("SegmentFinalized", 0, s, end), _step("SegmentFinalized", 1, s, end), _step("SegmentSealed", s, end),
    ]


def _adopted(index: int, size: int, base: int, ident: int, seal: int, seal_base: int, tail: int = 50, floor: int = 0):
    return _step("DirectoryAdopted", 1, base, ident, index, size, base + 4, tail, floor, current_seal_id=seal, seal_base=seal_base)


#: Short traces, most of which break one rule of the monitors; their ids are -1, -2, and so on.
FAULTS = [
    [*_record(0), _step("RecoverySelected", 2, 0, 99, 0)],
    [*_record(0), *_record(1), _step("RecoverySelected", 2, 0, 7, 0), _step("CanonicalPersisted", 0, 2, 0, 7, 0), _step("CanonicalPersisted", 1, 2, 0, 7, 0), _step("RecoveryCompleted", 2, 0, 0, 1)],
    [*_record(0), _step("RecoverySelected", 2, 0, 7, 0), _step("CanonicalPersisted", 0, 2, 0, 7, 0), _step("RecoveryCompleted", 2, 0, 0, 1)],
    [*_record(0), _step("CanonicalPersisted", 0, 2, 0, 7, 0), _step("CanonicalPersisted", 1, 2, 0, 7, 0), _step("RecoveryCompleted", 2, 0, 0, 1)],
    [*_record(0), _step("RecoverySelected", 2, 0, 7, 0), _step("CanonicalPersisted", 0, 2, 0, 7, 0), _step("CanonicalPersisted", 1, 2, 0, 7, 0), _step("RecoveryCompleted", 2, 0, 0, 1)],
    [_step("SegmentCreated", 0, 1, 1, 0), _step("SegmentCreated", 1, 1, 1, 0), _step("SegmentCreated", 1, 2, 2, 0), _step("SegmentCreated", 2, 2, 2, 0)],
    [_step("SegmentCreated", 0, 1, 1, 0), _step("SegmentCreated", 1, 1, 1, 0), _step("SegmentCreated", 1, 2, 2, 0, gen=1), _step("SegmentCreated", 2, 2, 2, 0, gen=1), _step("SegmentOpened", 0, 1, 1)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("RecordPersisted", 0, 1, 0, 7, 0), _step("RecordPersisted", 1, 2, 0, 7, 0)],
    [*_sealed(1), _step("SealedCopyRepaired", 2, 0, 1), _step("SealedCopyRepaired", 2, 0, 2)],
    [*_sealed(1), _step("SealedCopyRepaired", 2, 5, 6)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("RecordFormed", 1, 0, 7, 0)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("RecoverySelected", 2, 0, 7, 0), _step("RecoverySelected", 2, 0, 7, 3)],
    [_step("ReplayOpened", 1, 0, 0), _step("TruncationProposed", 0), _step("ReplayClosed", 1)],
    [_step("ReplayOpened", 1, 0, 0), _step("RecordFormed", 1, 0, 7, 0)],
    [*_sealed(1), _step("FloorCommitted", 2), _step("SegmentDeleted", 0, 0, 1, 2), _step("TruncationProposed", 1)],
    [_step("FloorCommitted", 9), _step("SegmentDeleted", 0, 0, 1, 2)],
    [*_sealed(1), _step("FloorCommitted", 9), _step("SegmentDeleted", 0, 0, 1, 1)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 0, 5)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 0, 1), _step("ReplayOpened", 2, 0, 1), _step("ReplayOpened", 1, 0, 1)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 1, 0)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("RecordFormed", 1, 1, 7, 0), _step("ReplayOpened", 1, 0, 2), _step("ReplayRecord", 1, 1)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 0, 1), _step("ReplayRecord", 1, 0), _step("ReplayRecord", 1, 1)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 0, 1), _step("ReplayRecord", 1, 0), _step("ReplayClosed", 1), _step("ReplayRecord", 1, 1)],
    [_step("RecordFormed", 1, 3, 7, 0), _step("ReplayOpened", 1, 0, 1), _step("ReplayRecord", 1, 0)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 0, 1), _step("ReplayClosed", 1)],
    [_step("RecordFormed", 1, 0, 7, 0), _step("ReplayOpened", 1, 0, 1), _step("ReplayRecord", 1, 0), _step("ReplayClosed", 1), _step("ReplayClosed", 1)],
    [_step("ReplayClosed", 4)],
    [_step("ReplayRecord", 4, 0)],
    [_step("EpochClaimed", 1, 1), _step("EpochClaimed", 2, 2), _step("EpochClaimed", 1, 2)],
    [_step("ViewCommitted", 4, 5, 0, 5, 3), _step("EpochClaimed", 4, 1)],
    [_step("EpochClaimed", 1, 1), _step("ViewCommitted", 1, 5, 0, 5, 3), _step("ViewCommitted", 1, 4, 2, 4, 3)],
    [_step("EpochClaimed", 1, 1), _step("ViewCommitted", 1, 5, 0, 6, 3)],
    [_step("EpochClaimed", 1, 1), _step("ViewCommitted", 1, 5, 0, 5, 3), _step("ViewCommitted", 1, 5, 0, 5, 4)],
    [_step("EpochClaimed", 1, 1), _step("ViewCommitted", 1, 5, 0, 5, 3), _step("ViewCommitted", 1, 5, 0, 5, 3), _step("ViewCommitted", 1, 9, 5, 9, 3)],
    [_step("FloorCommitted", 5), _step("FloorCommitted", 3)],
    [*_sealed(1), _step("SegmentDeleted", 0, 0, 1, 7)],
    [_step("SegmentFinalized", 0, 0, -1), _step("SegmentFinalized", 1, 0, -1), _step("SegmentSealed", 0, -1)],
    [*_sealed(1, formed=False)],
    [_adopted(0, 2, 0, 100, 101, 5), _adopted(1, 2, 5, 101, 101, 5)],
    [_adopted(0, 0, 0, 100, 100, 0)],
    [_adopted(2, 2, 0, 100, 100, 0)],
    [_adopted(0, 3, 0, 100, 102, 9), _adopted(2, 3, 9, 102, 102, 9)],
    [_adopted(0, 2, 0, 100, 101, 5), _adopted(1, 3, 5, 101, 101, 5)],
    [_adopted(0, 2, 0, 100, 101, 5), _adopted(0, 1, 0, 100, 100, 0)],
    [_adopted(0, 1, 60, 100, 100, 60)],
    [_adopted(0, 2, 0, 100, 100, 5), _adopted(1, 2, 5, 100, 100, 5)],
    [_adopted(0, 2, 5, 100, 101, 3), _adopted(1, 2, 3, 101, 101, 3)],
    [_adopted(0, 2, 0, 100, 101, 6), _adopted(1, 2, 5, 101, 101, 6)],
    [_adopted(0, 1, 0, 100, 101, 6, floor=60)],
]


def _fault_rows() -> str:
    rows = []
    for i, steps in enumerate(FAULTS):
        for seq, (event, own) in enumerate(steps):
            cells = [f"CAST({own[c]} AS BIGINT)" if c in own else "CAST(NULL AS BIGINT)" for c in _COLUMNS]
            rows.append(f"(CAST({-1 - i} AS BIGINT), CAST({seq} AS BIGINT), '{event}', {', '.join(cells)}, CAST(NULL AS BOOLEAN))")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(trace_id, seq, event, {', '.join(_COLUMNS)}, finalized)"


FAULT_ROWS = _fault_rows()


def synthetic(spark: SparkSession, records: DataFrame) -> DataFrame:
    return spark.sql(FIXTURE.format(records="{records}", faults=FAULT_ROWS), records=records)
