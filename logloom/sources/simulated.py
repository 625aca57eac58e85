"""Log tables derived from `events` with integer arithmetic only, so that any engine derives the same ones.

Segments hold 100 records; three zones keep a copy of each, some shorter, missing, unreachable or divergent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import codec

PER_SEGMENT, ZONES, QUORUM = 100, 3, 2


class LogTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def records(self) -> DataFrame:
        """record_index, seg, ordinal, payload, encoded_len"""
        e = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").select("event_id", "event_type", "props")
        payload = F.concat_ws("|", "event_type", "props")
        return e.select(
            F.col("event_id").alias("record_index"), F.expr(f"event_id div {PER_SEGMENT}").alias("seg"), (F.col("event_id") % PER_SEGMENT).alias("ordinal"),
            payload.alias("payload"), codec.encoded_len(payload).alias("encoded_len"),
        )

    def segments(self) -> DataFrame:
        """seg, base, n, bytes: one row for each segment"""
        return self.records().groupBy("seg").agg(F.min("record_index").alias("base"), F.count("*").alias("n"), F.sum("encoded_len").alias("bytes"))

    def copies(self) -> DataFrame:
        """seg, zone, n_copy, observation, finalized, format_ok, crc_ok; unreachable copies have no row"""
        s = self.segments().withColumn("last", F.lit(self._last()))
        z = s.withColumn("zone", F.explode(F.array(*map(F.lit, range(ZONES)))))
        z = z.where("NOT (zone = 2 AND seg % 11 = 3)").withColumn("missing", F.expr("zone = 2 AND seg % 5 = 0"))
        n_copy = F.expr("CASE WHEN missing THEN 0 ELSE greatest(n - (seg * 7 + zone * 13) % 40 * CAST(seg % 3 > 0 AS int), 0) END")
        return z.select(
            "seg", "zone", "base", "n", n_copy.alias("n_copy"),
            F.expr("CASE WHEN missing THEN 'missing' WHEN seg < last THEN 'finalized' ELSE 'live' END").alias("observation"),
            F.expr("NOT missing AND seg < last").alias("finalized"), F.expr("(seg + zone) % 17 <> 0").alias("format_ok"), F.expr("(seg + zone) % 19 <> 0").alias("crc_ok"),
        )

    def _last(self) -> int:
        return self.records().agg(F.max("seg")).first()[0] or 0

    def frames(self) -> DataFrame:
        """seg, zone, ordinal, frame, record_end: the records that each copy holds, as text; some diverge in zone 2"""
        r = self.records()
        ends = segment_ends(r).select("seg", "ordinal", "payload", "record_end")
        c = self.copies().select("seg", "zone", "n_copy")
        return ends.join(c, "seg").where("ordinal < n_copy").select(
            "seg", "zone", "ordinal", F.expr("CASE WHEN seg % 4 = 1 AND zone = 2 AND ordinal >= 50 THEN payload || 'X' ELSE payload END").alias("frame"), "record_end"
        )

    def progress(self) -> DataFrame:
        """seg, zone, seq, durable: reports of durable bytes, every ten records"""
        ends = segment_ends(self.records()).where("ordinal % 10 = 9").select("seg", "record_index", "ordinal", "record_end")
        c = self.copies().select("seg", "zone", "n_copy")
        return ends.join(c, "seg").where("ordinal < n_copy").select("seg", "zone", F.expr(f"record_index * {ZONES} + zone").alias("seq"), F.col("record_end").alias("durable"))

    def lanes(self) -> DataFrame:
        """seg, zone, durable, represented_end, finished, error_code: the last state of each lane"""
        d = self.progress().groupBy("seg", "zone").agg(F.max("durable").alias("durable"))
        z = self.segments().select("seg", F.explode(F.array(*map(F.lit, range(ZONES)))).alias("zone")).join(d, ["seg", "zone"], "left")
        d0 = F.coalesce("durable", F.lit(0))
        return z.select(
            "seg", "zone", d0.alias("durable"), (d0 + (F.col("seg") * 3 + F.col("zone")) % 7 * 40).alias("represented_end"), F.expr("(seg + zone) % 6 = 0").alias("finished"),
            F.expr("CASE WHEN (seg + zone) % 6 = 0 THEN element_at(array('FailedPrecondition', 'Unavailable', 'InvalidArgument', NULL), CAST((seg * 5 + zone) % 4 AS int) + 1) END").alias("error_code"),
        )

    def catalog(self) -> DataFrame:
        """id, epoch, seg, base, crc: the directory"""
        s = self.segments()
        return s.select("seg", "base", "n", codec.segment_id(F.expr("seg div 7"), F.col("seg")).alias("id"), F.expr("(seg * 2654435761) % 4294967296").alias("crc"))


def segment_ends(records: DataFrame) -> DataFrame:
    """`record_end`: bytes of the segment up to and with each record."""
    from pyspark.sql import Window

    w = Window.partitionBy("seg").orderBy("record_index").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("record_end", F.sum("encoded_len").over(w))


#: The same tables for the oracle.
ORACLE_TABLES = """
records AS (
  SELECT event_id AS record_index, event_id // 100 AS seg, event_id % 100 AS ordinal, event_type || '|' || props AS payload,
         CAST(4 + octet_length(encode(event_type || '|' || props)) AS BIGINT) AS encoded_len
  FROM events
), ends AS (
  SELECT *, CAST(sum(encoded_len) OVER (PARTITION BY seg ORDER BY record_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record_end FROM records
), segments AS (
  SELECT seg, min(record_index) AS base, count(*) AS n, CAST(sum(encoded_len) AS BIGINT) AS bytes FROM records GROUP BY seg
), zones AS (SELECT unnest([0, 1, 2]) AS zone), copies AS (
  SELECT seg, zone, base, n,
         CASE WHEN zone = 2 AND seg % 5 = 0 THEN 0 WHEN seg % 3 > 0 THEN greatest(n - (seg * 7 + zone * 13) % 40, 0) ELSE n END AS n_copy,
         CASE WHEN zone = 2 AND seg % 5 = 0 THEN 'missing' WHEN seg < (SELECT max(seg) FROM segments) THEN 'finalized' ELSE 'live' END AS observation,
         NOT (zone = 2 AND seg % 5 = 0) AND seg < (SELECT max(seg) FROM segments) AS finalized,
         (seg + zone) % 17 <> 0 AS format_ok, (seg + zone) % 19 <> 0 AS crc_ok
  FROM segments, zones WHERE NOT (zone = 2 AND seg % 11 = 3)
), frames AS (
  SELECT e.seg, zone, ordinal, CASE WHEN e.seg % 4 = 1 AND zone = 2 AND ordinal >= 50 THEN payload || 'X' ELSE payload END AS frame, record_end
  FROM ends e JOIN copies c ON e.seg = c.seg WHERE ordinal < n_copy
), progress AS (
  SELECT e.seg, zone, record_index * 3 + zone AS seq, record_end AS durable
  FROM ends e JOIN copies c ON e.seg = c.seg WHERE ordinal < n_copy AND ordinal % 10 = 9
), lanes AS (
  SELECT s.seg, z.zone, coalesce(d, 0) AS durable, coalesce(d, 0) + (s.seg * 3 + z.zone) % 7 * 40 AS represented_end, (s.seg + z.zone) % 6 = 0 AS finished,
         CASE WHEN (s.seg + z.zone) % 6 = 0 THEN CASE (s.seg * 5 + z.zone) % 4 WHEN 0 THEN 'FailedPrecondition' WHEN 1 THEN 'Unavailable' WHEN 2 THEN 'InvalidArgument' END END AS error_code
  FROM segments s CROSS JOIN zones z LEFT JOIN (SELECT seg, zone, max(durable) AS d FROM progress GROUP BY ALL) p ON p.seg = s.seg AND p.zone = z.zone
), catalog AS (
  SELECT seg, base, n, printf('%016x-%08x', seg // 7, seg) AS id, (seg * 2654435761) % 4294967296 AS crc FROM segments
)
"""
