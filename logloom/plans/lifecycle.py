"""Queries over a log's life - admission, the register's history, sealing, maintenance, reports - and their SQL.

Inputs are derived from `events` by texts that run in either engine. The SQL beside a query states the rule over these
tables; recursive where the rule is a fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import codec
from logloom.operators import catalog as cat
from logloom.operators import measurement, quorum, writepath
from logloom.sources import traces
from logloom.sources.simulated import ORACLE_TABLES, QUORUM, ZONES, segment_ends

#: Appends as a producer tries them: in order, with a gap, beyond the segment's bytes, with records too large, while
#: the directory is full and after the engine is closed (by seg % 5).
ATTEMPTS = """
SELECT seg AS engine, ordinal AS attempt, seg % 5 = 4 AND ordinal >= 70 AS closed, NOT (seg % 5 = 4 AND ordinal BETWEEN 50 AND 59) AS seal_room,
       CASE WHEN seg % 5 = 1 AND ordinal >= 40 THEN ordinal + 1 WHEN seg % 5 = 4 AND ordinal BETWEEN 50 AND 59 THEN 50 WHEN seg % 5 = 4 AND ordinal >= 60 THEN ordinal - 10
            WHEN seg % 5 = 3 THEN ordinal - coalesce(sum(CASE WHEN encoded_len > 22 THEN 1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE ordinal END AS seqno,
       CASE WHEN seg % 5 = 3 THEN encoded_len - 4 WHEN seg % 5 = 2 THEN 18 ELSE 4 END AS payload_bytes
FROM {records}"""

#: One register for each segment, with a fault in most (by seg % 16), two of them in some.
REGISTERS = """
SELECT seg AS version, seg % 5 AS epoch, CAST(CASE WHEN seg % 16 IN (13, 14) THEN 15 ELSE 30 END AS BIGINT) AS tail_base,
       CASE WHEN seg % 16 = 1 THEN NULL WHEN seg % 16 = 5 THEN 'b' ELSE 't' END AS tail_id,
       CASE seg % 16 WHEN 6 THEN 'x,y' WHEN 7 THEN 't' WHEN 8 THEN 'a' WHEN 0 THEN NULL ELSE 'p' END AS pending_id,
       CASE WHEN seg % 16 = 15 THEN 'a' ELSE 'b' END AS seal_id, CAST(CASE WHEN seg % 16 IN (9, 11) THEN 10 ELSE 20 END AS BIGINT) AS seal_base,
       CASE WHEN seg % 16 = 2 THEN NULL ELSE 'd' END AS seal_digest, CAST(CASE WHEN seg % 16 = 11 THEN 31 ELSE 0 END AS BIGINT) AS trunc,
       CASE WHEN seg % 16 = 12 THEN {no_ids} WHEN seg % 16 = 4 THEN split('a,a', ',') ELSE split('a,b', ',') END AS ids,
       CASE WHEN seg % 16 = 12 THEN {no_bases} WHEN seg % 16 = 3 THEN CAST(split('20,20', ',') AS {longs}) WHEN seg % 16 = 13 THEN CAST(split('20,10', ',') AS {longs}) ELSE CAST(split('10,20', ',') AS {longs}) END AS bases,
       CASE WHEN seg % 16 = 10 THEN split('x,x,y', ',') ELSE split('x,y,z', ',') END AS buckets
FROM {segments}"""

#: A register's history in rounds of ten: claim, register a pending segment, a second one, fold, the same fold again, with
#: another checksum, by an old owner, raise the floor, remove a segment, replace the frontier.
OPERATIONS = """
SELECT register, version, k, CASE k WHEN 0 THEN 'claim' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' WHEN 7 THEN 'raise' WHEN 8 THEN 'remove' WHEN 9 THEN 'frontier' ELSE 'fold' END AS op,
       CASE WHEN k = 6 THEN c ELSE c + 1 END AS epoch, concat('w', c) AS owner,
       CASE WHEN k = 1 THEN concat('p', c) WHEN k = 2 THEN 'other' WHEN k = 8 THEN CASE WHEN c = 2 THEN '0000000000000001-00000000' ELSE concat('p', c - 3) END WHEN k = 9 THEN concat('p', c)
            WHEN c = 0 THEN '0000000000000001-00000000' ELSE concat('p', c - 1) END AS id,
       'zz' AS expect_tail, concat('p', c) AS expect_pending, CASE WHEN k = 9 THEN 10 * c + 10 ELSE 10 * c END AS base, 10 * c + 9 AS stop,
       CASE WHEN k = 5 THEN c + 1000 ELSE c END AS crc, CASE WHEN k = 9 AND register % 2 = 1 THEN 'q' ELSE concat('p', c + 1) END AS refill,
       CASE WHEN k = 8 AND register % 4 = 1 THEN 10 * c + 100 WHEN k = 8 AND register % 4 = 2 THEN 5 ELSE greatest(10 * c - 15 + register % 3 * 10, 0) END AS floor
FROM (SELECT seg AS register, ordinal AS version, CAST(floor(ordinal / 10) AS BIGINT) AS c, ordinal % 10 AS k FROM {records})"""

_RES = """wm AS (SELECT seg, list_sort(list(durable), 'DESC')[2] AS watermark FROM lanes GROUP BY seg),
res AS (SELECT e.seg, count(*) FILTER (record_end <= watermark) AS committed FROM ends e JOIN wm USING (seg) GROUP BY e.seg)"""
_CONTENT = "d AS (SELECT f.seg, f.zone, count(*) AS records, sha256(unhex(string_agg(printf('%08x', 4 + octet_length(encode(frame))) || hex(encode(frame)), '' ORDER BY ordinal))) AS digest FROM frames f GROUP BY ALL)"

QUERIES: dict = {}
SQL: dict = {}


def case(sql: str, tables: bool = True, recursive: bool = False):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{ORACLE_TABLES}{sql}" if tables else sql
        return f

    return put


def register(query, oracle: dict) -> None:
    for f in QUERIES.values():
        query(f)
    oracle.update(SQL | FOLDS)


def _resolved(t):
    return quorum.commit_resolution(segment_ends(t.records()), t.lanes(), QUORUM)


#: SQL of queries that the registry defines over the inputs above.
FOLDS = {
    "admission_check": f"WITH RECURSIVE {ORACLE_TABLES}, a AS (" + ATTEMPTS.format(records="records") + """), f AS (
  SELECT DISTINCT seg AS engine, CAST(-1 AS BIGINT) AS attempt, '' AS outcome, CAST(0 AS BIGINT) AS expected, CAST(0 AS BIGINT) AS active FROM records
  UNION ALL SELECT engine, attempt, o, expected + CASE WHEN o = 'Admitted' THEN 1 ELSE 0 END, active + CASE WHEN o = 'Admitted' THEN payload_bytes + 4 ELSE 0 END FROM (
    SELECT a.*, f.expected, f.active, CASE WHEN a.closed THEN 'Closed' WHEN a.seqno <> f.expected THEN 'OutOfOrder' WHEN a.payload_bytes > 18 THEN 'RecordTooLarge'
      WHEN NOT a.seal_room THEN 'SegmentDirectoryFull' WHEN f.active + a.payload_bytes + 4 > 1200 THEN 'ActiveSegmentFull' ELSE 'Admitted' END AS o
    FROM f JOIN a ON a.engine = f.engine AND a.attempt = f.attempt + 1))
SELECT engine, attempt, outcome FROM f WHERE attempt >= 0""",
    "register_validate": f"WITH {ORACLE_TABLES}, reg AS (" + REGISTERS.format(longs="BIGINT[]", no_ids="CAST([] AS VARCHAR[])", no_bases="CAST([] AS BIGINT[])", segments="segments") + """), entry AS (
  SELECT version, tail_base, unnest(ids) AS id, unnest(bases) AS base, generate_subscripts(bases, 1) AS i FROM reg
), bad AS (SELECT version, arg_min(rule, i) AS rule FROM (
  SELECT version, i, CASE WHEN base <= lag(base) OVER (PARTITION BY version ORDER BY i) THEN 'bases_increase' WHEN base >= tail_base THEN 'base_below_tail'
    WHEN row_number() OVER (PARTITION BY version, id ORDER BY i) > 1 THEN 'unique_ids' END AS rule FROM entry) WHERE rule IS NOT NULL GROUP BY version)
SELECT version, CASE WHEN (seal_base IS NULL) <> (seal_digest IS NULL) THEN 'seal_pair' WHEN epoch > 0 AND tail_id IS NULL THEN 'tail_id' WHEN bad.rule IS NOT NULL THEN bad.rule
  WHEN list_contains(ids, tail_id) THEN 'tail_not_listed' WHEN pending_id = '' OR contains(pending_id, ':') OR contains(pending_id, ',') THEN 'pending_form' WHEN pending_id = tail_id THEN 'pending_not_tail'
  WHEN list_contains(ids, pending_id) THEN 'pending_not_listed' WHEN tail_base > trunc AND len(ids) > 0 AND (ids[-1] IS DISTINCT FROM seal_id OR bases[-1] IS DISTINCT FROM seal_base) THEN 'last_is_seal'
  WHEN len(buckets) NOT IN (1, 3, 5) OR len(list_distinct(buckets)) <> len(buckets) OR list_contains(buckets, '') THEN 'buckets' END AS first_failed_rule
FROM reg LEFT JOIN bad USING (version)""",
    "register_fold": f"WITH RECURSIVE {ORACLE_TABLES}, ops AS (" + OPERATIONS.format(records="records") + """), f AS (
  SELECT DISTINCT seg AS register, CAST(-1 AS BIGINT) AS version, '' AS outcome, CAST(0 AS BIGINT) AS epoch, '' AS owner, CAST(0 AS BIGINT) AS tail_base, CAST(NULL AS VARCHAR) AS tail, CAST(NULL AS VARCHAR) AS pending,
    CAST(0 AS BIGINT) AS trunc, CAST([] AS VARCHAR[]) AS ids, CAST([] AS BIGINT[]) AS bases, CAST([] AS BIGINT[]) AS crcs, CAST(NULL AS VARCHAR) AS seal FROM records
  UNION ALL
  SELECT register, version, o, CASE WHEN op = 'claim' THEN epoch + 1 ELSE epoch END, CASE WHEN op = 'claim' THEN o_owner ELSE owner END, CASE WHEN o <> 'applied' OR op <> 'fold' THEN tail_base ELSE o_end + 1 END,
    CASE WHEN op = 'claim' THEN coalesce(tail, printf('%016x-00000000', epoch + 1)) WHEN o <> 'applied' THEN tail WHEN op = 'fold' THEN o_pending WHEN op = 'frontier' THEN o_id ELSE tail END,
    CASE WHEN o <> 'applied' THEN pending WHEN op = 'pending' THEN o_id WHEN op IN ('fold', 'frontier') THEN o_refill ELSE pending END,
    CASE WHEN o = 'applied' AND op = 'raise' THEN o_floor ELSE trunc END,
    CASE WHEN o <> 'applied' THEN ids WHEN op = 'fold' THEN list_append(ids, o_id) WHEN op = 'remove' THEN ids[:place - 1] || ids[place + 1:] ELSE ids END,
    CASE WHEN o <> 'applied' THEN bases WHEN op = 'fold' THEN list_append(bases, o_base) WHEN op = 'remove' THEN bases[:place - 1] || bases[place + 1:] ELSE bases END,
    CASE WHEN o <> 'applied' THEN crcs WHEN op = 'fold' THEN list_append(crcs, o_crc) WHEN op = 'remove' THEN crcs[:place - 1] || crcs[place + 1:] ELSE crcs END,
    CASE WHEN o = 'applied' AND op = 'fold' THEN o_id || ':' || o_base ELSE seal END
  FROM (SELECT *, CASE
      WHEN op = 'claim' THEN 'applied'
      WHEN op = 'raise' THEN CASE WHEN o_floor > trunc THEN 'applied' ELSE 'unchanged' END
      WHEN op = 'remove' THEN CASE WHEN o_floor > trunc THEN 'InvalidManifest' WHEN place = 0 THEN 'unchanged' WHEN coalesce(bases[place + 1], tail_base) > o_floor THEN 'InvalidManifest' ELSE 'applied' END
      WHEN o_epoch = 0 OR epoch <> o_epoch OR owner <> o_owner THEN 'Fenced'
      WHEN op = 'pending' THEN CASE WHEN pending IS NULL THEN 'applied' WHEN pending = o_id THEN 'unchanged' ELSE 'Fenced' END
      WHEN op = 'frontier' THEN CASE WHEN tail_base <> o_base THEN 'Fenced' WHEN tail = o_id AND pending = o_refill THEN 'unchanged' WHEN tail = o_tail AND pending = o_pending THEN 'applied' ELSE 'Fenced' END
      WHEN tail = o_pending AND tail_base = o_end + 1 AND pending = o_refill AND seal = o_id || ':' || o_base
        THEN CASE WHEN len(ids) > 0 AND ids[-1] = o_id AND bases[-1] = o_base AND crcs[-1] = o_crc THEN 'unchanged' ELSE 'InvalidManifest' END
      WHEN tail IS DISTINCT FROM o_id OR tail_base <> o_base OR pending IS DISTINCT FROM o_pending THEN 'Fenced'
      WHEN len(ids) >= 8 THEN 'SegmentDirectoryFull' ELSE 'applied' END AS o
    FROM (SELECT f.* EXCLUDE (version, outcome), ops.version, ops.op, ops.epoch AS o_epoch, ops.owner AS o_owner, ops.id AS o_id, ops.expect_tail AS o_tail, ops.expect_pending AS o_pending, ops.base AS o_base,
        ops.stop AS o_end, ops.crc AS o_crc, ops.refill AS o_refill, ops.floor AS o_floor, coalesce(list_position(f.ids, ops.id), 0) AS place
      FROM f JOIN ops ON ops.register = f.register AND ops.version = f.version + 1)))
SELECT register, version, outcome, epoch, tail_base, tail, pending, trunc, len(ids) AS segments FROM f WHERE version >= 0""",
}


def _frames_of(t):
    """Content that is wanted of each segment, and what the copies hold."""
    canonical = t.records().select("seg", "ordinal", F.col("payload").alias("frame"))
    return canonical, t.frames().select("seg", "zone", "ordinal", "frame")


_SHARED = """, held AS (SELECT f.seg, f.zone, min(f.ordinal) FILTER (f.frame <> r.payload) AS bad, count(*) AS k FROM frames f JOIN records r ON r.seg = f.seg AND r.ordinal = f.ordinal GROUP BY ALL),
shared AS (SELECT seg, zone, coalesce(bad, k) AS shared, row_number() OVER (PARTITION BY seg ORDER BY coalesce(bad, k), zone) - 1 AS place FROM held)"""


@case(_SHARED + " SELECT seg, zone, shared, place FROM shared")
def enforce_order(t):
    return quorum.enforce_order(*_frames_of(t))


@case(_SHARED + """ SELECT c.seg, c.zone, CASE WHEN coalesce(shared, -1) <> n OR n_copy <> n THEN 'replace' WHEN finalized THEN 'done' ELSE 'finalize' END AS action
FROM copies c LEFT JOIN shared s ON s.seg = c.seg AND s.zone = c.zone""")
def witness_action(t):
    return quorum.witness_action(t.copies(), quorum.enforce_order(*_frames_of(t)), t.segments().select("seg", F.col("n").alias("total")))


@case(f", {_CONTENT} SELECT d.seg, digest, records, count(*) AS copies FROM d JOIN copies c ON c.seg = d.seg AND c.zone = d.zone AND c.finalized GROUP BY d.seg, digest, records HAVING count(*) >= 2")
def finalized_content(t):
    return quorum.finalized_content(t.frames(), t.copies())


@case(f", {_CONTENT} SELECT d.seg, digest, records, count(*) AS copies FROM d JOIN copies c ON c.seg = d.seg AND c.zone = d.zone AND c.finalized AND c.crc_ok GROUP BY d.seg, digest, records HAVING count(*) >= 2")
def seal_digest_quorum(t):
    return quorum.finalized_content(t.frames(), t.copies(), healthy=True)


@case(f", {_RES} SELECT seg, CASE WHEN seg % 7 = 0 THEN 0 ELSE n END > 0 AND CASE WHEN seg % 7 = 0 THEN 0 ELSE n END = committed AS ready FROM segments JOIN res USING (seg)")
def swap_boundary(t):
    return writepath.swap_ready(_resolved(t), t.segments().selectExpr("seg", "CASE WHEN seg % 7 = 0 THEN 0 ELSE n END AS admitted"))


@case(" SELECT seg AS engine, record_index, CASE WHEN ordinal < greatest(32 - seg * 3 % 40, 0) THEN 0 END AS batch FROM records")
def windowed_dispatch(t):
    return writepath.windowed_batches(t.records().selectExpr("seg AS engine", "record_index", "seg * 3 % 40 AS outstanding"), 32)


@case(""" SELECT seg, zone, seq, max(CASE WHEN total - acked > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY seg, zone ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS retired FROM (
  SELECT seg, zone, record_index AS seq, sum(encoded_len) OVER (PARTITION BY seg, zone ORDER BY record_index) AS total, greatest(record_end - (300 + zone * 250), 0) AS acked FROM ends, zones)""")
def lane_budget(t):
    b = segment_ends(t.records()).withColumn("zone", F.explode(F.array(*map(F.lit, range(ZONES)))))
    return writepath.lane_budget(b.selectExpr("seg", "zone", "record_index AS seq", "encoded_len AS bytes", "greatest(record_end - (300 + zone * 250), 0) AS acked"), 600)


@case(" SELECT seg, count(*) FILTER ((seg * 3 + zone) % 4 > 0) AS created, count(*) FILTER ((seg * 3 + zone) % 4 > 0) >= 2 AS opened FROM copies GROUP BY seg")
def writer_created(t):
    return writepath.created(t.copies().selectExpr("seg", "zone", "CASE WHEN (seg * 3 + zone) % 4 > 0 THEN 'Created' ELSE 'AlreadyExists' END AS outcome"), QUORUM)


@case(""" SELECT seg, zone, CASE (seg + zone) % 3 WHEN 0 THEN TRUE WHEN 1 THEN finalized AND n_copy = n AND seg % 5 = seg % 10 ELSE FALSE END AS accepted FROM copies""")
def finish_accepted(t):
    f = t.copies().selectExpr("seg", "zone", "CASE (seg + zone) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ambiguous' ELSE 'error' END AS reply", "finalized AS stat_finalized", "seg % 10 AS stat_generation", "seg % 5 AS generation", "n_copy AS stat_size", "n AS write_offset")
    return writepath.finish_accepted(f)


@case(" SELECT seg % 20 AS register, max(record_index) AS version, arg_max(payload, record_index) AS record FROM records GROUP BY 1")
def cached_register(t):
    return cat.latest_register(t.records().selectExpr("seg % 20 AS register", "record_index AS version", "payload AS record"))


@case(", reg AS (" + REGISTERS.format(longs="BIGINT[]", no_ids="CAST([] AS VARCHAR[])", no_bases="CAST([] AS BIGINT[])", segments="segments") + ") SELECT version, array_to_string(buckets, ',') = 'x,y,z' AS agrees FROM reg")
def configuration_agrees(t):
    text = REGISTERS.format(longs="ARRAY<BIGINT>", no_ids="CAST(array() AS ARRAY<STRING>)", no_bases="CAST(array() AS ARRAY<BIGINT>)", segments="{segments}")
    return cat.configuration_agrees(t.spark.sql(text, segments=t.segments()), ["x", "y", "z"])


@case(" SELECT dir, min(CASE WHEN dir % 3 = 1 AND pos = 4 THEN 0 ELSE 1 END) = 1 AS extends FROM (SELECT seg // 10 AS dir, seg % 10 AS pos FROM catalog) WHERE pos < 5 GROUP BY dir")
def directory_extends(t):
    c = t.catalog().selectExpr("seg div 10 AS dir", "seg % 10 AS pos", "id")
    return cat.extends(c.where("pos < 5"), c.withColumn("id", F.expr("CASE WHEN dir % 3 = 1 AND pos = 4 THEN 'other' ELSE id END")), "dir")


@case(" SELECT base, id, seg % 3 = 0 AND seg % 6 <> 0 AS seal_pending FROM catalog WHERE seg % 5 <> 2")
def adopt_catalog(t):
    c = t.catalog()
    return cat.adopt(c.selectExpr("base", "id", "seg % 3 = 0 AS seal_pending"), c.where("seg % 5 = 2"), c.where("seg % 6 = 0"))


@case(" SELECT base FROM catalog WHERE seg % 5 = 2")
def vanished_bases(t):
    return cat.vanished(t.catalog(), t.catalog().where("seg % 5 <> 2"))


@case(" SELECT seg, CASE WHEN seg % 2 = 0 THEN 'logs' ELSE 'a/b' END || '/segments/' || id AS object FROM catalog")
def segment_object(t):
    return t.catalog().select("seg", codec.segment_object(F.expr("CASE WHEN seg % 2 = 0 THEN 'logs' ELSE 'a/b' END"), F.col("id")).alias("object"))


@case(""" SELECT record_index, CASE WHEN code IN ('Poisoned', 'Fenced', 'Closed') THEN TRUE WHEN code IN ('NoReadQuorum', 'Unavailable', 'Aborted') THEN ordinal % 2 = 0 ELSE FALSE END AS expected
FROM (SELECT record_index, ordinal, ['Poisoned', 'Fenced', 'Closed', 'NoReadQuorum', 'Unavailable', 'Aborted', 'InvalidArgument'][record_index % 7 + 1] AS code FROM records)""")
def fault_triage(t):
    codes = "element_at(array('Poisoned', 'Fenced', 'Closed', 'NoReadQuorum', 'Unavailable', 'Aborted', 'InvalidArgument'), CAST(record_index % 7 AS int) + 1)"
    return t.records().select("record_index", codec.expected_fault(F.expr(codes), F.col("ordinal") % 2 == 0).alias("expected"))


@case(" SELECT seg, seg % 4 > 0 AND 3000 + seg % 1200 >= 3600 AND 3599000 + seg * 10 % 3000 >= 3600000 AND seg % 3 > 0 AND seg % 7 > 0 AS matches FROM segments")
def receipt_matches(t):
    r = t.segments().selectExpr("seg", "seg % 4 > 0 AS passed", "3000 + seg % 1200 AS requested_s", "3599000 + seg * 10 % 3000 AS elapsed_ms", "CASE WHEN seg % 3 > 0 THEN 'd' ELSE 'e' END AS digest", "CASE WHEN seg % 7 = 0 THEN 'quick' ELSE 'production' END AS mode")
    return measurement.receipt_matches(r, "d")


@case(" SELECT operation, count(*) AS calls, count(*) FILTER (faulted) AS faults FROM (SELECT ['get', 'put', 'stat', 'list'][record_index % 4 + 1] AS operation, record_index % 9 = 0 AS faulted FROM records) GROUP BY operation")
def operation_counts(t):
    log = t.records().selectExpr("element_at(array('get', 'put', 'stat', 'list'), CAST(record_index % 4 AS int) + 1) AS operation", "record_index % 9 = 0 AS faulted")
    return measurement.operation_counts(log)


@case(""" SELECT kind, name, CAST(CASE kind WHEN 'counter' THEN sum(value) ELSE arg_max(value, seq) END AS BIGINT) AS value FROM (
  SELECT record_index AS seq, ['counter', 'gauge', 'updown', 'histogram'][seg % 4 + 1] AS kind, 'm' || seg % 12 AS name, record_index * 37 % 101 AS value FROM records) WHERE kind IN ('counter', 'gauge') GROUP BY kind, name""")
def metric_recorder(t):
    m = t.records().selectExpr("record_index AS seq", "element_at(array('counter', 'gauge', 'updown', 'histogram'), CAST(seg % 4 AS int) + 1) AS kind", "concat('m', seg % 12) AS name", "concat('l', ordinal % 3) AS label", "record_index * 37 % 101 AS value")
    return measurement.recorded(m)


@case(""" SELECT phase, quantile_disc(us, 0.5) AS p50, quantile_disc(us, 0.99) AS p99, max(us) AS max, round(avg(reads), 6) AS reads FROM (
  SELECT seg, phase, least(greatest(lead(mark) OVER (PARTITION BY seg ORDER BY i) - mark, 1), 599000000) AS us, reads FROM (
    SELECT seg, unnest(['epoch_claim', 'prepare', 'replay', 'start', 'end']) AS phase, unnest([0, 1, 2, 3, 4]) AS i, unnest([0, 100 + seg * 7 % 50, 300 + seg * 11 % 90, 700 + seg * 13 % 200, 1500 + seg * 17 % 400]) AS mark, after - before AS reads
    FROM (SELECT seg, min(record_index) AS before, max(record_index) AS after FROM records GROUP BY seg)))
WHERE phase <> 'end' GROUP BY phase
UNION ALL SELECT 'total', quantile_disc(us, 0.5), quantile_disc(us, 0.99), max(us), round(avg(reads), 6) FROM (SELECT 1500 + seg * 17 % 400 AS us, n - 1 AS reads FROM segments)""")
def recovery_report(t):
    marks = t.segments().selectExpr("seg AS iteration", "stack(5, 0L, 'epoch_claim', 0L, 1L, 'prepare', 100 + seg * 7 % 50, 2L, 'replay', 300 + seg * 11 % 90, 3L, 'start', 700 + seg * 13 % 200, 4L, 'end', 1500 + seg * 17 % 400) AS (i, phase, at_us)")
    reads = t.records().selectExpr("seg AS iteration", "ordinal AS seq", "record_index AS value")
    return measurement.recovery_report(marks, reads)


@case(" SELECT seg % 4 AS disk, count(*) AS appends, count(*) AS fsyncs, CAST(sum(encoded_len) AS BIGINT) AS bytes, quantile_disc(least(greatest(record_index * 7919 % 40009, 1), 599000000), 0.99) AS p99 FROM records GROUP BY 1")
def disk_report(t):
    return measurement.disk_report(t.records().selectExpr("seg % 4 AS disk", "encoded_len AS bytes", "record_index * 7919 % 40009 AS us"))


@case(""" SELECT record_index, CASE WHEN record_index % 3 = 0 THEN crc32c_ok ELSE TRUE END AS found FROM (SELECT record_index, FALSE AS crc32c_ok FROM records)""")
def corrupt_byte(t):
    """A flipped byte shows in the checksum, unless that is updated too."""
    r = t.records().select("record_index", codec.frame(F.col("payload")).alias("b"))
    bad = r.withColumn("c", F.when(F.col("record_index") % 3 == 0, codec.flipped(F.col("b"), F.pmod(F.col("record_index"), F.octet_length("b")))).otherwise(F.col("b")))
    return bad.select("record_index", (codec.crc32c(F.col("b")) == codec.crc32c(F.col("c"))).alias("found"))


@case(" SELECT record_index, record_index + 1 AS next_seqno FROM records")
def receipts(t):
    return t.records().select("record_index", codec.next_seqno(F.col("record_index")).alias("next_seqno"))


_NAMES = ", ".join(f"({i}, '{e}')" for i, e in enumerate(traces.EVENTS))


@case(f"SELECT CAST(i AS BIGINT) AS pos, name AS listed, CASE WHEN i = 3 THEN 'Other' ELSE name END AS declared, i <> 3 AS same FROM (VALUES {_NAMES}) v(i, name)", tables=False)
def event_name_parity(t):
    declared = ["Other" if i == 3 else e for i, e in enumerate(traces.EVENTS)]
    return traces.name_parity(t.spark.createDataFrame([(i, e) for i, e in enumerate(traces.EVENTS)], "pos long, name string"), declared)


@case(""" SELECT seg AS config, CASE seg % 6 WHEN 1 THEN 'queue_capacity' WHEN 2 THEN 'max_record_bytes' WHEN 3 THEN 'window' WHEN 4 THEN 'active_below_segment' WHEN 5 THEN 'inflight_below_record' END AS first_failure FROM segments""")
def config_validate(t):
    base = t.spark.createDataFrame([tuple(writepath.DEFAULTS.values())], ", ".join(f"{k} long" for k in writepath.DEFAULTS))
    faults = {
        "queue_capacity": "CASE WHEN seg % 6 = 1 THEN 0 ELSE queue_capacity END", "max_record_bytes": "CASE WHEN seg % 6 = 2 THEN 0 ELSE max_record_bytes END",
        "window": "CASE WHEN seg % 6 IN (1, 3) THEN 0 ELSE window END", "max_active_bytes": "CASE WHEN seg % 6 = 4 THEN max_segment_bytes - 1 ELSE max_active_bytes END",
        "inflight_bytes": "CASE WHEN seg % 6 = 5 THEN max_record_bytes ELSE inflight_bytes END",
    }
    c = t.segments().select(F.col("seg"), F.col("seg").alias("config")).join(base, how="cross")  # one row of defaults
    return writepath.validate_config(c.withColumns({k: F.expr(e) for k, e in faults.items()}))
