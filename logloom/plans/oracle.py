"""For each query the same result in SQL, written independently of the plans."""

from __future__ import annotations

from logloom.sources.simulated import ORACLE_TABLES
from logloom.sources.traces import EVENTS, FAULT_ROWS, FIXTURE, IGNORED, REQUIRED


def _q(body: str, more: str = "") -> str:
    return f"WITH {ORACLE_TABLES}{', ' + more if more else ''} {body}"


_WM = "wm AS (SELECT seg, list_sort(list(durable), 'DESC')[2] AS watermark FROM lanes GROUP BY seg)"
_RES = _WM + """, res AS (SELECT e.seg, count(*) FILTER (record_end <= watermark) AS committed, coalesce(max(record_end) FILTER (record_end <= watermark), 0) AS committed_bytes
FROM ends e JOIN wm USING (seg) GROUP BY e.seg)"""
_FEASIBLE = """SELECT seg, CASE WHEN bool_or(coalesce(finished AND error_code IN ('FailedPrecondition', 'Aborted'), FALSE)) THEN 'Fenced' WHEN max(b) IS NULL THEN 'Committed'
  WHEN count(*) FILTER (durable >= b OR (NOT finished AND represented_end >= b)) >= 2 THEN 'Pending'
  WHEN count(*) FILTER (finished AND represented_end >= b AND error_code = 'InvalidArgument') > 0 THEN 'Transport:InvalidArgument' ELSE 'Poisoned' END AS status
FROM lanes JOIN (SELECT e.seg, min(record_end) FILTER (record_end > watermark) AS b FROM ends e JOIN wm USING (seg) GROUP BY e.seg) USING (seg) GROUP BY seg"""
_SIZES = "sizes AS (SELECT c.seg, c.zone, coalesce(max(f.record_end), 0) AS size FROM copies c LEFT JOIN frames f ON f.seg = c.seg AND f.zone = c.zone GROUP BY ALL)"
_REC = _SIZES + ", rec AS (SELECT seg, count(*) AS observed, CASE WHEN count(*) >= 2 THEN list_sort(list(size), 'DESC')[count(*) - 1] END AS size FROM sizes GROUP BY seg)"
_CANON = _REC + """, body AS (SELECT c.seg, c.zone, coalesce(list(frame ORDER BY ordinal) FILTER (record_end <= rec.size), []) AS body FROM copies c JOIN rec ON rec.seg = c.seg AND rec.size IS NOT NULL
    LEFT JOIN frames f ON f.seg = c.seg AND f.zone = c.zone GROUP BY ALL),
  pairs AS (SELECT a.seg, a.zone AS l, b.zone AS r, greatest(len(a.body), len(b.body)) AS len, CASE WHEN len(b.body) > len(a.body) THEN b.body ELSE a.body END AS body,
    (SELECT min(i) - 1 FROM range(1, least(len(a.body), len(b.body)) + 1) t(i) WHERE a.body[i] <> b.body[i]) AS bad_at FROM body a JOIN body b ON a.seg = b.seg AND a.zone < b.zone),
  agreed AS (SELECT seg, CASE WHEN n_ok > 0 AND n_best = 1 THEN len END AS len, CASE WHEN n_ok > 0 AND n_best = 1 THEN zones END AS zones,
    CASE WHEN n_ok = 0 THEN coalesce(first_at, 0) WHEN n_best > 1 THEN clash END AS conflict_at
  FROM (SELECT p.seg, count(*) FILTER (bad_at IS NULL) AS n_ok, max(len) FILTER (bad_at IS NULL) AS len, arg_min(bad_at, l * 10 + r) FILTER (bad_at IS NOT NULL) AS first_at FROM pairs p GROUP BY p.seg)
  LEFT JOIN (SELECT seg, len, min(l || ',' || r) AS zones, count(DISTINCT body) AS n_best,
      (SELECT min(i) - 1 FROM range(1, len + 1) t(i) WHERE list_extract(min(body), i) IS DISTINCT FROM list_extract(max(body), i)) AS clash
    FROM pairs WHERE bad_at IS NULL GROUP BY seg, len) USING (seg, len)),
  canon AS (SELECT a.seg, len, zones, conflict_at, CASE WHEN conflict_at IS NULL THEN coalesce(e.record_end, 0) END AS bytes,
    CASE WHEN conflict_at IS NULL THEN (SELECT max(size) FROM sizes s WHERE s.seg = a.seg) > coalesce(e.record_end, 0) END AS discarded
  FROM agreed a LEFT JOIN ends e ON e.seg = a.seg AND e.ordinal = len - 1)"""
_CONTENT = "d AS (SELECT f.seg, f.zone, count(*) AS records, sha256(unhex(string_agg(printf('%08x', 4 + octet_length(encode(frame))) || hex(encode(frame)), '' ORDER BY ordinal))) AS digest FROM frames f GROUP BY ALL)"
_CHAIN = 'ch AS (SELECT *, coalesce(lead(base) OVER (ORDER BY base), (SELECT max(record_index) + 1 FROM records)) - 1 AS "end" FROM catalog)'
_DIR = "dirs AS (SELECT seg // 50 AS dir, string_agg(id || ':' || base || ':' || printf('%08x', crc), ',' ORDER BY base) AS directory FROM catalog GROUP BY 1)"
_REPAIR = _CHAIN + """, plan AS (SELECT ch.seg, z.zone, CASE WHEN coalesce(c.finalized AND format_ok AND crc_ok, FALSE) THEN 'none' WHEN c.observation IS NULL THEN 'unreachable'
  WHEN c.observation = 'missing' THEN 'recreate' WHEN c.finalized THEN 'replace' ELSE 'finalize' END AS action
FROM ch CROSS JOIN zones z LEFT JOIN copies c ON c.seg = ch.seg AND c.zone = z.zone WHERE ch."end" >= 320)"""
_BOUNDS = "(1), (2), (5), (10), (25), (50), (100), (250), (500), (1000), (2500), (5000), (10000), (30000)"
_TRACE = "tr AS (" + FIXTURE.format(records="records", faults=FAULT_ROWS) + ")"


def _second(key: str, events: str) -> str:
    """Sequence number at which a second zone has the key."""
    return f"SELECT trace_id, {key}, list_sort(list(s))[2] AS q2 FROM (SELECT trace_id, {key}, zone, min(seq) AS s FROM tr WHERE event IN ({events}) GROUP BY ALL) GROUP BY trace_id, {key}"


_REQ = ", ".join(f"('{e}', '{f}')" for e, fs in REQUIRED.items() for f in fs.split())
_FIELDS = sorted({f for fs in REQUIRED.values() for f in fs.split()})

MONITOR_SQL = {
    "quorum_linearizability": f"""
  SELECT c.trace_id, 'QuorumLinearizability' AS monitor, 'A1' AS assertion, c.seq FROM tr c
  LEFT JOIN ({_second("logical_offset, value, segment", "'RecordPersisted', 'CanonicalPersisted'")}) q USING (trace_id, logical_offset, value, segment)
  WHERE event = 'RecordCommitted' AND (q2 IS NULL OR q2 > c.seq)
  UNION ALL SELECT b.trace_id, 'QuorumLinearizability', 'A2', b.seq FROM tr b
  JOIN (SELECT trace_id, logical_offset, arg_min(value, seq) AS v, arg_min(segment, seq) AS s FROM tr WHERE event = 'RecordCommitted' GROUP BY ALL) a USING (trace_id, logical_offset)
  WHERE b.event = 'RecordCommitted' AND (b.value <> v OR b.segment <> s)
  UNION ALL SELECT trace_id, 'QuorumLinearizability', 'A3', seq FROM (
    SELECT trace_id, seq, logical_offset, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS k
    FROM (SELECT trace_id, logical_offset, min(seq) AS seq FROM tr WHERE event = 'RecordCommitted' GROUP BY ALL)) WHERE k <> logical_offset
  UNION ALL SELECT r.trace_id, 'QuorumLinearizability', 'A4', r.seq FROM tr r JOIN (SELECT trace_id, logical_offset, min(seq) AS c_seq, arg_min(value, seq) AS cv, arg_min(segment, seq) AS cs FROM tr WHERE event = 'RecordCommitted' GROUP BY ALL) c USING (trace_id, logical_offset) WHERE event = 'RecoverySelected' AND c_seq < r.seq AND (cv <> r.value OR cs <> r.segment)
  UNION ALL SELECT d.trace_id, 'QuorumLinearizability', 'A5', d.seq FROM tr d JOIN (SELECT trace_id, logical_offset, min(seq) AS c_seq, arg_min(value, seq) AS cv, arg_min(segment, seq) AS cs FROM tr WHERE event = 'RecordCommitted' GROUP BY ALL) c ON c.trace_id = d.trace_id AND c_seq < d.seq AND cs = d.segment AND c.logical_offset >= d.record_end WHERE event = 'RecoveryCompleted'
  UNION ALL SELECT d.trace_id, 'QuorumLinearizability', 'A6', d.seq FROM tr d JOIN (SELECT trace_id, logical_offset, min(seq) AS c_seq, arg_min(value, seq) AS cv, arg_min(segment, seq) AS cs FROM tr WHERE event = 'RecordCommitted' GROUP BY ALL) c ON c.trace_id = d.trace_id AND c_seq < d.seq AND c.logical_offset >= d.logical_offset AND c.logical_offset < d.record_end WHERE event = 'RecoveryCompleted'
    AND (SELECT arg_max(s.value || ':' || s.segment, s.seq) FROM tr s WHERE s.trace_id = d.trace_id AND s.event = 'RecoverySelected' AND s.writer = d.writer AND s.logical_offset = c.logical_offset AND s.seq < d.seq) IS DISTINCT FROM cv || ':' || cs
  UNION ALL SELECT d.trace_id, 'QuorumLinearizability', 'A7', d.seq FROM tr d JOIN (SELECT trace_id, logical_offset, min(seq) AS c_seq, arg_min(value, seq) AS cv, arg_min(segment, seq) AS cs FROM tr WHERE event = 'RecordCommitted' GROUP BY ALL) c ON c.trace_id = d.trace_id AND c_seq < d.seq AND c.logical_offset >= d.logical_offset AND c.logical_offset < d.record_end AND cs = d.segment WHERE event = 'RecoveryCompleted'
    AND (SELECT count(DISTINCT p.zone) FROM tr p WHERE p.trace_id = d.trace_id AND p.event = 'CanonicalPersisted' AND p.logical_offset = c.logical_offset AND p.value = cv AND p.segment = cs AND p.seq < d.seq) < 2""",
    "single_writer": f"""
  SELECT o.trace_id, 'SingleWriterPerSegment' AS monitor, 'A9' AS assertion, o.seq FROM tr o
  LEFT JOIN ({_second("segment, gen, writer, epoch", "'SegmentCreated'")}) q USING (trace_id, segment, gen, writer, epoch) WHERE event = 'SegmentOpened' AND (q2 IS NULL OR q2 > o.seq)
  UNION ALL SELECT p.trace_id, 'SingleWriterPerSegment', 'A10', p.seq FROM tr p
  JOIN (SELECT trace_id, segment, gen, arg_min(writer, seq) AS w FROM tr WHERE event = 'RecordPersisted' GROUP BY ALL) USING (trace_id, segment, gen) WHERE event = 'RecordPersisted' AND writer <> w
  UNION ALL SELECT trace_id, 'SingleWriterPerSegment', 'A8', q2 FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, segment, gen ORDER BY q2) AS k FROM ({_second("segment, gen, writer, epoch", "'SegmentCreated'")}) WHERE q2 IS NOT NULL) WHERE k > 1""",
    "seal_safety": f"""
  SELECT s.trace_id, 'SealAndPrefixSafety' AS monitor, 'A11' AS assertion, s.seq FROM tr s
  LEFT JOIN ({_second("segment, record_end", "'SegmentFinalized'")}) q USING (trace_id, segment, record_end) WHERE event = 'SegmentSealed' AND (q2 IS NULL OR q2 > s.seq)
  UNION ALL SELECT trace_id, 'SealAndPrefixSafety', 'A12', seq FROM (
    SELECT s.trace_id, s.seq, s.segment, s.record_end, count(DISTINCT f.logical_offset) AS k FROM tr s
    LEFT JOIN tr f ON f.trace_id = s.trace_id AND f.event IN ('RecordFormed', 'RecoverySelected') AND f.seq < s.seq AND f.logical_offset BETWEEN s.segment AND s.record_end
    WHERE s.event = 'SegmentSealed' GROUP BY ALL) WHERE k <> record_end - segment + 1
  UNION ALL SELECT x.trace_id, 'SealAndPrefixSafety', 'A13', x.seq FROM tr x WHERE event = 'SealedCopyRepaired'
    AND (SELECT arg_max(s.record_end, s.seq) FROM tr s WHERE s.trace_id = x.trace_id AND s.event = 'SegmentSealed' AND s.segment = x.segment AND s.seq < x.seq) IS DISTINCT FROM x.record_end""",
    "startup_replay": """
  SELECT f.trace_id, 'StartupReplayAndTruncation' AS monitor, 'A14' AS assertion, f.seq FROM tr f WHERE event = 'RecordFormed'
    AND (SELECT count(*) FILTER (event = 'ReplayOpened') - count(*) FILTER (event = 'ReplayClosed') FROM tr x WHERE x.trace_id = f.trace_id AND x.seq < f.seq) > 0
  UNION ALL SELECT c.trace_id, 'StartupReplayAndTruncation', 'A17', c.seq FROM tr c
    LEFT JOIN tr f ON f.trace_id = c.trace_id AND f.event = 'RecordFormed' AND f.logical_offset = c.logical_offset AND f.seq < c.seq
    WHERE c.event = 'RecordCommitted' AND (f.value IS NULL OR f.value <> c.value OR f.segment <> c.segment)
  UNION ALL SELECT trace_id, 'StartupReplayAndTruncation', 'A18', seq FROM (
    SELECT c.trace_id, c.seq, c.logical_offset, count(DISTINCT p.logical_offset) AS k FROM tr c LEFT JOIN tr p ON p.trace_id = c.trace_id AND p.event = 'RecordCommitted' AND p.seq < c.seq
    WHERE c.event = 'RecordCommitted' GROUP BY ALL) WHERE k <> logical_offset
  UNION ALL SELECT a.trace_id, 'StartupReplayAndTruncation', 'A19', a.seq FROM tr a WHERE a.event = 'ProducerAcknowledged'
    AND (NOT EXISTS (SELECT 1 FROM tr c WHERE c.trace_id = a.trace_id AND c.event = 'RecordCommitted' AND c.logical_offset = a.logical_offset AND c.seq < a.seq)
      OR EXISTS (SELECT 1 FROM tr b WHERE b.trace_id = a.trace_id AND b.event = 'ProducerAcknowledged' AND b.logical_offset = a.logical_offset AND b.seq < a.seq))
  UNION ALL SELECT f.trace_id, 'StartupReplayAndTruncation', 'A15', f.seq FROM tr f WHERE f.event = 'RecordFormed' AND EXISTS (SELECT 1 FROM tr g WHERE g.trace_id = f.trace_id AND g.event IN ('RecordFormed', 'RecoverySelected') AND g.logical_offset = f.logical_offset AND g.seq < f.seq)
  UNION ALL SELECT f.trace_id, 'StartupReplayAndTruncation', 'A16', f.seq FROM tr f WHERE f.event = 'RecoverySelected'
    AND (SELECT arg_min(g.value || ':' || g.segment, g.seq) FROM tr g WHERE g.trace_id = f.trace_id AND g.event IN ('RecordFormed', 'RecoverySelected') AND g.logical_offset = f.logical_offset AND g.seq < f.seq) <> f.value || ':' || f.segment
  UNION ALL SELECT p.trace_id, 'StartupReplayAndTruncation', 'A20', p.seq FROM tr p WHERE p.event = 'TruncationProposed'
    AND ((SELECT count(*) FILTER (event = 'ReplayOpened') - count(*) FILTER (event = 'ReplayClosed') FROM tr x WHERE x.trace_id = p.trace_id AND x.seq < p.seq) > 0
      OR p.truncation_floor < (SELECT max(truncation_floor) FROM tr x WHERE x.trace_id = p.trace_id AND x.event = 'SegmentDeleted' AND x.seq < p.seq))
  UNION ALL SELECT d.trace_id, 'StartupReplayAndTruncation', 'A21', d.seq FROM tr d WHERE d.event = 'SegmentDeleted' AND (d.record_end >= d.truncation_floor
    OR (SELECT arg_max(s.record_end, s.seq) FROM tr s WHERE s.trace_id = d.trace_id AND s.event = 'SegmentSealed' AND s.segment = d.segment AND s.seq < d.seq) IS DISTINCT FROM d.record_end)
  UNION ALL SELECT o.trace_id, 'StartupReplayAndTruncation', 'A22', o.seq FROM tr o WHERE o.event = 'ReplayOpened' AND (o.logical_offset > o.record_end
    OR (SELECT count(*) FILTER (event = 'ReplayOpened') - count(*) FILTER (event = 'ReplayClosed') FROM tr x WHERE x.trace_id = o.trace_id AND x.reader = o.reader AND x.seq < o.seq) > 0
    OR o.logical_offset < (SELECT max(truncation_floor) FROM tr x WHERE x.trace_id = o.trace_id AND x.event = 'SegmentDeleted' AND x.seq < o.seq)
    OR o.record_end > (SELECT count(DISTINCT logical_offset) FROM tr x WHERE x.trace_id = o.trace_id AND x.event IN ('RecordFormed', 'RecoverySelected') AND x.seq < o.seq))
  UNION ALL SELECT trace_id, 'StartupReplayAndTruncation', CASE WHEN event = 'ReplayRecord' THEN 'A23' ELSE 'A24' END, seq FROM (
    SELECT r.*, o.logical_offset AS b, o.record_end AS e,
      (SELECT count(*) FROM tr x WHERE x.trace_id = r.trace_id AND x.event = 'ReplayRecord' AND x.reader = r.reader AND x.seq > o.seq AND x.seq < r.seq) AS n,
      (SELECT count(*) FROM tr x WHERE x.trace_id = r.trace_id AND x.event = 'ReplayClosed' AND x.reader = r.reader AND x.seq > o.seq AND x.seq < r.seq) AS closed,
      (SELECT count(*) FROM tr x WHERE x.trace_id = r.trace_id AND x.event IN ('RecordFormed', 'RecoverySelected') AND x.logical_offset = r.logical_offset AND x.seq < r.seq) AS formed
    FROM (SELECT *, (SELECT max(o.seq) FROM tr o WHERE o.trace_id = y.trace_id AND o.event = 'ReplayOpened' AND o.reader = y.reader AND o.seq < y.seq) AS o_seq FROM tr y WHERE event IN ('ReplayRecord', 'ReplayClosed')) r
    LEFT JOIN tr o ON o.trace_id = r.trace_id AND o.seq = r.o_seq)
  WHERE b IS NULL OR closed > 0 OR CASE WHEN event = 'ReplayRecord' THEN logical_offset <> b + n OR logical_offset >= e OR formed = 0 ELSE b + n <> e END""",
    "size_excludes_open_tail": "SELECT trace_id, 'GetSizeExcludesOpenTail' AS monitor, 'A25' AS assertion, seq FROM tr WHERE event = 'GetSizeObserved' AND NOT (finalized OR reported_size = 0)",
    "manifest_safety": """
  SELECT f.trace_id, 'ManifestSafety' AS monitor, 'A30' AS assertion, f.seq FROM tr f
  WHERE event = 'FloorCommitted' AND truncation_floor < (SELECT coalesce(max(truncation_floor), 0) FROM tr x WHERE x.trace_id = f.trace_id AND x.event = 'FloorCommitted' AND x.seq < f.seq)
  UNION ALL SELECT d.trace_id, 'ManifestSafety', 'A30', d.seq FROM tr d
  WHERE event = 'SegmentDeleted' AND truncation_floor > (SELECT coalesce(max(truncation_floor), 0) FROM tr x WHERE x.trace_id = d.trace_id AND x.event = 'FloorCommitted' AND x.seq < d.seq)
  UNION ALL SELECT v.trace_id, 'ManifestSafety', 'A29', v.seq FROM tr v WHERE event = 'ViewCommitted' AND (record_end <> logical_offset
      OR NOT EXISTS (SELECT 1 FROM tr c WHERE c.trace_id = v.trace_id AND c.event = 'EpochClaimed' AND c.epoch = v.epoch AND c.seq < v.seq)
      OR EXISTS (SELECT 1 FROM tr p WHERE p.trace_id = v.trace_id AND p.event = 'ViewCommitted' AND p.seq < v.seq AND p.logical_offset > v.logical_offset)
      OR (SELECT arg_min(p.record_end || ':' || p.value, p.seq) FROM tr p WHERE p.trace_id = v.trace_id AND p.event = 'ViewCommitted' AND p.segment = v.segment AND p.seq <= v.seq) <> v.record_end || ':' || v.value)
  UNION ALL SELECT trace_id, 'ManifestSafety', 'A28', seq FROM (SELECT trace_id, seq, row_number() OVER (PARTITION BY trace_id, epoch ORDER BY seq) AS k FROM tr WHERE event = 'EpochClaimed') WHERE k > 1
  UNION ALL SELECT s.trace_id, 'ManifestSafety', 'A30', s.seq FROM tr s WHERE s.event = 'SegmentSealed'
    AND (SELECT arg_max(v.record_end, v.seq) FROM tr v WHERE v.trace_id = s.trace_id AND v.event = 'ViewCommitted' AND v.segment = s.segment AND v.seq < s.seq) IS DISTINCT FROM s.record_end + 1""",
    "directory_structure": """
  SELECT d.trace_id, 'DirectoryStructure' AS monitor, 'A26' AS assertion, d.seq FROM (
    SELECT *, (SELECT max(b.seq) FROM tr b WHERE b.trace_id = y.trace_id AND b.writer = y.writer AND b.event = 'DirectoryAdopted' AND b.directory_index = 0 AND b.seq <= y.seq) AS head,
      (SELECT max(b.seq) FROM tr b WHERE b.trace_id = y.trace_id AND b.writer = y.writer AND b.event = 'DirectoryAdopted' AND b.seq < y.seq) AS last FROM tr y WHERE event = 'DirectoryAdopted') d
  LEFT JOIN tr h ON h.trace_id = d.trace_id AND h.seq = d.head LEFT JOIN tr l ON l.trace_id = d.trace_id AND l.seq = d.last
  WHERE d.directory_len <= 0 OR d.directory_index NOT BETWEEN 0 AND d.directory_len - 1 OR h.seq IS NULL OR d.directory_len <> h.directory_len OR d.segment >= d.tail_base
    OR d.directory_index <> (SELECT count(*) FROM tr x WHERE x.trace_id = d.trace_id AND x.writer = d.writer AND x.event = 'DirectoryAdopted' AND x.seq >= d.head AND x.seq < d.seq)
    OR (d.directory_index = 0 AND l.directory_index + 1 <> l.directory_len) OR (d.directory_index > 0 AND l.segment >= d.segment)
    OR EXISTS (SELECT 1 FROM tr x WHERE x.trace_id = d.trace_id AND x.writer = d.writer AND x.event = 'DirectoryAdopted' AND x.segment_id = d.segment_id AND x.seq >= d.head AND x.seq < d.seq)
    OR (d.directory_index + 1 = d.directory_len AND d.tail_base > d.truncation_floor AND (d.segment IS DISTINCT FROM d.seal_base OR d.segment_id IS DISTINCT FROM d.current_seal_id))""",
    "directory_enforcement": """
  SELECT d.trace_id, 'DirectoryEnforcement' AS monitor, 'A27' AS assertion, d.seq FROM tr d WHERE event = 'DirectoryAdopted' AND segment_id <> current_seal_id
    AND NOT EXISTS (SELECT 1 FROM tr e WHERE e.trace_id = d.trace_id AND e.event = 'SealQuorumEnforced' AND e.segment = d.segment AND e.segment_id = d.segment_id AND e.record_end = d.record_end AND e.seq < d.seq)""",
}
_ALL = ", ".join(f"m{i} AS ({s})" for i, s in enumerate(MONITOR_SQL.values()))

ORACLE = {
    "frame_encode": _q("SELECT record_index, encoded_len, printf('%08x', encoded_len) || lower(hex(encode(payload))) AS frame_hex FROM records"),
    "segment_boundaries": _q("SELECT seg, record_index, record_end FROM ends"),
    "chain_ends": _q('SELECT seg, base, "end" FROM ch', _CHAIN),
    "directory_encode": _q("SELECT dir, directory FROM dirs", _DIR),
    "directory_decode": _q("SELECT seg // 50 AS dir, row_number() OVER (PARTITION BY seg // 50 ORDER BY base) - 1 AS pos, id, base, crc, TRUE AS valid FROM catalog"),
    "segment_id_codec": _q("SELECT CASE WHEN seg % 13 = 0 THEN 'short-' || seg ELSE printf('%016x-%08x', seg // 7, seg) END AS id, CASE WHEN seg % 13 > 0 THEN seg // 7 END AS epoch FROM segments"),
    "quorum_watermark": _q("SELECT seg, watermark FROM wm", _WM),
    "commit_resolution": _q("SELECT * FROM res", _RES),
    "streaming_commit": _q("SELECT * FROM res", _RES),
    "commit_feasibility": _q(_FEASIBLE, _WM),
    "durable_lag": _q("SELECT seg, zone, CASE WHEN finished THEN 0 ELSE greatest(represented_end - durable, 0) END AS lag FROM lanes"),
    "lane_progress_merge": _q("SELECT seg, zone, seq, max(durable) OVER (PARTITION BY seg, zone ORDER BY seq ROWS UNBOUNDED PRECEDING) AS durable FROM progress"),
    "ack_through": _q("SELECT l.seg, zone, count(*) FILTER (record_end <= durable) AS acked FROM lanes l JOIN ends e ON e.seg = l.seg GROUP BY ALL"),
    "resend_suffix": _q("""SELECT seg, zone, record_index, greatest(d - record_end + encoded_len, 0) AS skip, encoded_len - greatest(d - record_end + encoded_len, 0) AS bytes
FROM (SELECT e.*, zone, greatest(durable - 3, 0) AS d FROM ends e JOIN lanes l ON l.seg = e.seg) WHERE record_end > d"""),
    "recovery_size": _q("SELECT * FROM rec", _REC),
    "candidate_class": _q("""SELECT c.seg, CASE WHEN count(*) < 2 THEN 'NoQuorum' WHEN bool_and(observation = 'missing') THEN 'Absent' WHEN max(rec.size) = 0 THEN 'Empty' ELSE 'NonEmpty' END AS class,
  count(*) FILTER (observation = 'live' AND s.size = 0) = 3 AS reusable FROM copies c JOIN sizes s ON s.seg = c.seg AND s.zone = c.zone JOIN rec ON rec.seg = c.seg GROUP BY c.seg""", _REC),
    "canonical_prefix": _q("SELECT seg, len, zones, conflict_at, bytes, discarded FROM canon", _CANON),
    "exact_finalized_group": _q("""SELECT d.seg, count(*) AS copies, records, digest FROM d JOIN copies c ON c.seg = d.seg AND c.zone = d.zone AND c.finalized AND c.format_ok
WHERE d.seg % 2 = 1 OR records = c.n GROUP BY d.seg, records, digest HAVING count(*) >= 2""", _CONTENT),
    "stat_quorum": _q("SELECT seg, count(*) FILTER (finalized AND format_ok AND crc_ok) AS matching, count(*) FILTER (finalized AND format_ok AND crc_ok) >= 2 AS adopted FROM copies GROUP BY seg"),
    "sealed_read_choice": _q("""SELECT s.seg, z.zone, CASE WHEN z.zone IS NOT NULL THEN 'zone' WHEN v.k IS NULL OR v.k < 2 THEN 'NoReadQuorum' WHEN v.contents > 1 AND v.k = 2 THEN 'ConflictingPrefix' ELSE 'canonical' END AS source
FROM (SELECT DISTINCT seg FROM copies) s LEFT JOIN (SELECT seg, min(zone) AS zone FROM copies WHERE finalized AND format_ok AND crc_ok AND n_copy = n GROUP BY seg) z USING (seg)
LEFT JOIN (SELECT c.seg, count(*) AS k, count(DISTINCT digest) AS contents FROM copies c JOIN d ON d.seg = c.seg AND d.zone = c.zone WHERE finalized AND format_ok AND n_copy = n GROUP BY c.seg) v USING (seg)""", _CONTENT),
    "quorum_formed": _q("SELECT seg, ordinal, array_to_string(list_sort(list(DISTINCT zone))[1:2], ',') AS zones FROM frames GROUP BY seg, ordinal, frame HAVING count(DISTINCT zone) >= 2"),
    "segment_sha256": _q("SELECT seg, zone, digest FROM d", _CONTENT),
    "record_value": _q("SELECT record_index, CAST(CAST('0x' || substr(sha256(unhex(printf('%08x', encoded_len)) || encode(payload)), 1, 16) AS UBIGINT) AS VARCHAR) AS value FROM records"),
    "replay_range": _q("SELECT record_index, payload FROM records WHERE record_index >= (SELECT (max(record_index) + 1) // 3 FROM records) AND record_index < (SELECT max(record_index) - 6 FROM records)"),
    "replay_dense_check": _q('SELECT n // 3 AS "from", n + 5 AS "end", CAST(5 AS BIGINT) AS missing FROM (SELECT max(record_index) + 1 AS n FROM records)'),
    "checkpoint_guards": _q("SELECT base AS checkpoint, CASE WHEN base < 320 THEN 'below_floor' WHEN base < 450 THEN 'gap' WHEN base > 800 THEN 'past_end' END AS violation FROM segments"),
    "tombstones": _q('SELECT seg FROM ch WHERE "end" < 320', _CHAIN),
    "repair_plan": _q("SELECT * FROM plan", _REPAIR),
    "repair_report": _q("SELECT action, count(*) AS copies FROM plan GROUP BY action", _REPAIR),
    "truncate_plan": _q("""SELECT ch.seg, count(*) FILTER (observation = 'missing') AS absent, count(*) FILTER (observation = 'missing') >= 2 AS leave_chain, count(*) FILTER (observation = 'missing') = 3 AS leave_directory
FROM ch LEFT JOIN copies c ON c.seg = ch.seg WHERE "end" < 720 GROUP BY ch.seg""", _CHAIN),
    "dead_sweep": _q("SELECT DISTINCT id FROM copies c JOIN catalog k ON k.seg = c.seg WHERE observation <> 'missing' AND format_ok AND c.seg % 4 = 0 AND c.seg // 7 < (SELECT max(seg) // 7 FROM segments)"),
    "maintenance_coalesce": _q("""SELECT seg AS queue, CAST(g AS BIGINT) AS "group", max(CASE WHEN kind = 't' THEN record_index * 13 % 1009 END) AS floor, count(DISTINCT CASE WHEN kind = 'r' THEN ordinal % 7 END) AS repairs
FROM (SELECT *, sum(CASE WHEN ordinal % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS g, CASE WHEN ordinal % 17 = 0 THEN 's' WHEN ordinal % 3 = 0 THEN 't' ELSE 'r' END AS kind FROM records) GROUP BY seg, g"""),
    "in_order_completion": _q("""SELECT record_index, CASE WHEN first IS NULL OR record_index < first THEN 'Done' WHEN st.status IN ('Committed', 'Pending') THEN 'Pending' WHEN record_index = first THEN st.status ELSE 'Poisoned' END AS outcome
FROM (SELECT record_index, min(CASE WHEN ordinal >= committed THEN record_index END) OVER (PARTITION BY seg // 10) AS first FROM records JOIN res USING (seg)) LEFT JOIN st ON st.seg = first // 100""", _RES + ", st AS (" + _FEASIBLE + ")"),
    "stall_gaps": _q("SELECT seg, zone, seq, gap FROM (SELECT seg, zone, seq, seq - lag(seq) OVER (PARTITION BY seg, zone ORDER BY seq) AS gap FROM progress WHERE (seq // 30) % 7 <> 3) WHERE gap > 30"),
    "rotation_due": _q("SELECT seg, committed > 0 AND committed_bytes >= 1500 AS due FROM res", _RES),
    "greedy_segments": "WITH RECURSIVE " + ORACLE_TABLES + """, o AS (SELECT seg // 10 AS log, record_index, encoded_len, row_number() OVER (PARTITION BY seg // 10 ORDER BY record_index) AS k FROM records),
  f AS (SELECT log, k, record_index, CAST(encoded_len AS BIGINT) AS total, CAST(0 AS BIGINT) AS s FROM o WHERE k = 1
    UNION ALL SELECT o.log, o.k, o.record_index, CASE WHEN f.total >= 1000 THEN 0 ELSE f.total END + o.encoded_len, f.s + CASE WHEN f.total >= 1000 THEN 1 ELSE 0 END FROM f JOIN o ON o.log = f.log AND o.k = f.k + 1)
SELECT log, s AS seg, min(record_index) AS base, max(record_index) AS "end", max(total) AS bytes FROM f GROUP BY log, s""",
    "packed_messages": "WITH RECURSIVE " + ORACLE_TABLES + """,
  f AS (SELECT seg, ordinal, encoded_len AS total, CAST(0 AS BIGINT) AS message FROM records WHERE ordinal = 0
    UNION ALL SELECT r.seg, r.ordinal, CASE WHEN f.total + r.encoded_len > 256 THEN 0 ELSE f.total END + r.encoded_len, f.message + CASE WHEN f.total + r.encoded_len > 256 THEN 1 ELSE 0 END FROM f JOIN records r ON r.seg = f.seg AND r.ordinal = f.ordinal + 1)
SELECT seg, message, max(total) AS bytes FROM f GROUP BY seg, message""",
    "trace_structure": _q("""SELECT trace_id, seq, CASE WHEN event = 'Nonsense' THEN 'unknown_event' ELSE 'gap' END AS problem FROM (
  SELECT *, seq - lag(seq) OVER (PARTITION BY trace_id ORDER BY seq) AS gap FROM (SELECT trace_id, seq, CASE WHEN trace_id % 10 = 4 AND seq = 9 THEN 'Nonsense' ELSE event END AS event FROM tr WHERE NOT (trace_id % 10 = 3 AND seq = 17)))
WHERE event = 'Nonsense' OR gap > 1""", _TRACE),
    "trace_field_rules": _q("SELECT trace_id, seq, x.event, field FROM x JOIN need n ON n.event = x.event WHERE CASE field " + " ".join(f"WHEN '{f}' THEN {f} IS NULL" for f in _FIELDS) + " END",
        _TRACE + f", need(event, field) AS (VALUES {_REQ}), x AS (SELECT * REPLACE (CASE WHEN trace_id % 10 = 2 AND seq % 50 = 10 THEN NULL ELSE value END AS value) FROM tr)"),
    **{f"monitor_{n}": _q(s, _TRACE) for n, s in MONITOR_SQL.items()},
    "trace_verdict": _q("""SELECT t.trace_id, v.seq IS NULL AS accepted, v.monitor, v.seq FROM (SELECT DISTINCT trace_id FROM tr) t LEFT JOIN (
  SELECT trace_id, monitor, seq, row_number() OVER (PARTITION BY trace_id ORDER BY seq, rank) AS k FROM (""" + " UNION ALL ".join(f"SELECT {i} AS rank, * FROM m{i}" for i in range(8)) + ")) v ON v.trace_id = t.trace_id AND k = 1", _TRACE + ", " + _ALL),
    "trace_determinism": _q("SELECT trace_id, min(seq) FILTER (trace_id % 3 = 1 AND seq >= 40 AND value IS NOT NULL) AS seq FROM tr GROUP BY trace_id", _TRACE),
    "metric_rollup": _q("""SELECT kind, name, CAST(CASE kind WHEN 'gauge' THEN arg_max(value, seq) WHEN 'high_water' THEN max(value) ELSE sum(value) END AS BIGINT) AS value FROM (
  SELECT record_index AS seq, ['counter', 'gauge', 'updown', 'high_water'][seg % 4 + 1] AS kind, 'm' || seg % 20 AS name, record_index * 37 % 101 - CASE WHEN seg % 4 = 2 THEN 50 ELSE 0 END AS value FROM records) GROUP BY kind, name"""),
    "metric_histogram": _q(f"SELECT seg % 20 AS zone, (SELECT count(*) FROM (VALUES {_BOUNDS}) b(x) WHERE x < record_index * 7919 % 40000) AS bucket, count(*) AS n FROM records GROUP BY ALL"),
    "latency_report": _q("""SELECT run, quantile_disc(us, 0.5) AS p50, quantile_disc(us, 0.99) AS p99, quantile_disc(us, 0.999) AS p999, max(us) AS max, round(sum(us) / count(*), 6) AS mean
FROM (SELECT seg % 20 AS run, least(greatest(record_index * 7919 % 40009, 1), 599000000) AS us FROM records) GROUP BY run"""),
    "hdr_buckets": _q("""SELECT us // w * w + w - 1 AS highest, count(*) AS n FROM (SELECT us, CAST(1 << greatest(length(printf('%b', us)) - 11, 0) AS BIGINT) AS w FROM (
  SELECT greatest(record_index * 7919 % 400009, 1) AS us FROM records)) GROUP BY 1"""),
    "append_report": _q("SELECT CAST(sum(committed) AS BIGINT) AS committed, sum(committed) / 30 AS iops, round((SELECT sum(encoded_len) FROM records) / sum(committed_bytes), 9) AS write_amplification FROM res", _RES),
    "open_loop_schedule": _q("SELECT record_index AS i, record_index * 200 AS send_us, record_index * 10 + record_index * 31 % 977 AS latency_us FROM records"),
    "suite_matrix": """SELECT 'append' AS bench, b || '/' || s AS config, CAST(4096 AS BIGINT) AS arg FROM (VALUES ('log'), ('disk0'), ('disk1'), ('disk2')) x(b), (VALUES ('qd1'), ('rate10'), ('loaded'), ('tput')) y(s)
UNION ALL SELECT 'recovery_replay', 'log/replay', n FROM (VALUES (0), (1000), (10000), (100000)) z(n) UNION ALL SELECT 'recovery_segments', 'log/segments', n FROM (VALUES (0), (1), (4), (16), (64)) z(n)""",
    "phase_deck": "SELECT seed, phase, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN seed = 0 THEN printf('%02d', phase) ELSE sha256(seed || '|' || phase) END) - 1 AS pos FROM range(200) a(seed), range(16) b(phase)",
    "fault_budget": "SELECT seed, fault, CAST(sum(CASE WHEN substr(sha256(seed || '|' || fault), 1, 1) < '8' THEN 1 ELSE 2 END) OVER (PARTITION BY seed ORDER BY fault ROWS UNBOUNDED PRECEDING) AS BIGINT) AS opportunity FROM range(200) a(seed), range(8) b(fault)",
    "generation_ordinal": _q("SELECT seg % 10 AS base, seg AS id, seg // 10 AS gen FROM segments"),
}

assert set(IGNORED) < set(EVENTS)
