"""Trace conformance: structural rules and the eight monitors, each a set of relational assertions.

Every violation is a row (trace_id, monitor, assertion, seq); the verdict of a trace is its earliest one, ties by the
monitors' order. All windows are within a trace, ordered by seq. A key's quorum is reached at the second smallest of
its zones' first sequence numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.traces import EVENTS, IGNORED, REQUIRED

T = "trace_id"


def structure(trace: DataFrame) -> DataFrame:
    """Unknown names, and gaps in seq (from any start)."""
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy(T).orderBy("seq"))
    p = F.when(~F.col("event").isin(*EVENTS), "unknown_event").when(gap != 1, "gap")
    return trace.withColumn("problem", p).where("problem IS NOT NULL").select(T, "seq", "problem")


def field_rules(trace: DataFrame) -> DataFrame:
    """Required fields that are null, one row each, of observed events."""
    need = F.create_map(*[x for e, fs in REQUIRED.items() for x in (F.lit(e), F.array(*map(F.lit, fs.split())))])
    have = F.create_map(*[x for c in sorted({c for fs in REQUIRED.values() for c in fs.split()}) for x in (F.lit(c), F.col(c).isNotNull())])
    rows = trace.where(~F.col("event").isin(*IGNORED)).select(T, "seq", "event", F.explode(need[F.col("event")]).alias("field"), have.alias("have"))
    return rows.where(~F.col("have")[F.col("field")]).select(T, "seq", "event", "field")


def _of(trace, *names):
    return trace.where(F.col("event").isin(*names))


def _out(df, monitor, assertion):
    return df.select(T, F.lit(monitor).alias("monitor"), F.lit(assertion).alias("assertion"), "seq")


def _quorum_at(rows: DataFrame, key: list[str]) -> DataFrame:
    first = rows.groupBy(T, *key, "zone").agg(F.min("seq").alias("s"))
    return first.groupBy(T, *key).agg(F.get(F.sort_array(F.collect_list("s")), F.lit(1)).alias("q2"))


def _w(*by):
    return Window.partitionBy(T, *by).orderBy("seq")


def _late(rows: DataFrame, quorum: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no quorum before them."""
    return rows.join(quorum, [T, *key], "left").where("q2 IS NULL OR q2 > seq")


def _as_of(trace: DataFrame, name: str, key: list[str], value, alias: str) -> DataFrame:
    """Each row with the value of the latest `name` event of its key before it."""
    w = _w(*key).rowsBetween(Window.unboundedPreceding, -1)
    return trace.withColumn(alias, F.last(F.when(F.col("event") == name, value), ignorenulls=True).over(w))


def _within(rows: DataFrame, known: DataFrame, first: str, last, keep: list[str]) -> DataFrame:
    """`rows` once for each offset from `first` to `last` that lies within the trace's known offsets."""
    span = known.groupBy(T).agg(F.min("logical_offset").alias("_lo"), F.max("logical_offset").alias("_hi"))
    r = rows.join(span, T).withColumns({"_a": F.greatest(F.col(first), F.col("_lo")), "_b": F.least(last, F.col("_hi"))}).where("_a <= _b")
    return r.select(*keep, F.explode(F.sequence("_a", "_b")).alias("logical_offset"))


def quorum_linearizability(trace: DataFrame) -> DataFrame:
    m = "QuorumLinearizability"
    rec = ["logical_offset", "value", "segment"]
    commits = _of(trace, "RecordCommitted")
    ident = F.struct("value", "segment")
    first = commits.withColumn("first", F.first(ident).over(_w("logical_offset"))).withColumn("nth", F.row_number().over(_w("logical_offset")))
    order = first.where("nth = 1").withColumn("expected", F.row_number().over(_w()) - 1)
    known = first.where("nth = 1").select(T, "logical_offset", F.col("seq").alias("c_seq"), F.col("segment").alias("c_segment"), F.struct("value", "segment").alias("c"))
    sel = _of(trace, "RecoverySelected")
    done = _of(trace, "RecoveryCompleted").select(T, "seq", "writer", "segment", F.col("logical_offset").alias("start"), "record_end")
    # committed records of the recovered segment, by segment; those in the recovered range, by offset
    on = (F.col(f"d.{T}") == F.col(f"k.{T}")) & (F.col("d.segment") == F.col("k.c_segment")) & (F.col("k.c_seq") < F.col("d.seq"))
    reach = done.alias("d").join(known.alias("k"), on).select(f"d.{T}", "d.seq", "logical_offset", "record_end")
    each = _within(done, known, "start", F.col("record_end") - 1, [T, "seq", "writer", "segment"])
    s = sel.select(T, "writer", "logical_offset", F.col("seq").alias("s_seq"), F.struct("value", "segment").alias("s"))
    inside = each.join(known, [T, "logical_offset"]).where("c_seq < seq")
    latest = inside.join(s, [T, "writer", "logical_offset"], "left").groupBy(T, "seq", "logical_offset").agg(F.max_by("s", F.when(F.col("s_seq") < F.col("seq"), F.col("s_seq"))).alias("s"), F.first("c").alias("c"))
    canon = _quorum_at(_of(trace, "CanonicalPersisted"), rec)
    need = inside.where("segment = c_segment").select(T, "seq", "logical_offset", F.col("c.value").alias("value"), F.col("c.segment").alias("segment"))
    return _all(
        _out(_late(commits, _quorum_at(_of(trace, "RecordPersisted", "CanonicalPersisted"), rec), rec), m, "A1"),
        _out(first.where(F.col("first") != ident), m, "A2"),
        _out(order.where("logical_offset <> expected"), m, "A3"),
        _out(sel.join(known, [T, "logical_offset"]).where((F.col("c_seq") < F.col("seq")) & (F.col("c") != ident)), m, "A4"),
        _out(reach.where("logical_offset >= record_end"), m, "A5"),
        _out(latest.where(F.col("s").isNull() | (F.col("s") != F.col("c"))), m, "A6"),
        _out(_late(need, canon, rec), m, "A7"),
    )


def single_writer(trace: DataFrame) -> DataFrame:
    m, ident = "SingleWriterPerSegment", ["segment", "gen", "writer", "epoch"]
    q = _quorum_at(_of(trace, "SegmentCreated"), ident)
    ranked = q.where("q2 IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy(T, "segment", "gen").orderBy("q2")))
    p = _of(trace, "RecordPersisted").withColumn("first", F.first("writer").over(_w("segment", "gen")))
    return _all(_out(ranked.where("nth > 1").withColumn("seq", F.col("q2")), m, "A8"), _out(_late(_of(trace, "SegmentOpened"), q, ident), m, "A9"), _out(p.where("writer <> first"), m, "A10"))


def seal_safety(trace: DataFrame) -> DataFrame:
    m = "SealAndPrefixSafety"
    sealed = _of(trace, "SegmentSealed")
    known = _of(trace, "RecordFormed", "RecoverySelected").groupBy(T, "logical_offset").agg(F.min("seq").alias("k_seq"))
    key = [T, "seq", "segment", "record_end"]
    each = _within(sealed, known, "segment", F.col("record_end"), key).join(known, [T, "logical_offset"]).where("k_seq < seq")
    counted = sealed.select(*key).join(each.groupBy(*key).agg(F.count("*").alias("k")), key, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    fixed = _as_of(_of(trace, "SegmentSealed", "SealedCopyRepaired"), "SegmentSealed", ["segment"], F.col("record_end"), "sealed_end").where("event = 'SealedCopyRepaired'")
    return _all(
        _out(_late(sealed, _quorum_at(_of(trace, "SegmentFinalized"), ["segment", "record_end"]), ["segment", "record_end"]), m, "A11"),
        _out(counted.where("k <> record_end - segment + 1"), m, "A12"),
        _out(fixed.where("sealed_end IS NULL OR sealed_end <> record_end"), m, "A13"),
    )


def startup_replay(trace: DataFrame) -> DataFrame:
    m = "StartupReplayAndTruncation"
    upto = lambda *by: _w(*by).rowsBetween(Window.unboundedPreceding, -1)
    names = ("RecordFormed", "RecoverySelected", "RecordCommitted", "ProducerAcknowledged", "SegmentSealed", "TruncationProposed", "SegmentDeleted", "ReplayOpened", "ReplayRecord", "ReplayClosed")
    t = _of(trace, *names)
    is_ = lambda n: F.col("event") == n
    opened = F.coalesce(F.sum(F.when(is_("ReplayOpened"), 1).when(is_("ReplayClosed"), -1).otherwise(0)).over(upto()), F.lit(0))
    makes = F.col("event").isin("RecordFormed", "RecoverySelected")
    ident = F.struct("value", "segment")
    # one pass over each trace: readers open, the floor, what an offset was formed as and how often
    s = t.withColumns(
        {
            "open": opened, "floor": F.coalesce(F.max(F.when(is_("SegmentDeleted"), F.col("truncation_floor"))).over(upto()), F.lit(0)),
        }
    ).withColumns(
        {
            "formed": F.first(F.when(makes, ident), ignorenulls=True).over(upto("logical_offset")),
            "committed_before": F.count_if(is_("RecordCommitted")).over(upto("logical_offset")), "acks": F.count_if(is_("ProducerAcknowledged")).over(upto("logical_offset")),
        }
    )
    s = s.withColumn("formed_n", F.coalesce(F.sum((makes & F.col("formed").isNull()).cast("long")).over(upto()), F.lit(0)))
    commits = s.where(is_("RecordCommitted"))
    fresh = commits.withColumn("done", F.coalesce(F.sum((F.col("committed_before") == 0).cast("long")).over(upto()), F.lit(0)))
    active = F.coalesce(F.sum(F.when(is_("ReplayOpened"), 1).when(is_("ReplayClosed"), -1).otherwise(0)).over(upto("reader")), F.lit(0))
    opens = s.withColumn("active", active).where(is_("ReplayOpened")).where("active > 0 OR floor > logical_offset OR logical_offset > record_end OR record_end > formed_n")
    rp = s.where(F.col("event").isin("ReplayOpened", "ReplayRecord", "ReplayClosed"))
    rp = rp.withColumn("session", F.count_if(is_("ReplayOpened")).over(_w("reader").rowsBetween(Window.unboundedPreceding, 0)))
    head = rp.where(is_("ReplayOpened")).select(T, "reader", "session", F.col("logical_offset").alias("start"), F.col("record_end").alias("stop"))
    body = rp.where(~is_("ReplayOpened")).join(head, [T, "reader", "session"], "left")
    upto_session = _w("reader", "session").rowsBetween(Window.unboundedPreceding, -1)
    body = body.withColumns({"read": F.coalesce(F.count_if(is_("ReplayRecord")).over(upto_session), F.lit(0)), "closed": F.coalesce(F.count_if(is_("ReplayClosed")).over(upto_session), F.lit(0)) > 0})
    wrong = body.where(is_("ReplayRecord")).where("start IS NULL OR closed OR logical_offset <> start + read OR logical_offset >= stop OR formed IS NULL")
    seals = _as_of(t.where(F.col("event").isin("SegmentSealed", "SegmentDeleted")), "SegmentSealed", ["segment"], F.col("record_end"), "sealed_end").where(is_("SegmentDeleted"))
    return _all(
        _out(s.where(is_("RecordFormed") & (F.col("open") > 0)), m, "A14"),
        _out(s.where(is_("RecordFormed") & F.col("formed").isNotNull()), m, "A15"),
        _out(s.where(is_("RecoverySelected") & (F.col("formed") != ident)), m, "A16"),
        _out(commits.where(F.col("formed").isNull() | (F.col("formed") != ident)), m, "A17"),
        _out(fresh.where("logical_offset <> done"), m, "A18"),
        _out(s.where(is_("ProducerAcknowledged") & ((F.col("committed_before") == 0) | (F.col("acks") > 0))), m, "A19"),
        _out(s.where(is_("TruncationProposed") & ((F.col("open") > 0) | (F.col("truncation_floor") < F.col("floor")))), m, "A20"),
        _out(seals.where("sealed_end IS NULL OR sealed_end <> record_end OR record_end >= truncation_floor"), m, "A21"),
        _out(opens, m, "A22"),
        _out(wrong, m, "A23"),
        _out(body.where(is_("ReplayClosed")).where("start IS NULL OR closed OR start + read <> stop"), m, "A24"),
    )


def size_excludes_open_tail(trace: DataFrame) -> DataFrame:
    return _out(_of(trace, "GetSizeObserved").where("NOT finalized AND reported_size <> 0"), "GetSizeExcludesOpenTail", "A25")


def manifest_safety(trace: DataFrame) -> DataFrame:
    m = "ManifestSafety"
    before = lambda *by: _w(*by).rowsBetween(Window.unboundedPreceding, -1)
    claims = _of(trace, "EpochClaimed").withColumn("nth", F.row_number().over(_w("epoch")))
    v = _of(trace, "ViewCommitted")
    first = claims.groupBy(T, "epoch").agg(F.min("seq").alias("claimed"))
    views = v.join(first, [T, "epoch"], "left").withColumn("prev", F.max("logical_offset").over(before())).withColumn("decided", F.first(F.struct("record_end", "value")).over(_w("segment")))
    bad = views.where((F.col("claimed").isNull()) | (F.col("claimed") > F.col("seq")) | (F.col("logical_offset") < F.col("prev")) | (F.col("record_end") != F.col("logical_offset")) | (F.col("decided") != F.struct("record_end", "value")))
    f = _of(trace, "FloorCommitted", "SegmentDeleted")
    f = f.withColumn("floor", F.coalesce(F.max(F.when(F.col("event") == "FloorCommitted", F.col("truncation_floor"))).over(before()), F.lit(0)))
    s = _as_of(_of(trace, "ViewCommitted", "SegmentSealed"), "ViewCommitted", ["segment"], F.col("record_end"), "decision").where("event = 'SegmentSealed'")
    return _all(
        _out(claims.where("nth > 1"), m, "A28"), _out(bad, m, "A29"), _out(f.where("truncation_floor < floor AND event = 'FloorCommitted' OR truncation_floor > floor AND event = 'SegmentDeleted'"), m, "A30"),
        _out(s.where("decision IS NULL OR decision <> record_end + 1"), m, "A30"),
    )


def directory_structure(trace: DataFrame) -> DataFrame:
    m = "DirectoryStructure"
    d = _of(trace, "DirectoryAdopted").withColumn("snap", F.count_if(F.col("directory_index") == 0).over(_w("writer").rowsBetween(Window.unboundedPreceding, 0)))
    w = _w("writer", "snap")
    d = d.withColumns({"nth": F.row_number().over(w) - 1, "len0": F.first("directory_len").over(w), "prev": F.lag("segment").over(w), "again": F.row_number().over(_w("writer", "snap", "segment_id")), "before": F.lag(F.col("directory_len") - F.col("directory_index")).over(_w("writer"))})
    entry = "directory_len <= 0 OR directory_index < 0 OR directory_index >= directory_len OR directory_index <> nth OR directory_len <> len0 OR segment >= tail_base OR segment <= prev OR again > 1 OR snap = 0"
    cut = "directory_index = 0 AND before <> 1"  # a snapshot begins before the one before it has ended
    last = "directory_index + 1 = directory_len AND tail_base > truncation_floor AND NOT (segment <=> seal_base AND segment_id <=> current_seal_id)"
    return _out(d.where(f"({entry}) OR ({cut}) OR ({last})"), m, "A26")


def directory_enforcement(trace: DataFrame) -> DataFrame:
    key = ["segment", "segment_id", "record_end"]
    done = _of(trace, "SealQuorumEnforced").groupBy(T, *key).agg(F.min("seq").alias("e_seq"))
    d = _of(trace, "DirectoryAdopted").where("segment_id <> coalesce(current_seal_id, -1)").join(done, [T, *key], "left")
    return _out(d.where("e_seq IS NULL OR e_seq > seq"), "DirectoryEnforcement", "A27")


#: In the order that decides ties.
MONITORS = {
    "quorum_linearizability": quorum_linearizability, "single_writer": single_writer, "seal_safety": seal_safety, "startup_replay": startup_replay,
    "size_excludes_open_tail": size_excludes_open_tail, "manifest_safety": manifest_safety, "directory_structure": directory_structure, "directory_enforcement": directory_enforcement,
}
NAMES = ("QuorumLinearizability", "SingleWriterPerSegment", "SealAndPrefixSafety", "StartupReplayAndTruncation", "GetSizeExcludesOpenTail", "ManifestSafety", "DirectoryStructure", "DirectoryEnforcement")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdict(trace: DataFrame) -> DataFrame:
    """trace_id, accepted, monitor, seq: the first rejection of each trace."""
    # each monitor is planned and run by itself: one plan of them all is re-planned at every stage that ends
    v = _all(*(m(trace) for m in MONITORS.values()))
    rank = F.coalesce(*[F.when(F.col("monitor") == n, i) for i, n in enumerate(NAMES)])
    first = v.groupBy(T).agg(F.min(F.struct("seq", rank.alias("rank"), "monitor")).alias("x"))
    return trace.select(T).distinct().join(first, T, "left").select(T, F.col("x").isNull().alias("accepted"), "x.monitor", "x.seq")


def first_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The first sequence number at which two runs of a trace differ (null: they do not)."""
    x, y = (d.select(T, "seq", F.struct(*columns).alias(n)) for d, n in ((a, "x"), (b, "y")))
    j = x.join(y, [T, "seq"], "full_outer")
    return j.groupBy(T).agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("seq"))).alias("seq"))
