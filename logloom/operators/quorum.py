"""Agreement between replicas: order statistics, feasibility, canonical prefixes, finalized groups.

Inputs are keyed by `seg`; a missing copy is a row of size 0, an unreachable one no row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.codec import FENCING, TRANSIENT, frame


def _kth_largest(values, k):
    return F.element_at(F.sort_array(F.collect_list(values), asc=False), k)


def watermark(lanes: DataFrame, quorum: int) -> DataFrame:
    """The quorum-th largest durable offset over all lanes of a segment (a handful of rows each)."""
    return lanes.groupBy("seg").agg(_kth_largest("durable", quorum).alias("watermark"))


def commit_resolution(ends: DataFrame, lanes: DataFrame, quorum: int) -> DataFrame:
    j = ends.join(watermark(lanes, quorum), "seg")
    done = F.col("record_end") <= F.col("watermark")
    return j.groupBy("seg").agg(F.count_if(done).alias("committed"), F.coalesce(F.max(F.when(done, F.col("record_end"))), F.lit(0)).alias("committed_bytes"))


def feasibility(ends: DataFrame, lanes: DataFrame, quorum: int) -> DataFrame:
    """Whether the oldest unresolved record can still commit, and with which failure the writer ends otherwise."""
    w = watermark(lanes, quorum)
    first = ends.join(w, "seg").groupBy("seg").agg(F.min(F.when(F.col("record_end") > F.col("watermark"), F.col("record_end"))).alias("b"))
    err = F.col("finished") & F.col("error_code").isNotNull()
    fences, reach = err & F.col("error_code").isin(*FENCING), F.col("represented_end") >= F.col("b")
    per = lanes.join(first, "seg").groupBy("seg").agg(
        F.max("b").alias("b"), F.coalesce(F.bool_or(fences), F.lit(False)).alias("fenced"),
        F.count_if((F.col("durable") >= F.col("b")) | (~F.col("finished") & reach)).alias("able"),
        F.min_by("error_code", F.when(err & reach & ~F.col("error_code").isin(*TRANSIENT, *FENCING), F.col("zone"))).alias("transport"),
    )
    status = (
        F.when(F.col("fenced"), "Fenced").when(F.col("b").isNull(), "Committed").when(F.col("able") >= quorum, "Pending")
        .when(F.col("transport").isNotNull(), F.concat(F.lit("Transport:"), "transport")).otherwise("Poisoned")
    )
    return per.select("seg", status.alias("status"))


def durable_lag(lanes: DataFrame) -> DataFrame:
    lag = F.when(F.col("finished"), 0).otherwise(F.greatest(F.col("represented_end") - F.col("durable"), F.lit(0)))
    return lanes.select("seg", "zone", lag.cast("long").alias("lag"))


def merged_progress(progress: DataFrame) -> DataFrame:
    w = Window.partitionBy("seg", "zone").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return progress.select("seg", "zone", "seq", F.max("durable").over(w).alias("durable"))


def acked(ends: DataFrame, lanes: DataFrame) -> DataFrame:
    j = ends.select("seg", "record_end").join(lanes.select("seg", "zone", "durable"), "seg")
    return j.groupBy("seg", "zone").agg(F.count_if(F.col("record_end") <= F.col("durable")).alias("acked"))


def resend(ends: DataFrame, lanes: DataFrame) -> DataFrame:
    """What a lane sends again after its durable offset; its first record may be cut (offsets count frame bytes)."""
    j = ends.join(lanes.select("seg", "zone", "durable"), "seg").where("record_end > durable")
    skip = F.greatest(F.col("durable") - (F.col("record_end") - F.col("encoded_len")), F.lit(0))
    return j.select("seg", "zone", "record_index", skip.alias("skip"), (F.col("encoded_len") - skip).alias("bytes"))


def recovery_size(sizes: DataFrame, n: int) -> DataFrame:
    """`sizes(seg, zone, size)` of observed copies: the (Q - (N - k))-th largest of k, null below a quorum."""
    q = n // 2 + 1
    g = sizes.groupBy("seg").agg(F.sort_array(F.collect_list("size"), asc=False).alias("s"))
    k = F.size("s")
    return g.select("seg", k.cast("long").alias("observed"), F.when((k >= q) & (k <= n), F.element_at("s", F.lit(q - n) + k)).alias("size"))


def candidate_class(copies: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Absent, Empty or NonEmpty, NoQuorum below a quorum; reusable if all n copies are live and empty."""
    q = n // 2 + 1
    c = copies.join(sizes, ["seg", "zone"]).groupBy("seg").agg(
        F.count("*").alias("k"), F.count_if(F.col("observation") == "missing").alias("missing"), F.count_if((F.col("observation") == "live") & (F.col("size") == 0)).alias("live_empty")
    )
    c = c.join(recovery_size(sizes, n).select("seg", "size"), "seg")
    cls = F.when(F.col("k") < q, "NoQuorum").when(F.col("missing") == F.col("k"), "Absent").when(F.col("size") == 0, "Empty").otherwise("NonEmpty")
    return c.select("seg", cls.alias("class"), (F.col("live_empty") == n).alias("reusable"))


def canonical_prefix(frames: DataFrame, copies: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """The longest prefix that a quorum of consistent copies supports, for any number n of replicas.

    Frames are cut to the recovery size first. A quorum of the observed copies is consistent if the common ordinals of
    each two of its members agree; it offers its longest member, the first of equals. `conflict_at` is set when the
    longest offers differ, or no quorum is consistent; otherwise `zones` is the first quorum in order that has the
    longest offer, `bytes` its size, and `discarded` whether some copy held more bytes than that.
    """
    size = recovery_size(sizes, n).where("size IS NOT NULL").select("seg", F.col("size").alias("cut"))
    most = sizes.groupBy("seg").agg(F.max("size").alias("largest"))
    f = frames.join(size, "seg").where("record_end <= cut").select("seg", "zone", "ordinal", "frame", "record_end")
    own = f.groupBy("seg", "zone").agg(F.count("*").alias("len"), F.max("record_end").alias("bytes"))
    held = copies.select("seg", "zone").join(size, "seg").join(own, ["seg", "zone"], "left")
    held = held.groupBy("seg").agg(F.map_from_entries(F.collect_list(F.struct(F.col("zone").cast("int").alias("zone"), F.struct(F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("bytes", F.lit(0)).alias("bytes"))))).alias("held"))
    l, r = f.select("seg", "ordinal", F.col("zone").alias("l"), F.col("frame").alias("lf")), f.select("seg", "ordinal", F.col("zone").alias("r"), F.col("frame").alias("rf"))
    differ = l.join(r, ["seg", "ordinal"]).where("l < r AND lf <> rf").groupBy("seg", "l", "r").agg(F.min("ordinal").alias("at"))
    differ = differ.groupBy("seg").agg(F.sort_array(F.collect_list(F.struct(F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"), "at"))).alias("differ"))
    subsets = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(n), n // 2 + 1)])  # at most ten for five replicas
    d = held.join(differ, "seg", "left").withColumn("differ", F.coalesce("differ", F.expr("array()").cast("array<struct<l: int, r: int, at: bigint>>")))
    length = lambda z: F.col("held")[z].len
    fits = lambda s: F.forall(s, lambda z: F.map_contains_key("held", z)) & ~F.exists("differ", lambda x: F.array_contains(s, x.l) & F.array_contains(s, x.r))
    member = lambda s: F.element_at(F.filter(s, lambda z: length(z) == F.array_max(F.transform(s, length))), 1)
    d = d.withColumn("offers", F.transform(F.filter(subsets, fits), lambda s: F.struct(s.alias("zones"), member(s).alias("m"))))
    d = d.withColumn("top", F.array_max(F.transform("offers", lambda o: length(o.m))))
    d = d.withColumn("best", F.filter("offers", lambda o: length(o.m) == F.col("top")))
    pick = F.get("best", F.lit(0))
    at = lambda a, b: F.get(F.filter("differ", lambda x: (x.l == F.least(a, b)) & (x.r == F.greatest(a, b))), F.lit(0)).at
    clash = F.get(F.filter(F.transform("best", lambda o: at(o.m, pick.m)), lambda x: x.isNotNull()), F.lit(0))
    fail = F.when(F.size("offers") == 0, F.coalesce(F.get("differ", F.lit(0)).at, F.lit(0))).otherwise(clash)
    d = d.withColumn("conflict_at", fail.cast("long")).join(most, "seg")
    ok, size = F.col("conflict_at").isNull(), F.col("held")[pick.m].bytes
    return d.select(
        "seg", F.when(ok, F.col("top")).alias("len"), F.when(ok, F.array_join(pick.zones, ",")).alias("zones"), "conflict_at",
        F.when(ok, size).alias("bytes"), F.when(ok, F.col("largest") > size).alias("discarded"),
    )


def expected_prefix(prefix: DataFrame, expected: DataFrame) -> DataFrame:
    """The canonical prefix cut to the count that is expected, or the error if it is shorter. `expected(seg, expected)`."""
    j = prefix.join(expected, "seg")
    error = F.when(F.col("conflict_at").isNotNull(), "ConflictingPrefix").when(F.col("len") < F.col("expected"), "RecoveryPrefixTooShort")
    return j.select("seg", F.when(error.isNull(), F.coalesce("expected", "len")).alias("len"), error.alias("error"))


def copy_digests(frames: DataFrame) -> DataFrame:
    """seg, zone, records, digest of the encoded frames in order (length and payload of each)."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.hex(frame(F.col("frame"))).alias("h")))), lambda x: x.h), "")
    return frames.groupBy("seg", "zone").agg(F.count("*").alias("records"), F.sha2(F.unhex(body), 256).alias("digest"))


def exact_finalized_group(frames: DataFrame, copies: DataFrame, quorum: int, expected: DataFrame | None = None) -> DataFrame:
    """The content that a quorum of finalized copies of a valid format has, of the count that is expected if any is; two
    contents cannot both have a majority. `expected(seg, expected)`."""
    d = copy_digests(frames).join(copies.where("finalized AND format_ok").select("seg", "zone"), ["seg", "zone"])
    if expected is not None:
        d = d.join(expected, "seg").where("expected IS NULL OR records = expected")
    g = d.groupBy("seg", "digest", "records").agg(F.count("*").alias("copies")).where(F.col("copies") >= quorum)
    return g.groupBy("seg").agg(F.max(F.struct("records", "digest", "copies")).alias("x")).select("seg", "x.copies", "x.records", "x.digest")


def stat_quorum(copies: DataFrame, quorum: int) -> DataFrame:
    m = copies.groupBy("seg").agg(F.count_if(F.col("finalized") & F.col("format_ok") & F.col("crc_ok")).alias("matching"))
    return m.select("seg", "matching", (F.col("matching") >= quorum).alias("adopted"))


def sealed_read_choice(copies: DataFrame, frames: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Where a sealed segment is read: the first zone whose checksum, format and count agree; else the canonical prefix
    of the valid copies, if there is a quorum of them and it has the exact count."""
    valid = copies.where("finalized AND format_ok AND n_copy = n")
    first = copies.groupBy("seg", "n").agg(F.min(F.when(F.col("finalized") & F.col("format_ok") & F.col("crc_ok") & (F.col("n_copy") == F.col("n")), F.col("zone"))).alias("zone"))
    keys = valid.select("seg", "zone")
    canon = canonical_prefix(frames.join(keys, ["seg", "zone"], "left_semi"), valid, sizes.join(keys, ["seg", "zone"], "left_semi"), n).select("seg", "len", "conflict_at")
    j = first.join(valid.groupBy("seg").agg(F.count("*").alias("valid")), "seg", "left").join(canon, "seg", "left")
    source = (
        F.when(F.col("zone").isNotNull(), "zone").when(F.coalesce("valid", F.lit(0)) < n // 2 + 1, "NoReadQuorum").when(F.col("conflict_at").isNotNull(), "ConflictingPrefix")
        .when(F.col("len") == F.col("n"), "canonical").otherwise("InvalidSegmentData")
    )
    return j.select("seg", "zone", source.alias("source"))


def enforce_order(canonical: DataFrame, held: DataFrame) -> DataFrame:
    """Order in which a seal is enforced on the copies: those that share the shortest prefix with the canonical content
    first, so that the best copy is rewritten last. `held(seg, zone, ordinal, frame)`, `canonical(seg, ordinal, frame)`."""
    c = canonical.select("seg", "ordinal", F.col("frame").alias("want"))
    total = canonical.groupBy("seg").agg(F.count("*").alias("total"))
    bad = held.join(c, ["seg", "ordinal"], "left").groupBy("seg", "zone").agg(
        F.min(F.when(F.col("want").isNull() | (F.col("want") != F.col("frame")), F.col("ordinal"))).alias("bad"), F.count("*").alias("n")
    )
    score = bad.join(total, "seg").select("seg", "zone", F.least(F.coalesce("bad", "n"), "n", "total").alias("shared"))
    return score.select("seg", "zone", "shared", (F.row_number().over(Window.partitionBy("seg").orderBy("shared", "zone")) - 1).cast("long").alias("place"))


def witness_action(copies: DataFrame, order: DataFrame, total: DataFrame) -> DataFrame:
    """What a copy needs to become a witness: nothing if finalized and equal, finalize if open and equal, else replace."""
    j = copies.join(order.select("seg", "zone", "shared"), ["seg", "zone"], "left").join(total, "seg")
    equal = F.coalesce((F.col("shared") == F.col("total")) & (F.col("n_copy") == F.col("total")), F.lit(False))
    return j.select("seg", "zone", F.when(equal & F.col("finalized"), "done").when(equal, "finalize").otherwise("replace").alias("action"))


def finalized_content(frames: DataFrame, copies: DataFrame, zones: int = 2, healthy: bool = False) -> DataFrame:
    """Contents that several finalized copies have (healthy ones only, if asked): seg, digest, records, copies."""
    good = copies.where("finalized AND crc_ok" if healthy else "finalized").select("seg", "zone")
    g = copy_digests(frames).join(good, ["seg", "zone"]).groupBy("seg", "digest", "records").agg(F.count("*").alias("copies"))
    return g.where(F.col("copies") >= zones)


def quorum_formed(frames: DataFrame, quorum: int) -> DataFrame:
    """Records seen with the same content in a quorum of zones; the first two zones."""
    return frames.groupBy("seg", "ordinal", "frame").agg(F.sort_array(F.collect_set("zone")).alias("z")).where(F.size("z") >= quorum).select("seg", "ordinal", F.array_join(F.slice("z", 1, 2), ",").alias("zones"))
