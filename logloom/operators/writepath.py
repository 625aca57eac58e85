"""What a writer would have decided, over recorded appends: admission, completion, rotation, packing, object folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the number that no record can have.
LAST_SEQNO = (1 << 64) - 1


def admission(attempts: DataFrame, max_record: int, ceiling: int) -> DataFrame:
    """Outcome of each append of an engine, `attempts(engine, attempt, seqno, payload_bytes, closed, seal_room)`, in order
    of `attempt`. Only an admitted record moves the expected number and the bytes of the active segment on. A fold, one
    engine a group, through which the rows stream; a null seqno is out of order, a null size counts 0."""
    ddl = "engine long, attempt long, outcome string"

    def run(it):
        import pyarrow as pa

        engine = None
        expected = active = 0
        for b in it:
            out = []
            for e, seqno, size, closed, room in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if e != engine:
                    engine, expected, active = e, 0, 0
                size = size or 0
                if closed:
                    out.append("Closed")
                elif seqno != expected:
                    out.append("OutOfOrder")
                elif seqno == LAST_SEQNO:
                    out.append("SequenceExhausted")
                elif size > max_record:
                    out.append("RecordTooLarge")
                elif not room:
                    out.append("SegmentDirectoryFull")
                elif active + size + 4 > ceiling:
                    out.append("ActiveSegmentFull")
                else:
                    out.append("Admitted")
                    expected, active = expected + 1, active + size + 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["engine", "attempt", "outcome"])

    rows = attempts.select("engine", "attempt", "seqno", "payload_bytes", "closed", "seal_room")
    return rows.repartition("engine").sortWithinPartitions("engine", "attempt").mapInArrow(run, ddl)


def completion(records: DataFrame, resolved: DataFrame, status: DataFrame, engine: str) -> DataFrame:
    """In order over all segments of an engine: done up to the first record that is not committed; if its segment has
    failed, it takes that error and all later ones are poisoned, else they are pending. `status(seg, status)`."""
    j = records.join(resolved, "seg").withColumn("engine", F.expr(engine))
    first = j.where("ordinal >= committed").groupBy("engine").agg(F.min("record_index").alias("first"), F.min_by("seg", "record_index").alias("f_seg"))
    failed = status.where(~F.col("status").isin("Committed", "Pending")).select(F.col("seg").alias("f_seg"), F.col("status").alias("error"))
    j = j.join(first.join(failed, "f_seg", "left").select("engine", "first", "error"), "engine", "left")
    before = F.col("first").isNull() | (F.col("record_index") < F.col("first"))
    out = F.when(before, "Done").when(F.col("error").isNull(), "Pending").when(F.col("record_index") == F.col("first"), F.col("error")).otherwise("Poisoned")
    return j.select("record_index", out.alias("outcome"))


def swap_ready(resolved: DataFrame, admitted: DataFrame) -> DataFrame:
    """A segment can be swapped once something was admitted and all of it is committed."""
    return admitted.join(resolved, "seg").select("seg", ((F.col("admitted") > 0) & (F.col("admitted") == F.col("committed"))).alias("ready"))


def windowed_batches(queue: DataFrame, window: int) -> DataFrame:
    """How a queue is dispatched while nothing is acknowledged between: `queue(engine, record_index, outstanding)` goes
    out in batches of at most what the window leaves; a full window leaves none."""
    k = F.row_number().over(Window.partitionBy("engine").orderBy("record_index")) - 1
    free = F.greatest(F.lit(window) - F.col("outstanding"), F.lit(0))
    return queue.withColumn("k", k).select("engine", "record_index", F.when(F.col("k") < free, 0).cast("long").alias("batch"))


def lane_budget(batches: DataFrame, limit: int) -> DataFrame:
    """Whether each batch can be reserved on its lane: unacknowledged bytes before it and its own are within the limit.
    The first that is not retires the lane. `batches(seg, zone, seq, bytes, acked)`, acked in bytes from the start."""
    w = Window.partitionBy("seg", "zone").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    b = batches.withColumn("outstanding", F.sum("bytes").over(w) - F.col("acked"))
    over = F.max((F.col("outstanding") > limit).cast("int")).over(w) == 1
    return b.select("seg", "zone", "seq", over.alias("retired"))


def created(attempts: DataFrame, quorum: int) -> DataFrame:
    """A writer exists if a quorum of zones created its object in this very call; existing objects never count."""
    return attempts.groupBy("seg").agg(F.count_if(F.col("outcome") == "Created").alias("created")).select("seg", "created", (F.col("created") >= quorum).alias("opened"))


def finish_accepted(finishes: DataFrame) -> DataFrame:
    """An ambiguous finish holds if the object is then finalized, of the same generation and of the exact size."""
    ok = F.col("stat_finalized") & (F.col("stat_generation") == F.col("generation")) & (F.col("stat_size") == F.col("write_offset"))
    return finishes.select("seg", "zone", F.when(F.col("reply") == "ok", True).when(F.col("reply") == "ambiguous", F.coalesce(ok, F.lit(False))).otherwise(False).alias("accepted"))


def stall_gaps(progress: DataFrame, ticks: int) -> DataFrame:
    """Lanes whose durable offset stood still over more than `ticks` of the log's sequence."""
    w = Window.partitionBy("seg", "zone").orderBy("seq")
    g = progress.select("seg", "zone", "seq", (F.col("seq") - F.lag("seq").over(w)).alias("gap"))
    return g.where(F.col("gap") > ticks).select("seg", "zone", "seq", "gap")


def rotation_due(resolved: DataFrame, target: int, directory_len: int, budget: int) -> DataFrame:
    """Due once something is committed, the bytes reach the target, and two more entries have room."""
    return resolved.select("seg", ((F.col("committed") > 0) & (F.col("committed_bytes") >= target) & F.lit(directory_len + 2 * 64 <= budget)).alias("due"))


def greedy_segments(records: DataFrame, key: str, target: int) -> DataFrame:
    """Cut a log at the first record where the bytes since the last cut reach the target. A fold in order, one log a
    group; the state between rows is one sum, so rows stream through it."""
    ddl = "log long, seg long, base long, end long, bytes long"

    def run(it):
        import pyarrow as pa

        log = seg = base = last = total = None

        def row():
            return (log, seg, base, last, total)

        for b in it:
            out = []
            for k, i, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != log:
                    if log is not None and total:
                        out.append(row())
                    log, seg, base, total = k, 0, i, 0
                elif not total:
                    base = i
                total += n
                last = i
                if total >= target:
                    out.append(row())
                    seg, total = seg + 1, 0
            yield _batch(pa, out)
        if log is not None and total:
            yield _batch(pa, [row()])

    def _batch(pa, rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["log", "seg", "base", "end", "bytes"])

    return records.select(F.col(key).alias("log"), "record_index", "encoded_len").repartition("log").sortWithinPartitions("log", "record_index").mapInArrow(run, ddl)


def pack_messages(records: DataFrame, limit: int) -> DataFrame:
    """Greedy packing of a segment's frames into messages of at most `limit` bytes; a larger frame is one alone."""
    fold = F.aggregate(
        F.transform(F.sort_array(F.collect_list(F.struct("record_index", "encoded_len"))), lambda x: x.encoded_len),
        F.expr("array(CAST(0 AS bigint))"),
        lambda acc, n: F.when((F.element_at(acc, -1) > 0) & (F.element_at(acc, -1) + n > limit), F.concat(acc, F.array(n))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.element_at(acc, -1) + n))
        ),
    )
    return records.groupBy("seg").agg(fold.alias("m")).select("seg", F.posexplode("m").alias("message", "bytes")).withColumn("message", F.col("message").cast("long"))


def fold_objects(ops: DataFrame) -> DataFrame:
    """Final length, generation and refused operations of each object, from its operations in order:
    create (only if absent), append (at the tail; earlier bytes must repeat, later ones are out of range), finalize
    (at the exact length), replace, delete. `ops(object, seq, op, write_offset, size, stream)`."""

    def run(table):
        import pyarrow as pa

        t = table.sort_by("seq")
        there, size, final, gen, stream, refused = False, 0, False, 0, None, 0
        for op, at, n, by in zip(*(t.column(c).to_pylist() for c in ("op", "write_offset", "size", "stream")), strict=True):
            ok = True
            if op == "create":
                ok = not there
                if ok:
                    there, size, final, gen, stream = True, 0, False, gen + 1, by
            elif not there:
                ok = False
            elif op == "takeover":
                ok, stream = not final, by if not final else stream
            elif op == "append":
                ok = not final and by == stream and at <= size
                size = max(size, at + n) if ok else size
            elif op == "finalize":
                ok = final and at == size or not final and by == stream and at == size
                final = final or ok
            elif op == "replace":
                size, final, gen, stream = n, False, gen + 1, by
            elif op == "delete":
                there, size, final = False, 0, False
            refused += not ok
        return pa.table({"object": [t.column("object")[0].as_py()], "final_len": [size], "generation": [gen], "finalized": [final], "rejects": [refused]})

    return ops.groupBy("object").applyInArrow(run, "object long, final_len long, generation long, finalized boolean, rejects long")


#: An engine's defaults (records, bytes, milliseconds), and the most a record's format can hold.
DEFAULTS = {
    "queue_capacity": 256, "max_record_bytes": 1 << 20, "window": 32, "inflight_bytes": 64 << 20, "lag_bytes": 64 << 20, "stall_ms": 5000,
    "max_segment_bytes": 256 << 20, "max_active_bytes": 4 << 30, "repair_ms": 300_000, "shutdown_ms": 300_000,
}
MAX_PAYLOAD = (1 << 32) - 5


def validate_config(configs: DataFrame) -> DataFrame:
    """config, first_failure (null if valid) of each row of an engine's settings; a null repair_ms means no repair."""
    record = F.col("max_record_bytes") + 4
    rules = [
        ("queue_capacity", F.col("queue_capacity") == 0), ("max_record_bytes", F.col("max_record_bytes") == 0), ("record_beyond_format", F.col("max_record_bytes") > MAX_PAYLOAD),
        ("window", F.col("window") == 0), ("inflight_bytes", F.col("inflight_bytes") == 0), ("lag_bytes", F.col("lag_bytes") == 0), ("inflight_below_record", record > F.col("inflight_bytes")),
        ("lag_below_inflight", F.col("lag_bytes") < F.col("inflight_bytes")), ("stall_ms", F.col("stall_ms") == 0), ("inflight_beyond_permits", F.col("inflight_bytes") > (1 << 61) - 1),
        ("max_segment_bytes", F.col("max_segment_bytes") == 0), ("max_active_bytes", F.col("max_active_bytes") == 0), ("active_below_record", F.col("max_active_bytes") < record),
        ("active_below_segment", F.col("max_active_bytes") < F.col("max_segment_bytes")), ("repair_ms", F.col("repair_ms") == 0), ("shutdown_ms", F.col("shutdown_ms") == 0),
    ]
    return configs.select("config", F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]).alias("first_failure"))
