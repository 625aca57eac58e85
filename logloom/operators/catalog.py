"""The register's directory: chain, guards, validation, folds; replay ranges; maintenance plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import codec


#: Bases in one range of `chain`: windows hold one range, and a row for each range.
RANGE = 1 << 20


def chain(catalog: DataFrame, tail_base: int, width: int = RANGE) -> DataFrame:
    """Ends are derived: one less than the next base, or than the tail's. Within a range of bases by a window; the last
    entry of a range takes the first base of the next range that has any, from a table of one row for each range."""
    c = catalog.withColumn("_range", F.expr(f"base div {width}"))
    firsts = c.groupBy("_range").agg(F.min("base").alias("_least"))
    after = firsts.select("_range", F.lead("_least").over(Window.orderBy("_range")).alias("_after"))
    nxt = F.lead("base").over(Window.partitionBy("_range").orderBy("base"))
    out = c.withColumn("_next", nxt).join(after, "_range")
    return out.withColumn("end", F.coalesce("_next", "_after", F.lit(tail_base)) - 1).drop("_range", "_next", "_after")


def encode_directory(catalog: DataFrame, key: str) -> DataFrame:
    entry = F.concat_ws(":", "id", "base", F.lower(F.lpad(F.hex("crc"), 8, "0")))
    return catalog.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", entry.alias("e")))), lambda x: x.e), ",").alias("directory"))


def decode_directory(texts: DataFrame, key: str) -> DataFrame:
    p = F.split("entry", ":")
    rows = texts.where("directory <> ''").select(key, F.posexplode(F.split("directory", ",")).alias("pos", "entry"))
    good = (F.size(p) == 3) & (p[0] != "") & F.regexp_like(p[1], F.lit(r"^\+?[0-9]+$")) & F.regexp_like(p[2], F.lit("^[0-9a-f]{8}$"))
    out = rows.select(key, F.col("pos").cast("long").alias("pos"), p[0].alias("id"), F.expr("try_cast(split(entry, ':')[1] AS bigint)").alias("base"), F.conv(p[2], 16, 10).cast("long").alias("crc"), good.alias("valid"))
    grows = F.col("base") > F.lag("base").over(Window.partitionBy(key).orderBy("pos"))
    return out.withColumn("valid", F.col("valid") & F.coalesce(grows, F.col("pos") == 0))


#: The register's rules in the order they are tried; those of an entry are tried entry by entry.
ENTRY_RULES = ("bases_increase", "base_below_tail", "unique_ids")
RULES = ("seal_pair", "tail_id", *ENTRY_RULES, "tail_not_listed", "pending_form", "pending_not_tail", "pending_not_listed", "last_is_seal", "buckets")


def validate_registers(registers: DataFrame) -> DataFrame:
    """version, first_failed_rule (null if valid). Columns: epoch, tail_base, tail_id, pending_id, seal_id, seal_base,
    seal_digest, trunc, ids, bases, buckets. An empty directory breaks no rule of entries; a null one is empty."""
    r = registers.withColumns({"ids": F.coalesce("ids", F.array().cast("array<string>")), "bases": F.coalesce("bases", F.array().cast("array<bigint>"))})
    before = lambda a, i: F.get(a, i - 1)
    entry = lambda b, i: (
        F.when((i > 0) & (before(F.col("bases"), i) >= b), ENTRY_RULES[0]).when(b >= F.col("tail_base"), ENTRY_RULES[1])
        .when(F.array_position("ids", F.get("ids", i)) <= i, ENTRY_RULES[2])
    )
    of_entries = F.get(F.filter(F.transform("bases", entry), lambda x: x.isNotNull()), F.lit(0))
    last = lambda c: F.try_element_at(c, F.lit(-1))
    rules = [
        ("seal_pair", F.col("seal_base").isNull() != F.col("seal_digest").isNull()),
        ("tail_id", (F.col("epoch") > 0) & F.col("tail_id").isNull()),
        (None, of_entries.isNotNull()),
        ("tail_not_listed", F.array_contains("ids", F.col("tail_id"))),
        ("pending_form", (F.col("pending_id") == "") | F.col("pending_id").rlike("[:,]")),
        ("pending_not_tail", F.col("pending_id") == F.col("tail_id")),
        ("pending_not_listed", F.array_contains("ids", F.col("pending_id"))),
        ("last_is_seal", (F.col("tail_base") > F.col("trunc")) & (F.size("ids") > 0) & ~(last("ids").eqNullSafe(F.col("seal_id")) & last("bases").eqNullSafe(F.col("seal_base")))),
        ("buckets", ~codec.valid_buckets(F.col("buckets"))),
    ]
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), of_entries if name is None else F.lit(name)) for name, bad in rules])
    return r.select("version", first.alias("first_failed_rule"))


#: Operations of a register's history, for `fold_register`: what each takes from its row.
#: claim(owner); pending(epoch, owner, id); frontier(epoch, owner, expect_tail, expect_pending, base, id, refill);
#: fold(epoch, owner, id, base, stop, digest, crc, consumed, refill); raise(floor); remove(id, floor).
OPERATIONS = "register long, version long, op string, epoch long, owner string, id string, expect_tail string, expect_pending string, base long, stop long, crc long, refill string, floor long"


class Register:
    """The state of one register, and what each operation does to it: `applied`, `unchanged`, or the refusal."""

    def __init__(self, room: int):
        self.room = room  # entries that the directory has room for
        self.epoch, self.owner, self.base, self.trunc = 0, "", 0, 0
        self.tail = self.pending = None
        self.seal: tuple | None = None  # id and base
        self.entries: list[tuple[str, int, int]] = []  # id, base, crc

    def apply(self, x: dict) -> str:
        if x["op"] in ("pending", "frontier", "fold") and (not x["epoch"] or (self.epoch, self.owner) != (x["epoch"], x["owner"])):
            return "Fenced"
        return getattr(self, "_" + x["op"])(x)

    def _claim(self, x):
        self.epoch, self.owner = self.epoch + 1, x["owner"]
        if self.tail is None:
            self.tail = f"{self.epoch:016x}-{0:08x}"
        return "applied"

    def _pending(self, x):
        if self.pending is not None:
            return "unchanged" if self.pending == x["id"] else "Fenced"
        self.pending = x["id"]
        return "applied"

    def _frontier(self, x):
        if (self.tail, self.pending, self.base) == (x["id"], x["refill"], x["base"]):
            return "unchanged"
        if (self.tail, self.pending, self.base) != (x["expect_tail"], x["expect_pending"], x["base"]):
            return "Fenced"
        self.tail, self.pending = x["id"], x["refill"]
        return "applied"

    def _fold(self, x):
        old, successor = x["id"], x["expect_pending"]
        if (self.tail, self.base, self.pending, self.seal) == (successor, x["stop"] + 1, x["refill"], (old, x["base"])):
            return "unchanged" if self.entries and self.entries[-1] == (old, x["base"], x["crc"]) else "InvalidManifest"
        if (self.tail, self.base, self.pending) != (old, x["base"], successor):
            return "Fenced"
        if len(self.entries) >= self.room:
            return "SegmentDirectoryFull"
        self.entries.append((old, x["base"], x["crc"]))
        self.seal, self.base, self.tail, self.pending = (old, x["base"]), x["stop"] + 1, successor, x["refill"]
        return "applied"

    def _raise(self, x):
        if self.trunc >= x["floor"]:
            return "unchanged"
        self.trunc = x["floor"]
        return "applied"

    def _remove(self, x):
        if x["floor"] > self.trunc:
            return "InvalidManifest"
        at = next((i for i, e in enumerate(self.entries) if e[0] == x["id"]), None)
        if at is None:
            return "unchanged"
        after = self.entries[at + 1][1] if at + 1 < len(self.entries) else self.base
        if after - 1 >= x["floor"]:
            return "InvalidManifest"
        del self.entries[at]
        return "applied"


def fold_register(ops: DataFrame, room: int = 64) -> DataFrame:
    """State of each register after each operation of its history (OPERATIONS), in order of version, and what became of
    the operation. One register's history is one group, through which rows stream; its state is its directory."""
    ddl = "register long, version long, outcome string, epoch long, tail_base long, tail string, pending string, trunc long, segments long"
    names = [c.split()[0] for c in OPERATIONS.split(", ")]

    def run(it):
        import pyarrow as pa

        of, state = None, None
        for b in it:
            rows = []
            for x in b.to_pylist():
                if x["register"] != of:
                    of, state = x["register"], Register(room)
                out = state.apply(x)
                rows.append((of, x["version"], out, state.epoch, state.base, state.tail, state.pending, state.trunc, len(state.entries)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in ddl.split(", ")])

    return ops.select(*names).repartition("register").sortWithinPartitions("register", "version").mapInArrow(run, ddl)


def latest_register(updates: DataFrame) -> DataFrame:
    """What a cache holds after updates in any order: it never goes back to an earlier version."""
    return updates.groupBy("register").agg(F.max("version").alias("version"), F.max_by("record", "version").alias("record"))


def configuration_agrees(registers: DataFrame, buckets: list[str]) -> DataFrame:
    """Stored buckets are the configured ones, in their order."""
    return registers.select("version", (F.col("buckets") == F.array(*map(F.lit, buckets))).alias("agrees"))


def extends(adopted: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whether a directory extends the one adopted before: every entry of that is at its place. Both `(key, pos, id)`."""
    j = adopted.join(new.select(key, "pos", F.col("id").alias("n")), [key, "pos"], "left")
    return j.groupBy(key).agg(F.bool_and(F.coalesce(F.col("id") == F.col("n"), F.lit(False))).alias("extends"))


def adopt(snapshot: DataFrame, deleted: DataFrame, sealed: DataFrame) -> DataFrame:
    """A maintenance catalog: the engine's without what was deleted, seals that were done here no longer pending."""
    rows = snapshot.join(deleted.select("base"), "base", "left_anti").join(sealed.select("base", F.lit(True).alias("done")), "base", "left")
    return rows.select("base", "id", (F.col("seal_pending") & F.col("done").isNull()).alias("seal_pending"))


def vanished(before: DataFrame, now: DataFrame) -> DataFrame:
    """Bases that were in the catalog before and are no longer."""
    return before.select("base").join(now.select("base"), "base", "left_anti")


def replay(records: DataFrame, chained: DataFrame, start: int, end: int) -> DataFrame:
    """Records in [start, end), from segments that overlap it only."""
    live = chained.where((F.col("end") >= start) & (F.col("base") < end)).select("seg")
    return records.where(F.col("record_index").between(start, end - 1)).join(live, "seg", "left_semi").select("record_index", "payload").orderBy("record_index")


def replay_check(records: DataFrame, start: int, end: int) -> DataFrame:
    got = records.where(F.col("record_index").between(start, end - 1)).agg(F.countDistinct("record_index").alias("n"))
    return got.select(F.lit(start).cast("long").alias("from"), F.lit(end).cast("long").alias("end"), (F.lit(end - start) - F.col("n")).alias("missing"))


def checkpoint_guards(checkpoints: DataFrame, first_base: int, trunc: int, end: int) -> DataFrame:
    c = F.col("checkpoint")
    why = F.when(c < trunc, "below_floor").when((F.lit(first_base) > c) & (F.lit(first_base) > trunc), "gap").when(c > end, "past_end")
    return checkpoints.select("checkpoint", why.alias("violation"))


def repair_plan(chained: DataFrame, copies: DataFrame, floor: int, zones: int) -> DataFrame:
    """Copies to mend: those of live, sealed segments that are not healthy by their metadata."""
    want = chained.where(F.col("end") >= floor).select("seg", F.explode(F.array(*map(F.lit, range(zones)))).alias("zone"))
    j = want.join(copies, ["seg", "zone"], "left")
    healthy = F.coalesce(F.col("finalized") & F.col("format_ok") & F.col("crc_ok"), F.lit(False))
    action = F.when(healthy, "none").when(F.col("observation").isNull(), "unreachable").when(F.col("observation") == "missing", "recreate").when(F.col("finalized"), "replace").otherwise("finalize")
    return j.select("seg", "zone", action.alias("action"))


def truncate_plan(chained: DataFrame, copies: DataFrame, floor: int, zones: int) -> DataFrame:
    """Segments wholly below the floor: out of the chain once absent in a majority, off the directory once absent in all."""
    below = chained.where(F.col("end") < floor).select("seg")
    a = below.join(copies, "seg", "left").groupBy("seg").agg(F.count_if(F.col("observation") == "missing").alias("absent"))
    return a.select("seg", "absent", (F.col("absent") >= zones // 2 + 1).alias("leave_chain"), (F.col("absent") == zones).alias("leave_directory"))


def dead_sweep(listed: DataFrame, keep: DataFrame, claimed_epoch: int) -> DataFrame:
    """Listed identifiers with a valid format that nothing keeps and whose epoch is past."""
    ids = listed.where("format_ok").select("id").distinct().join(keep.select("id"), "id", "left_anti")
    return ids.where(codec.id_epoch(F.col("id")) < claimed_epoch)


def coalesce_commands(commands: DataFrame) -> DataFrame:
    """Between seals, truncations merge to their highest floor and repairs to distinct ones. `commands(queue, seq, kind, base, floor)`."""
    g = commands.withColumn("grp", F.sum((F.col("kind") == "seal").cast("long")).over(Window.partitionBy("queue").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("queue", F.col("grp").alias("group")).agg(F.max(F.when(F.col("kind") == "truncate", F.col("floor"))).alias("floor"), F.count_distinct(F.when(F.col("kind") == "repair", F.col("base"))).alias("repairs"))
