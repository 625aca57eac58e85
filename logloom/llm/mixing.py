"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: each source gets its weight's share of the total, none more than EPOCHS times its own size; the excess goes
to the others by weight, until none is above. A source's documents are then taken whole as often as its epochs have
whole units, and the rest by a seeded order of documents, up to the words wanted (the one that crosses the end
counts if more than half of it lies before it). So a source comes within half a document of its target.

Cases: a null text has size 0; a null source is a source, the last; a source without words has target 0; documents
with equal ids are ordered by size, those of equal size in any order; very long texts are counted whole; an empty table
gives an empty result; other columns, whatever their names, are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

EPOCHS, SEED = 3, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by rank from 0."""
    return (rank % 3 + 1).cast("double")


def targets(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """`sources(source, source_size, weight)` with `target` added. Rounds of clamping, each one aggregate; the driver
    holds three sums. `sources` has a row for each source and is kept as a table."""
    table = C.materialize(sources.withColumn("capped", F.lit(False)), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, marked = 0.0, -1
    while True:
        r = table.agg(F.sum(F.when(F.col("capped"), F.col("source_size"))).alias("c"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w"), F.count_if("capped").alias("k")).first()
        if r.k == marked or not r.w:
            break
        level, marked = (total - epochs * (r.c or 0)) / r.w, r.k
        table = table.withColumn("capped", F.col("capped") | (F.col("weight") * level > F.col("source_size") * epochs))
        if marked:
            table = C.materialize(table, "mix-sources")
    full = F.col("source_size") * F.lit(float(epochs))
    return table.withColumn("target", F.round(F.when(F.col("capped"), full).otherwise(F.least(full, F.col("weight") * level)), 6)).drop("capped")


def _draw(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _ordered(docs: DataFrame, weight, epochs: float, seed: str) -> DataFrame:
    """doc_id, source, draw, size, source_size, target, whole (copies of each), once_more (whether one more is taken):
    in a source's seeded order these are the rows up to some place."""
    base = C.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size")), "mix-sizes")
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = C.ordered_prefix(sources, [F.col("source").asc_nulls_last()], "source_size", "mix-rank", before="words_before", position="rank")
    goal = C.materialize(targets(ranked.select("source", "source_size", "words_before", weight(F.col("rank")).alias("weight")), epochs), "mix-targets")
    seeded = base.withColumn("draw", _draw(seed, F.col("doc_id")))
    order = C.ordered_prefix(seeded, [F.col("source").asc_nulls_last(), F.col("draw"), F.col("size")], "size", "mix-order")
    g = goal.select(F.col("source").alias("g"), "source_size", "target", "words_before")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("share")
    quota = (F.col("share") - whole) * F.col("source_size")
    inside = 2 * (F.col("before") - F.col("words_before")) + F.col("size") <= 2 * quota
    out = order.join(g, order.source.eqNullSafe(g.g)).withColumn("share", share)
    return out.select("doc_id", "source", "draw", "size", "source_size", "target", whole.cast("long").alias("whole"), ((F.col("share") > whole) & inside).alias("once_more"))


def plan(docs: DataFrame, weight=cycle_weight, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, draw, size, source_size, target, times (whole copies taken) for each row of docs."""
    rows = _ordered(docs, weight, epochs, seed)
    return rows.select("doc_id", "source", "draw", "size", "source_size", "target", (F.col("whole") + F.col("once_more").cast("long")).alias("times"))


#: Sources up to which what the mix takes of each is sent to all tasks.
SOURCES = 1 << 14


def mix(docs: DataFrame, weight=cycle_weight, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as it is taken; the columns of `docs`.

    What is taken of a source is told by one row: the whole copies of each document, and the last one of the seeded order
    that is taken once more. So each document is judged where it lies. Rows that share id, source and size are alike in
    that order: those of the last place are taken once more as far as the order goes, by their texts' hashes.
    """
    from pyspark.sql import Window

    of_source, of_whole, of_last, of_more, size, here, copies, copy, nth = C.free(docs, "_source", "_whole", "_last", "_more", "_size", "_here", "_copies", "_copy", "_nth")
    begin = C.mark()
    rows = C.materialize(_ordered(docs, weight, epochs, seed).select("source", "draw", "size", "whole", "once_more"), "mix-plan")
    at = F.struct("draw", "size")
    last = rows.groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("once_more"), at)).alias("last"))
    alike = rows.groupBy("source", "draw", "size").agg(F.count("*").alias("rows"), F.count_if("once_more").alias("more")).where("more > 0 and more < rows")
    alike = alike.select(F.col("source").alias("s"), F.struct("draw", "size").alias("place"), "more")
    ends = last.join(alike, F.col("source").eqNullSafe(F.col("s")) & (F.col("last") == F.col("place")), "left")
    ends = C.materialize(ends.select(F.col("source").alias(of_source), F.col("whole").alias(of_whole), F.col("last").alias(of_last), F.col("more").alias(of_more)), "mix-ends")
    C.sweep(begin, ends)
    own = docs.withColumn(size, word_count()).withColumn(here, F.struct(_draw(seed, F.col("doc_id").cast("long")).alias("draw"), F.col(size).alias("size")))
    own = own.join(F.broadcast(ends) if ends.count() <= SOURCES else ends, F.col("source").eqNullSafe(F.col(of_source)))
    split = F.col(of_more).isNotNull() & (F.col(here) == F.col(of_last))
    out = own.where(~split).withColumn(copies, F.col(of_whole) + F.coalesce(F.col(here) <= F.col(of_last), F.lit(False)).cast("long"))
    if not ends.where(F.col(of_more).isNotNull()).isEmpty():
        rank = F.row_number().over(Window.partitionBy(of_source).orderBy(F.xxhash64("text")))
        some = own.where(split).withColumn(nth, rank)
        out = out.unionByName(some.withColumn(copies, F.col(of_whole) + (F.col(nth) <= F.col(of_more)).cast("long")).drop(nth))
    return out.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
