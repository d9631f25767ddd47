"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Each source is a queue of its documents in a fixed shuffled order, gone through up to `epochs` times. A document's
copy has a virtual finish time: the words its source has sent up to and including it, divided by the source's target.
The copies of all sources, range-sorted by finish time, are cut where their words reach the total budget, so each
source has sent about its target then.

Targets share the budget by weight; none exceeds `epochs` times its source, and what a full source leaves is shared
among the others by weight until none is above.

Defined results: a null text has no words and size 0; null sources are one source, the last. Equal rows (ties) are
interchangeable: one of them may be taken once more than another. The order depends on the id, a seed and, among rows of one id and size,
on the whole row, so reruns agree. An empty table gives an empty one. Other columns don't matter, whatever their names; the mix itself has all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, held_rows, null_safe_join, one_each, unheld, with_prefix, with_running

#: Finish times at which the sent words are counted to bound the sort.
BOUNDS = (1.0, 1.01, 1.1, 1.5, 2.0, 4.0, 16.0, 256.0)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """(source, rank, source_size, target) from (source, size)."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")).withColumn("_none", F.col("source").isNull())
    ranked = with_prefix(found, ["_none", "source"], F.lit(1), "rank")
    table = F.array(*[F.lit(int(w)) for w in weights])
    ranked = cut(ranked.select("source", "rank", "source_size", F.element_at(table, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight")), "sources")
    limit = F.col("source_size") * epochs
    full = lambda level: limit.cast("double") <= F.lit(level) * F.col("weight")
    total, shares = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    level, before = total / shares, -1
    while True:
        n, held, free = ranked.agg(F.count_if(full(level)), F.coalesce(F.sum(F.when(full(level), limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full(level), F.col("weight"))), F.lit(0))).first()
        if n == before or not free:
            break
        level, before = (total - held) / free, n
    return ranked.withColumn("target", F.when(full(level), limit.cast("double")).otherwise(F.lit(float(level)) * F.col("weight")))


def plan(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """Add source_size, target and taken to rows of (doc_id, source, size, more); of `more`, only _hash breaks ties."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = sizes.withColumn("_key", key).withColumn("_hash31", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 1))
    targets = cut(source_targets(sizes, weights, epochs), "targets")
    count, budget = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ties = [c for c in ("_hash",) if c in sizes.columns]
    queued = with_running(rows, ["source"], ["_key", "doc_id", "size", *ties], "_hash31", "size", count, "_sent")
    queued = cut(null_safe_join(queued, targets, ["source"]), "queued")
    sent = [F.col("_sent") + F.lit(e) * F.col("source_size") for e in range(epochs)]
    finish = [s.cast("double") / F.col("target") for s in sent]
    # Words sent up to each bound: what finishes after the first bound that fills the budget can't be taken.
    filled = queued.where("size > 0").agg(*[sum(F.coalesce(F.sum(F.when(f <= F.lit(b), F.col("size"))), F.lit(0)) for f in finish).alias(f"b{i}") for i, b in enumerate(BOUNDS)]).first()
    bound = next((b for b, n in zip(BOUNDS, filled, strict=True) if n >= budget), float("inf"))
    copies = queued.where("size > 0").select("size", "rank", F.explode(F.array(*[F.struct(f.alias("finish"), s.alias("sent")) for f, s in zip(finish, sent, strict=True)])).alias("c"))
    copies = copies.select("size", "rank", "c.finish", "c.sent").where(F.col("finish") <= F.lit(bound))
    ordered = with_prefix(copies, ["finish", "rank", "sent"], "size", "_total")
    last = ordered.where(F.col("_total") <= F.lit(budget)).agg(F.max(F.struct("finish", "rank", "sent"))).first()[0]
    taken = F.lit(0).cast("long")
    if last is not None:
        end = F.struct(F.lit(last[0]).alias("finish"), F.lit(last[1]).cast("long").alias("rank"), F.lit(last[2]).cast("long").alias("sent"))
        for f, s in zip(finish, sent, strict=True):
            taken = taken + F.when((F.col("size") > 0) & (F.struct(f.alias("finish"), F.col("rank").cast("long").alias("rank"), s.alias("sent")) <= end), F.col("size")).otherwise(F.lit(0))
    return queued.withColumn("taken", taken).drop("_key", "_hash31", "_sent", "rank", "weight")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row for each row of docs: taken is a multiple of size."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col)).alias("size"))
    return plan(cut(own, "sizes"), weights, epochs, seed)


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: rows of docs, columns as they were, each as often as it is taken."""
    held = held_rows(docs, id_col)
    own = held.select(F.col("_id").alias("doc_id"), F.col(f"row.`{source_col}`").cast("string").alias("source"), words_of(F.col(f"row.`{text_col}`")).alias("size"), "_hash")
    found = plan(cut(own, "sizes"), weights, epochs, seed)
    times = found.groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("long").alias("_times"))
    chosen = one_each(held, times.where("_times > 0"))
    return unheld(chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))), docs.schema)
