"""Sharding by balanced label propagation.

Linked documents, here those of equal texts, should share a shard, and all shards should be even. Linked documents of
one group that start in the same shard move as one block, so a group makes `shards` blocks at most, whatever its
size. Groups of an eighth of a shard and more, of which there are eight a shard at most, are given their places first: as many whole shards
as they fill and one more for the rest, row by row in a hashed order. The others propagate within the room that is left: in each round a block's neighbours vote: it asks for the shard in which most of its group is. What a shard may take in is its
room and what leaves it; requests are granted in a hashed order of the groups. At the end each shard gives up what exceeds its quota,
and these and the documents without links fill the shards exactly.

The law `rows` counts documents: shards differ by one at most. The law `bytes` counts sizes: shards differ by about one
document.

Defined results: a null text has no bytes and no link; an empty one links to other empty ones. Repeated rows are rows
like any other. Fewer rows than shards leave the last ones empty; an empty table gives an empty one. Other columns than
the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_cut, null_safe_join, with_running

#: Bytes that a document takes beside its text.
HEADER = 16
#: Part of a shard from which on a group is placed before the others.
PART = 8


def _hash31(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFF))


def _loads(state: DataFrame, shards: int) -> list[int]:
    """The weight in each shard: `shards` numbers."""
    found = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("w")).collect()}
    return [int(found.get(t) or 0) for t in range(shards)]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _grants(asked: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """How much weight each shard may take in, of what asks to move between which shards.

    Moves along a cycle of shards need no room and are granted first. What is left has no cycle, so shards can be
    taken in an order in which all that leaves one is known before what enters it: its room and that may enter.
    """
    n = len(room)
    rest = [{} for _ in range(n)]
    for (a, b), w in asked.items():
        if a != b and w > 0:
            rest[a][b] = w
    grant, done = [0] * n, []
    dead = [False] * n
    for first in range(n):
        path, place = [first], {first: 0}
        while path:
            here = path[-1]
            ahead = next((b for b in rest[here] if not dead[b]), None) if not dead[here] else None
            if ahead is None:  # no cycle goes through it any more
                dead[here] = True
                if here not in done:
                    done.append(here)
                place.pop(path.pop())
            elif ahead in place:
                ring = path[place[ahead] :]
                steps = list(zip(ring, [*ring[1:], ahead], strict=True))
                least = min(rest[a][b] for a, b in steps)
                for a, b in steps:
                    grant[b] += least
                    rest[a][b] -= least
                    if not rest[a][b]:
                        del rest[a][b]
                for x in path[place[ahead] + 1 :]:
                    place.pop(x)
                del path[place[ahead] + 1 :]
            else:
                place[ahead] = len(path)
                path.append(ahead)
    left = [0] * n
    for target in done:  # what a shard sends goes to shards before it in this order
        open_ = max(0, room[target] + left[target])
        for a in range(n):
            if target in rest[a]:
                take = min(open_, rest[a][target])
                grant[target] += take
                left[a] += take
                open_ -= take
    return grant


def _pieces(groups: list[tuple[int, int, int]], quotas: list[int]) -> list[tuple[int, int, int, int]]:
    """(g, rows before, rows up to, shard) for groups (g, weight, rows) whose rows weigh the same, the heaviest first.

    A group, or what is left of it, goes to the shard with the least room that takes it whole, or fills the one with the
    most. Rows that no shard has room for are in no piece.
    """
    room, out = list(quotas), []
    for g, weight, rows in sorted(groups, key=lambda x: (-x[1], x[0])):
        each, done = weight // rows, 0
        while done < rows:
            fits = [t for t, r in enumerate(room) if r >= (rows - done) * each]
            target = min(fits, key=lambda t: (room[t], t)) if fits else max(range(len(room)), key=lambda t: (room[t], -t))
            take = min(rows - done, room[target] // each)
            if not take:
                break
            out.append((g, done, done + take, target))
            room[target] -= take * each
            done += take
    return out


def propagate(blocks: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """The blocks (g, start, w, all) with their shard, null for what found no place within the quotas.

    Every second round asks shards with room for the group's smallest block only, so a group goes on from a full shard to the next one. After `rounds`
    rounds it goes on while more of the groups' pairs come together; two rounds without a move end it before.
    """
    shards = len(quotas)
    state = cut(blocks.select("g", "start", "w", F.col("start").alias("shard")), "labels")
    count, still, most = state.count(), 0, -1.0
    for step in itertools.count() if count else ():
        if step >= rounds and step % 2 == rounds % 2:  # a round of each kind
            together = state.groupBy("g", "shard").agg(F.sum("w").cast("double").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0]
            if together <= most * (1 + 1e-9):
                break
            most = together
        room = [q - n for q, n in zip(quotas, _loads(state, shards), strict=True)]
        votes = state.groupBy("g", "shard").agg(F.sum("w").alias("v"), F.min("w").alias("least"))
        rank = F.struct(F.col("v"), F.xxhash64("g", "shard").alias("h"), F.col("shard").alias("target"))
        open_ = F.element_at(_array(room), (F.col("shard") + 1).cast("int")) >= F.col("smallest") if step % 2 else F.lit(True)
        best = votes.withColumn("smallest", F.min("least").over(Window.partitionBy("g"))).where(open_).groupBy("g").agg(F.max(rank).alias("best"))
        now = votes.select("g", "shard", rank.alias("own"))
        asked = state.join(now, ["g", "shard"]).join(best, "g", "left")
        asked = asked.withColumn("moves", F.coalesce(F.col("best") > F.col("own"), F.lit(False))).withColumn("target", F.col("best.target"))
        asked = cut(asked.select("g", "start", "w", "shard", "moves", "target"), "requests")
        movers = asked.where("moves").withColumn("_h", _hash31(F.col("g"), F.lit(3)))
        wanted = {(r[0], r[1]): int(r[2]) for r in movers.groupBy("shard", "target").agg(F.sum("w")).collect()}  # shards squared at most
        # In the order of a hash of the group, so that its blocks are let in together.
        granted = with_running(movers, ["target"], ["g", "start"], "_h", "w", count, "_sum")
        fits = F.col("_sum") <= F.element_at(_array(_grants(wanted, room)), (F.col("target") + 1).cast("int"))
        moved = granted.select("g", "start", "w", F.when(fits, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        following = cut(asked.where("not moves").select("g", "start", "w", "shard").unionByName(moved), "labels")
        still = 0 if wanted and granted.where(fits).limit(1).count() else still + 1
        drop_cut(state)
        state = following
        if still == 2:
            break
    kept = with_running(state.withColumn("_h", _hash31(F.col("g"), F.lit(3))), ["shard"], ["g", "start"], "_h", "w", max(1, count), "_sum")
    fits = F.col("_sum") <= F.element_at(_array(quotas), (F.col("shard") + 1).cast("int"))
    return blocks.drop("w").join(kept.select("g", "start", "w", F.when(fits, F.col("shard")).alias("shard")), ["g", "start"])


def shard(docs: DataFrame, shards: int = 40, law: str = "rows", rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + HEADER).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.when(text.isNotNull(), F.xxhash64(text)).alias("g"))
    rows = cut(own.withColumn("_h", _hash31(F.col("doc_id"), F.col("g"))).withColumn("start", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(shards)).cast("int")).withColumn("w", F.lit(1).cast("long") if law == "rows" else F.col("size")), "rows")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    quotas = [total // shards + (t < total % shards) for t in range(shards)]
    # Texts are equal if their hash, checksum and size are.
    key = F.xxhash64("g", "text_crc32", "size")
    linked = rows.where("g IS NOT NULL").groupBy(key.alias("g"), "start").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("g")
    linked = linked.withColumn("all", F.sum("n").over(every)).withColumn("weight", F.sum("w").over(every)).where("all > 1")
    linked = cut(linked.select("g", "start", "w", "all", "weight", (F.col("weight") * PART * shards >= total).alias("large")), "blocks")
    large = [tuple(r) for r in linked.where("large").select("g", "weight", "all").distinct().collect()]  # PART a shard at most
    pieces = _pieces(large, quotas)
    room = list(quotas)
    weights = {g: weight // n for g, weight, n in large}
    for g, a, b, t in pieces:
        room[t] -= (b - a) * weights[g]
    placed = cut(propagate(linked.where("not large").select("g", "start", "w", "all"), room, rounds), "placed")
    load = _loads(placed.where("shard IS NOT NULL"), shards)
    load = [n + q - r for n, q, r in zip(load, quotas, room, strict=True)]
    named = rows.withColumn("g", F.when(F.col("g").isNotNull(), key))
    names = F.broadcast(rows.sparkSession.createDataFrame([(g, n) for g, _, n in large], "g long, all long"))
    ranges = F.broadcast(rows.sparkSession.createDataFrame(pieces, "g long, _from long, _to long, shard int"))
    ranked = with_running(named.join(names, "g"), ["g"], ["doc_id", "start"], "_h", F.lit(1).cast("long"), max(1, count), "_rank")
    ranked = ranked.join(ranges.withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")) & (F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to")), "left").drop("_g", "_rank", "_from", "_to")
    others = named.join(names.select("g"), "g", "left_anti").join(placed.drop("w"), ["g", "start"], "left")
    dealt = cut(others.unionByName(ranked), "dealt")
    # What is left goes in a hashed order, in which a group stands together: over as wide a part of it as is its share of all rows,
    # so no range of the order holds more than its share, whatever a group's size.
    spread = (F.col("_h") * F.col("all") / F.lit(max(1, count))).cast("long")
    rest = dealt.where("shard IS NULL").drop("shard").withColumn("_o", F.coalesce(F.pmod(_hash31(F.col("g"), F.lit(5)) + spread, F.lit(1 << 31)), F.col("_h")))
    loose = with_running(rest, [], ["g", "doc_id"], "_o", "w", max(1, count), "_sum")
    at = F.col("_sum") - 1 if law == "rows" else F.col("_sum") - F.col("w") / 2
    ends, free = [], 0
    for t in range(shards - 1):
        free += quotas[t] - load[t]
        ends.append(free)
    filled = loose.withColumn("shard", sum(((at >= F.lit(e)).cast("int") for e in ends), F.lit(0))).drop("_sum", "_o")
    everything = dealt.where("shard IS NOT NULL").unionByName(filled)
    # Another hash than the one that filled the shards, so each shard's rows lie in all ranges.
    everything = everything.withColumn("_h", _hash31(F.col("doc_id"), F.col("g"), F.lit(9)))
    slots = with_running(everything, ["shard"], ["doc_id", "g"], "_h", F.lit(1).cast("long"), max(1, count), "_slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
