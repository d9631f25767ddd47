r"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring tokens; the positions that it leaves out may differ. The tokens under each mask
at each place of the benchmark's items are hashed, and so are those of the documents; both are joined on the hash. A hit names
an item and a diagonal, along which the texts are then compared token by token: substitutions cost two matches each, and a
stretch whose score reaches MIN_SCORE, or a good share of the whole item, is a leak.

The documents are read once, whatever the size of the benchmark. A bitmap of its seeds, of 32 MiB at most, goes to all executors and keeps
most places of the documents out of the join; what passes by chance finds no partner there. Documents with a place that passes
go on with their tokens' hashes, so no text is read or shuffled again.

Tokens are runs of word characters in lower case; of Han and kana each character is one. Defined results: null and empty texts have no tokens and
leak nothing, nor do items without tokens; an empty table on either side gives no leak. An item shorter than a mask is found where all of its tokens stand in order.
Repeated rows of documents or items each count. Null ids come back as null. Of equal leaks of an item in a document the one on the first diagonal counts.
Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, cut, held_rows, map_batches, null_safe_join, unheld

#: Masks of eight tokens each; runs of one, two, three and four tokens between the gaps.
MASKS = ("11111111", "111101111", "1110111011", "11011011011")
#: A stretch with at least this score, one for a match and -2 for a substitution, is a leak.
MIN_SCORE = 12
#: So is an alignment over a whole item that matches this share of its tokens, and this many.
ITEM_SHARE, ITEM_TOKENS = 0.7, 8
#: Bits of the bitmap for each seed, and places that a seed has in it.
BITS_EACH, PROBES = 64, 4

_ALONE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")


class _Hashes(dict):
    """Token hashes, kept while they are few."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[token] = xxhash.xxh64_intdigest(token)
        return found


def _tokens(text: str | None, hashes: _Hashes) -> np.ndarray:
    words = _TOKEN.findall(text.lower()) if text else []
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _kinds(lengths: Sequence[int]) -> list[list[int]]:
    """The places of each mask, and of whole items of each of the lengths, which are shorter than the longest mask."""
    return [[i for i, x in enumerate(m) if x == "1"] for m in MASKS] + [list(range(n)) for n in lengths]


def _seeds(tokens: np.ndarray, kind: int, places: list[int]) -> np.ndarray:
    """The hash under the mask at each place where it fits."""
    n = len(tokens) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, kind if kind < len(MASKS) else len(MASKS) + len(places), np.uint64)
    for p in places:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= tokens[p : p + n]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xC2B2AE3D27D4EB4F)


def _verify(tokens: np.ndarray, item: np.ndarray, first: int) -> tuple[int, int, int] | None:
    """(matched, start, end) of the leak in the item's tokens from `first` on beside as many tokens of the document."""
    same = item[first : first + len(tokens)] == tokens
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    gains = sums - np.minimum.accumulate(sums)
    end = int(np.argmax(gains))
    start = int(np.argmin(sums[: end + 1]))
    if gains[end] < min(MIN_SCORE, len(item)):
        if len(same) < len(item) or same.sum() < max(ITEM_TOKENS, ITEM_SHARE * len(item)):
            return None
        start, end = 0, len(item)
    return int(same[start:end].sum()), start, end


def _emit_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        tokens = [_tokens(x.as_py(), hashes) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["item", "item_id", "n", "tokens"])


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n, tokens, copies): each different item with tokens."""
    own = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    own = own.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    names = own.select(F.xxhash64("item_id", "text").alias("item"), "copies")
    made = map_batches(own.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), _emit_items, "item long, item_id long, n long, tokens binary")
    return cut(made.where("n > 0").join(names, "item"), "items")


def _item_seeds(items: DataFrame, kinds: list[list[int]]) -> DataFrame:
    """(seed, item, at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                for k, places in enumerate(kinds):
                    if k < len(MASKS) or n == len(places):
                        seeds = _seeds(tokens, k, places)
                        yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), item, np.int64)), pa.array(np.arange(len(seeds))), pa.array(np.full(len(seeds), n, np.int64))], ["seed", "item", "at", "n"])

    return cut(map_batches(items.select("item", "n", "tokens"), run, "seed long, item long, at long, n long"), "seeds")


def _passing(own: DataFrame, seeds: DataFrame, kinds: list[list[int]]) -> DataFrame:
    """(_id, _hash, tokens, hits, rows): documents with places whose seeds are in the bitmap, each different one once."""
    held = own.sparkSession.sparkContext.broadcast(Bitmap(seeds, "seed", BITS_EACH, lambda bits: [64 - bits.bit_length() + 1 - 9 * k for k in range(PROBES)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = held.value, _Hashes()
        for batch in batches:
            rows, sizes, found, at, raw = [], [0], [], [], []
            for k, text in enumerate(batch.column(2)):
                tokens = _tokens(text.as_py(), hashes)
                hit = 0
                for kind, places in enumerate(kinds):
                    values = _seeds(tokens, kind, places)
                    spots = table.passing(values)
                    if len(spots):
                        hit += len(spots)
                        found.append(values[spots].view(np.int64))
                        at.append(spots)
                if hit:
                    rows.append(k)
                    sizes.append(sizes[-1] + hit)
                    raw.append(tokens.tobytes())
            if rows:
                hits = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(at))], ["seed", "at"]))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(raw, pa.binary()), hits], ["_id", "_hash", "tokens", "hits"])

    made = cut(map_batches(own, run, "_id long, _hash long, tokens binary, hits array<struct<seed:long,at:long>>"), "passing")
    held.unpersist()
    several = made.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("rows"))
    return null_safe_join(made.dropDuplicates(["_id", "_hash"]), several, ["_id", "_hash"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document and each of its diagonals, the tokens beside the item."""
    names = ["_id", "_hash", "item", "shift", "part"]
    for batch in batches:
        ids, hashes = (batch.column(k) for k in (0, 1))
        for k, (raw, lines) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            tokens = np.frombuffer(raw, np.uint64)
            for a in range(0, len(lines), 256):
                some = lines[a : a + 256]
                parts = [tokens[max(0, x["shift"]) : x["shift"] + x["n"]].tobytes() for x in some]
                same = pa.array([k] * len(some))
                yield pa.RecordBatch.from_arrays([ids.take(same), hashes.take(same), *(pa.array([x[f] for x in some], pa.int64()) for f in ("item", "shift")), pa.array(parts, pa.binary())], names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", "_hash", "item", "shift", "matched", "start_token", "end_token"]
    for batch in batches:
        rows, found = [], []
        for k, (shift, part, tokens) in enumerate(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)):
            if leak := _verify(np.frombuffer(part, np.uint64), np.frombuffer(tokens, np.uint64), max(0, -shift)):
                rows.append(k)
                found.append((leak[0], leak[1] + max(0, shift), leak[2] + max(0, shift)))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:4]), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], names)


def _leaks(own: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(_id, _hash, rows, item_id, copies, item_tokens, matched, start_token, end_token) of own (_id, _hash, text): each different item that
    leaks in each different document."""
    items = _items(benchmark, item_col, item_text_col)
    short = sorted(r[0] for r in items.where(F.col("n") < max(map(len, MASKS))).select("n").distinct().collect())
    kinds = _kinds(short)
    seeds = _item_seeds(items, kinds)
    documents = cut(_passing(own.select("_id", "_hash", F.col("text").cast("string").alias("text")), seeds, kinds), "documents")
    hits = documents.select("_id", "_hash", F.inline("hits")).withColumnRenamed("at", "_at")
    lines = hits.join(seeds, "seed").select("_id", "_hash", "item", (F.col("_at") - F.col("at")).alias("shift"), "n").distinct()
    lines = lines.groupBy("_id", "_hash").agg(F.collect_list(F.struct("item", "shift", "n")).alias("lines"))
    sliced = map_batches(null_safe_join(documents.select("_id", "_hash", "tokens"), lines, ["_id", "_hash"]), _sliced, "_id long, _hash long, item long, shift long, part binary")
    beside = sliced.join(items.select("item", "tokens"), "item").select("_id", "_hash", "item", "shift", "part", "tokens")
    found = map_batches(beside, _compared, "_id long, _hash long, item long, shift long, matched long, start_token long, end_token long")
    best = found.groupBy("_id", "_hash", "item").agg(F.max(F.struct("matched", (-F.col("shift")).alias("_s"), "start_token", "end_token")).alias("b"))
    named = best.join(items.select("item", "item_id", "copies", F.col("n").alias("item_tokens")), "item")
    return null_safe_join(named, documents.select("_id", "_hash", "rows"), ["_id", "_hash"]).select("_id", "_hash", "rows", "item_id", "copies", "item_tokens", "b.matched", "b.start_token", "b.end_token")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_tokens, matched, start_token, end_token): the best leak of each item in each document that has it."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("text"))
    found = _leaks(own, benchmark, item_col, item_text_col).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows") * F.col("copies"))))
    return found.select(F.col("_id").alias("doc_id"), "item_id", "item_tokens", "matched", "start_token", "end_token")


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, columns as they were."""
    held = held_rows(docs, id_col)
    own = held.select("_id", "_hash", F.col(f"row.`{text_col}`").alias("text"))
    found = cut(_leaks(own, benchmark, item_col, item_text_col).select("_id", "_hash").distinct(), "leaks")
    return unheld(null_safe_join(held, found, ["_id", "_hash"], "left_anti"), docs.schema)
