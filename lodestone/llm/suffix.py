"""Removal of repeated byte strings by column-wise construction over many documents.

Every string of LENGTH bytes, a window, has an anchor: the least of its K-byte strings by hash, the leftmost of equals.
Equal windows have equal anchors at equal places. Neighbouring windows with one anchor make a segment; segments of one
anchor, aligned at it, are a collection. Anchors are counted first; what has one of its own repeats nothing and goes no further.

A collection's suffixes are put in order column by column, from the last one: each round inserts one symbol of every segment. What
precedes each suffix, in their order, is the collection's Burrows-Wheeler transform; a stable sort by it alone turns the order of the suffixes
of one column into that of the column before, and the common prefix of neighbours is one more than the least between them before,
or nothing. Neighbours that share LENGTH symbols are repeated windows, and so are all windows of a segment that stands for several equal ones:
these are inserted once, with their number. As segments are aligned, only suffixes of one column are compared, and a round's work is the number of segments.

Collections are dealt by anchor, many to a task, which reads them from the sorted files of the shuffle and holds one construction's columns at a time.
Anchors with more than HOT different segments, such as those of a line that is everywhere, aren't collected: each of their windows is hashed and counted
for itself, with the same result.

Defined results: a null text counts as empty. Texts shorter than LENGTH keep all. A row that repeats another row
repeats its text, so both lose what is LENGTH bytes or more. Matches never cross documents. An empty table gives an empty one. Other columns than
the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, cut, flat_bytes, map_batches, null_safe_join, text_bytes

LENGTH, K = 200, 32
#: Different segments of one anchor that one task compares.
HOT = 4096
#: Segments that are put into one construction.
COLLECTION = 16384

_PLACE_BITS = 18
_PIECE = 1 << 17
_ODD = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _string_hashes(flat: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    n = len(flat) - K + 1
    raw = flat.tobytes() + bytes(8)
    words = np.empty(len(flat), np.uint64)
    for r in range(8):
        part = words[r::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), r) if r + 8 * len(part) <= len(raw) else np.frombuffer(raw + bytes(8), "<u8", len(part), r)
    x = words[:n] * _ODD[0]
    for k in (1, 2, 3):
        x += words[8 * k : 8 * k + n] * _ODD[k]
        x ^= x >> np.uint64(31)
        x *= _ODD[4]
    x ^= x >> np.uint64(29)
    return x


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts between the offsets: row, start in its text, windows, anchor's place from the start, anchor, for each segment."""
    found: list[tuple[np.ndarray, ...]] = []
    width = LENGTH - K + 1
    total = len(flat) - LENGTH + 1
    row_of_end = np.asarray(offsets[1:])
    for at in range(0, max(0, total), _PIECE):
        piece = flat[at : at + _PIECE + LENGTH - 1]
        hashes = _string_hashes(piece)
        packed = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min(packed, width)
        n = len(least)
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        ends = np.append(starts[1:], n)
        # Cut at the ends of texts: windows that cross one belong to none.
        row = np.searchsorted(row_of_end, starts + at, "right")
        row_last = np.searchsorted(row_of_end, ends - 1 + at, "right")
        parts = [(starts, ends, row)]
        split = np.flatnonzero(row != row_last)
        if len(split):  # few: a segment is no longer than an anchor's reach, so it meets the ends of few texts
            more = []
            for k in split.tolist():
                for r in range(int(row[k]) + 1, int(row_last[k]) + 1):
                    more.append((max(int(starts[k]), int(offsets[r]) - at), int(ends[k]), r))
            extra = np.array(more, np.int64).reshape(-1, 3)
            parts.append((extra[:, 0], extra[:, 1], extra[:, 2]))
        s, e, r = (np.concatenate(x) for x in zip(*parts, strict=True))
        e = np.minimum(e, row_of_end[r] - LENGTH + 1 - at)
        keep = e > s
        s, e, r = s[keep], e[keep], r[keep]
        value = least[s]
        place = (value & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        found.append((r, s + at - offsets[r], e - s, place - s, (value >> np.uint64(_PLACE_BITS)).astype(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n) of each batch's segments."""
    for batch in batches:
        anchor, n = np.unique(segments(*flat_bytes(text_bytes(batch.column(2))))[4], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])


def _emit_segments(held: Broadcast):
    """The segments whose anchors are in the bitmap."""
    names = ["_id", "_hash", "start", "windows", "place", "anchor", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digest = held.value, xxhash.xxh64_intdigest
        for batch in batches:
            flat, offsets = flat_bytes(text_bytes(batch.column(2)))
            found = segments(flat, offsets)
            kept = table.passing(found[4].view(np.uint64))
            row, start, windows, place, anchor = (x[kept] for x in found)
            raw, at = memoryview(flat), offsets[row] + start
            seg = np.fromiter((digest(raw[a:b]) for a, b in zip(at.tolist(), (at + windows + LENGTH - 1).tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
            take = pa.array(row)
            cols = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int32()) for x in (start, windows, place)), pa.array(anchor), pa.array(seg)]
            for k in range(0, len(row), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 16) for c in cols], names)

    return run


def construct(texts: list[bytes], places: np.ndarray, windows: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which windows of the segments are found again: rows are segments, columns windows from the segment's start. Each segment
    stands for so many copies.

    Segments are aligned by their anchors' places. A round per column inserts one symbol of each segment.
    """
    n, lead = len(texts), LENGTH - K
    columns = lead + LENGTH
    first = lead - places
    lengths = windows + LENGTH - 1
    table = np.full((n, columns), 256, np.uint16)  # 256 stands outside the segment and equals nothing
    flat, offsets = flat_bytes(texts)
    table.ravel()[np.arange(len(flat)) + np.repeat(np.arange(n) * columns + first - offsets[:-1], lengths)] = flat
    table = np.ascontiguousarray(table.T)  # a column's symbols stand together
    found = np.zeros((n, lead + 1), bool)
    several = copies > 1
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    for c in range(columns - 1, -1, -1):
        transform = table[c][order]  # what precedes each suffix, in their order
        moved = np.argsort(transform, kind="stable")
        symbols = transform[moved]
        same = (symbols[1:] == symbols[:-1]) & (symbols[1:] < 256)
        between = np.empty(2 * (n - 1), np.int64)
        between[0::2], between[1::2] = moved[:-1] + 1, moved[1:] + 1
        least = np.minimum.reduceat(common, between)[0::2] if n > 1 else common[:0]
        common = np.zeros(n + 1, np.int32)
        common[1:n] = np.where(same, least + 1, 0)
        order = order[moved]
        if c <= lead:
            repeated = common >= LENGTH
            rows = order[repeated[:-1] | repeated[1:] | several[order]]
            at = c - first[rows]
            inside = (at >= 0) & (at < windows[rows])
            found[rows[inside], at[inside]] = True
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by anchor: (anchor, seg, from, to) of each run of repeated windows."""

    def work(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchors, segs, copies, places, windows, texts = zip(*held, strict=True)
        found = construct(list(texts), np.array(places, np.int64), np.array(windows, np.int64), np.array(copies, np.int64))
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edges == 1)
        stop = np.nonzero(edges == -1)[1]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(anchors, np.int64)[row]), pa.array(np.array(segs, np.int64)[row]), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["anchor", "seg", "lo", "hi"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= COLLECTION and row[0] != held[-1][0]:
                yield from work(held)
                held = []
            held.append(row)
    if held:
        yield from work(held)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, seg, copies, at, place, digest) of each window of the segments."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for anchor, seg, copies, place, windows, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.arange(windows)
            raw = memoryview(text)
            hashes = np.fromiter((digest(raw[a : a + LENGTH]) for a in range(windows)), np.uint64, windows).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(windows, anchor)), pa.array(np.full(windows, seg)), pa.array(np.full(windows, copies)), pa.array(at, pa.int32()), pa.array(place - at, pa.int32()), pa.array(hashes)], ["anchor", "seg", "copies", "at", "place", "digest"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the wanted segments of each document."""
    names = ["anchor", "seg", "copies", "place", "windows", "text", "hot"]
    for batch in batches:
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pieces = [text[x["start"] : x["start"] + x["windows"] + LENGTH - 1] for x in wanted]
            cols = [pa.array([x[k] for x in wanted], kind) for k, kind in (("anchor", pa.int64()), ("seg", pa.int64()), ("copies", pa.int64()), ("place", pa.int32()), ("windows", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pieces, pa.binary()), pa.array([x["hot"] for x in wanted], pa.bool_())], names)


def repeated_windows(held: DataFrame) -> DataFrame:
    """(_id, _hash, lo, hi): runs of repeated windows' starts in the texts of (_id, _hash, text), in bytes."""
    counted = map_batches(held, _emit_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    anchors = cut(counted.where("n > 1").select("anchor"), "anchors")
    # The low bits of an anchor, which is a least hash, are even.
    table = held.sparkSession.sparkContext.broadcast(Bitmap(anchors, "anchor", 16, lambda bits: (0, 5, 10)))
    spots = map_batches(held, _emit_segments(table), "_id long, _hash long, start int, windows int, place int, anchor long, seg long")
    shared = cut(spots.join(anchors, "anchor").select("_id", "_hash", "start", "windows", "place", "anchor", "seg"), "shared")
    table.unpersist()

    kinds = cut(shared.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("_id", "_hash", "start", "windows", "place")).alias("one")), "kinds")
    hot = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("anchor", F.lit(True).alias("hot"))
    kinds = kinds.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = kinds.groupBy("one._id", "one._hash").agg(F.collect_list(F.struct("anchor", "seg", "copies", "one.start", "one.windows", "one.place", "hot")).alias("wanted"))
    texts = null_safe_join(held, wanted, ["_id", "_hash"])
    pieces = cut(map_batches(texts.select(F.col("text").cast("binary").alias("text"), "wanted"), _cut_out, "anchor long, seg long, copies long, place int, windows int, text binary, hot boolean"), "pieces", "zstd")

    cold = pieces.where("not hot").select("anchor", "seg", "copies", "place", "windows", "text").repartition("anchor").sortWithinPartitions("anchor", "seg")
    compared = map_batches(cold, _compare, "anchor long, seg long, lo int, hi int")
    single = map_batches(pieces.where("hot").select("anchor", "seg", "copies", "place", "windows", "text"), _window_hashes, "anchor long, seg long, copies long, at int, place int, digest long")
    several = single.groupBy("anchor", "place", "digest").agg(F.sum("copies").alias("_n")).where("_n > 1").drop("_n")
    crowded = single.join(several, ["anchor", "place", "digest"]).select("anchor", "seg", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    return shared.join(compared.unionByName(crowded), ["anchor", "seg"]).select("_id", "_hash", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        kept, spans, sizes = [], [], []
        for text, runs in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"] + LENGTH - 1) for x in runs or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            ends = [0, *(x for m in merged for x in m), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            spans.append([{"start": a, "end": b} for a, b in merged])
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept), one row for each row of docs: the removed byte ranges and the bytes that stay."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = own.select("_id", F.xxhash64("text").alias("_hash"), "text")
    runs = repeated_windows(held).groupBy("_id", "_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    joined = null_safe_join(held, cut(runs, "runs"), ["_id", "_hash"], "left")
    return map_batches(joined.select("_id", "text", "runs"), _remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
