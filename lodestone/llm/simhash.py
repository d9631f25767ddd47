"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in up to three bits, one
segment differs in at most one, so with that bit made a wildcard the segments are equal. Each fingerprint is indexed
under the 64 one-wildcard variants of its segments; an equality shuffle brings the candidates of a variant together and
every candidate pair is verified. A pair is looked at under the first variant it shares only.

Variants that more than HOT fingerprints share never make pairs: their members are indexed under variants with one
wildcard in each segment or two in the other one, where all that meet are linked, and a chain through them is enough.

Links join equal fingerprints' classes; components over them are found by star rounds in Spark. Copies never expand
into pairs: all rows with one fingerprint are one node.

Defined results: a null or empty text has no word and fingerprint zero, linked like any other; fewer words than a
shingle make one shingle. Repeated rows and rows with a null id each return a row; component_id is the least non-null id
of the component, or null if it has none. An empty table gives an empty one. Columns other than the id and the text don't
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_batches, text_bytes

SEGMENT = 32
#: Members of a variant that are compared with each other; beyond it wider variants take over.
HOT = 4096
#: Members of a variant up to which its verified pairs are links as they are.
FEW = 8


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # on bytes, lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)])
    ones, rows = np.zeros(64, np.int64), np.frombuffer(found, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 1 << 14):
        ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp has the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _split(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, fp): segment * 32 + wildcard in the high half, the segment without that bit in the low half."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 4096):
            some = fp[at : at + 4096]
            keys = [(np.uint64((s * 32 + i) << 32) | (seg & np.uint64(0xFFFFFFFF ^ (1 << i)))) for s, seg in enumerate(_split(some)) for i in range(SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(some, 2 * SEGMENT).view(np.int64))], ["variant", "fp"])


def _first_shared(seg: int, bit: int, x: np.ndarray) -> np.ndarray:
    """Of pairs with differing bits x that share variant (seg, bit): whether they share none before."""
    high, low = _split(x)
    own = np.uint64(1 << bit)
    if seg == 0:
        return (high == own) | ((high == 0) & (bit == 0))
    single = np.bitwise_count(high) <= 1
    return ~single & ((low == own) | ((low == 0) & (bit == 0)))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest: each round every component takes its first link to another one, so of links in
    ascending order of weight those of a least one."""
    label, kept, at = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        x, y = label[a], label[b]
        cross = x != y
        if not cross.any():
            return np.sort(np.concatenate(kept))
        a, b, x, y, at = a[cross], b[cross], x[cross], y[cross], at[cross]
        first = np.full(n, len(a))
        np.minimum.at(first, x, np.arange(len(a)))
        np.minimum.at(first, y, np.arange(len(a)))
        taken = np.unique(first[first < len(a)])
        kept.append(at[taken])
        root = np.arange(n)
        while True:
            fresh = root.copy()
            np.minimum.at(fresh, x[taken], root[y[taken]])
            np.minimum.at(fresh, y[taken], root[x[taken]])
            fresh = fresh[fresh]
            if (fresh == root).all():
                break
            root = fresh
        label = root[label]


def _links(reach: int):
    """Over rows sorted by variant: verified links of small variants, and the members of hot ones."""

    def bucket(variant: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seg, bit = divmod(variant >> 32, SEGMENT)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(fps), 256):  # blocks bound the memory
            x = fps[at : at + 256, None] ^ fps[None, at:]
            i, j = np.nonzero(np.triu((np.bitwise_count(x) <= reach) & _first_shared(seg, bit, x), 1))
            a, b = np.concatenate((a, i + at)), np.concatenate((b, j + at))
            if len(a) > 4 * len(fps):
                kept = forest(len(fps), a, b)
                a, b = a[kept], b[kept]
        if len(fps) > FEW and len(a) >= len(fps):
            kept = forest(len(fps), a, b)
            a, b = a[kept], b[kept]
        return fps[a], fps[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: int | None = None
        held_v, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def work(v: np.ndarray, f: np.ndarray, last: bool):
            """Emit all variants that end within these rows; return what may go on."""
            nonlocal hot
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(v))
            out_a, out_b, hot_v, hot_f = [], [], [], []
            keep = len(v)
            sizes = ends - starts
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == len(sizes) - 1) | (v[starts] == hot if hot is not None else False)):
                a, b, key = int(starts[k]), int(ends[k]), int(v[starts[k]])
                open_end = k == len(starts) - 1 and not last
                if key == hot or b - a > HOT:
                    hot = key
                    hot_v.append(v[a:b])
                    hot_f.append(f[a:b])
                elif open_end:
                    keep = a
                elif b - a > 1:
                    x, y = bucket(key, f[a:b])
                    out_a.append(x)
                    out_b.append(y)
            rows = [(np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64), False)] if out_a else []
            rows += [(np.concatenate(hot_f).view(np.int64), np.concatenate(hot_v), True)] if hot_f else []
            made = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), z))], ["a", "b", "hot"]) for x, y, z in rows if len(x)]
            return made, v[keep:], f[keep:]

        for batch in batches:
            v = np.concatenate((held_v, batch.column(0).to_numpy()))
            f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64)))
            made, held_v, held_f = work(v, f, False)
            yield from made
        yield from work(held_v, held_f, True)[0]

    return run


def _wide(reach: int):
    """Members of hot variants under keys that only linked fingerprints share: those that agree outside the wildcards.
    Up to three wildcards, of which the variant has one at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, vs = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for fp, place in zip(fps.tolist(), (vs >> 32).tolist(), strict=True):
                seg, bit = divmod(place, SEGMENT)
                own = 1 << (bit + (SEGMENT if seg == 0 else 0))
                others = [1 << (i + (0 if seg == 0 else SEGMENT)) for i in range(SEGMENT)]
                masks = [own | sum(c) for c in combinations(others, reach - 1)]
                if bit == 0:
                    masks += [sum(c) for c in combinations(others, reach)]
                masks = np.array(masks, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((np.uint64(fp) & ~masks).view(np.int64)), pa.array(masks.view(np.int64)), pa.array(np.full(len(masks), fp, np.uint64).view(np.int64))], ["kept", "mask", "fp"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (kept, mask, fp): each row linked to the one before with the same key."""
    last = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if last is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(last, cols, strict=True)]
        last = [c[-1] for c in cols]
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] != cols[2][:-1])
        if same.any():
            yield pa.RecordBatch.from_arrays([pa.array(cols[2][1:][same]), pa.array(cols[2][:-1][same])], ["a", "b"])


def links(nodes: DataFrame, reach: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, whose components are those of all pairs with at most `reach`
    differing bits (2 or 3). Each edge is such a pair."""
    if reach not in (2, 3):
        raise ValueError("two segments serve reaches of 2 and 3")
    dealt = map_batches(nodes.select("fp"), _variants, "variant long, fp long").repartition("variant").sortWithinPartitions("variant", "fp")
    found = cut(dealt.mapInArrow(_links(reach), "a long, b long, hot boolean"), "links")
    plain = found.where("not hot").select("a", "b")
    hot = found.where("hot").select("a", "b").distinct()
    wide = map_batches(hot, _wide(reach), "kept long, mask long, fp long").repartition("kept", "mask").sortWithinPartitions("kept", "mask", "fp")
    return plain.unionByName(wide.mapInArrow(_chains, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, reach)).withColumnRenamed("node", "fp")
    linked = found.join(nodes, "fp")
    linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    classes = nodes.join(linked.withColumnRenamed("component_id", "_c"), "fp", "left").select("fp", F.coalesce("_c", "least").alias("component_id"))
    # Written first: both sides of the join are plain shuffles then, of which Spark splits a fingerprint with many copies.
    return rows.join(cut(classes, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
