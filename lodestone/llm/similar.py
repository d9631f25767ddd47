"""Near-duplicates of a stated similarity, by SimHash and deletion-variant signatures.

A 64-bit fingerprint of shingles finds texts that are almost equal; texts that share four of five shingles differ in about
ten of its bits, more than variants with one wildcard can bridge. Here candidates come from a second fingerprint, of
the distinct words, in which such texts differ in about eight of 128 bits: it is cut into four segments of 32, and texts
meet where a segment differs in one bit at most. All that differ in up to seven bits do, most of the others as well.
A passage added, cut off or replaced changes many of its words at once, so 16 more segments are bands of five minima of
the shingles' hashes each: of texts that share 0.8 of their shingles 99.8% have an equal band, wherever they differ.
All that meet are verified on the shingles themselves, unless their texts are in one class by then. That takes two passes.

The first one looks at those whose 256-bit fingerprints of the distinct shingles differ in at most `distance(similarity)` bits. Of a variant with more than FEW
texts a least spanning forest by distance stays, and of each text the NEAREST closest ones: they are as many as the texts, not their pairs. Variants that more than
HOT texts share don't compare all of them: each text is compared with the leaders, those that no leader before was near, with the
last HOT others, and with those that the triangle inequality leaves possible while they are not linked yet. The second one takes every variant
whose texts are of several classes after the first one's links, with their shingles, and verifies all pairs between classes, whatever their fingerprints' distance. Large variants
go in parts, of which each two are a group of the shuffle. So the classes are those of all pairs that meet, and only the time, not what is shuffled, follows the number of pairs
within a part. A link always joins two texts that share `similarity` of their shingles or more, so nothing below it goes.

Defined results: texts without words are one class; fewer words than a shingle make one shingle. Rows with one pair of
fingerprints are one node, so copies never make pairs. An empty table gives an empty one. All columns come back as they were,
whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, components, cut, held_rows, map_batches, null_safe_join, one_each, text_bytes, unheld
from .simhash import FEW, forest

SEGMENTS, SEGMENT, BITS = 4, 32, 256
#: Segments that follow those of the words: hashes of MINIMA minima each, which are equal or have nothing in common.
BANDS, MINIMA = 16, 5
#: Odd factors, each of which makes another order of the shingles' hashes.
_ORDERS = np.frombuffer(b"".join([xxhash.xxh64_digest(b"order", i) for i in range(BANDS * MINIMA)]), np.uint64) | np.uint64(1)
#: Members of a variant that the first pass compares with each other.
HOT = 4096
#: Members of a variant, and bytes of their shingles' hashes, of which the second pass makes a part.
PART, PART_BYTES = 1 << 13, 8 << 20
#: Rows of a variant that are held at once to see whether they meet.
LONG = 1 << 17
#: Bits beyond the expected distance that still count: nearly twice the distance's deviation.
SLACK = 10
#: Closest candidates of a text that are kept beside the forest's, unless they are closer than the expected distance by CLEAR bits, three deviations:
#: such a one is hardly below the similarity, so the forest's is enough.
NEAREST, CLEAR = 3, 17


def distance(similarity: float) -> int:
    """Of shingle sets of one size with this Jaccard similarity, the bits in which the fingerprints differ on average, and SLACK."""
    return round(BITS * acos(2 * similarity / (1 + similarity)) / pi) + SLACK


def _majority(digests: bytes, width: int) -> bytes:
    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)
    ones = np.zeros(8 * width, np.int64)
    for at in range(0, len(rows), 1 << 13):
        ones += np.unpackbits(rows[at : at + (1 << 13)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def _bands(digests: bytes, width: int) -> bytes:
    """Of the minima of the rows' first eight bytes in each order, a hash of 32 bits for each MINIMA."""
    own = np.frombuffer(digests, np.uint64).reshape(-1, width // 8)[:, 0]
    least = np.full(len(_ORDERS), ~np.uint64(0))
    for at in range(0, len(own), 1 << 10):
        np.minimum(least, (own[at : at + (1 << 10), None] * _ORDERS).min(0), out=least)
    return b"".join([xxhash.xxh32_digest(x.tobytes()) for x in least.reshape(BANDS, MINIMA)])


def two_fingerprints(text: bytes, shingle: int = 5) -> tuple[bytes, bytes]:
    """Of the distinct words, with the bands, and of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return bytes(16 + 4 * BANDS), bytes(32)
    digest = xxhash.xxh3_128_digest
    pieces = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    found = b"".join([digest(x) + digest(x, 1) for x in pieces])
    return _majority(b"".join(map(digest, set(words))), 16) + _bands(found, 32), _majority(found, 32)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, one, node): the segment without its wildcard bit, and that bit. Bands have no wildcard."""
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        segments = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, SEGMENTS + BANDS).astype(np.int64)
        for at in range(0, len(nodes), 2048):
            keys, ones = [], []
            for s in range(SEGMENTS):
                seg = segments[at : at + 2048, s]
                for i in range(SEGMENT):
                    keys.append(((s * SEGMENT + i) << 32) | (seg & ~(1 << i)))
                    ones.append((seg >> i & 1).astype(bool))
            for s in range(SEGMENTS, SEGMENTS + BANDS):
                keys.append((s * SEGMENT << 32) | segments[at : at + 2048, s])
                ones.append(np.zeros(len(keys[-1]), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ones)), pa.array(np.tile(nodes[at : at + 2048], len(keys)))], ["variant", "one", "node"])


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Column arrays of whole runs of the first column, many at once; a run over `limit` rows comes in pieces, each
    marked, that begin where the piece before ended."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1], "left"))
        if last:
            yield False, [c[:last] for c in held]
            held = [c[last:] for c in held]
        if len(held[0]) > limit:
            yield True, held
            held = [c[:0] for c in held]
    if held is not None and len(held[0]):
        yield False, held


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by variant, those that meet another one there for the first time in their segment: equal segments
    under the first wildcard, others under the one in which they differ. A variant over LONG rows keeps them all."""
    key = None
    for long, (variant, one, node) in _runs(batches, LONG):
        if long:
            key, keep = variant[-1], np.ones(len(variant), bool)
        else:
            starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
            sizes = np.diff(np.append(starts, len(variant)))
            ones = np.add.reduceat(one.astype(np.int64), starts)
            meets = np.where((variant[starts] >> 32) % SEGMENT == 0, sizes > 1, (ones > 0) & (ones < sizes))
            keep = np.repeat(meets | (variant[starts] == key), sizes)  # what is left of a long run as well
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(variant[keep]), pa.array(one[keep]), pa.array(node[keep])], ["variant", "one", "node"])


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def closest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, clear: int) -> np.ndarray:
    """Places of the candidates of a least spanning forest, and of those over `clear` among the NEAREST closest ones of each of n texts."""
    order = np.lexsort((b, a, d))
    held = np.zeros(len(a), bool)
    held[forest(n, a[order], b[order])] = True
    ends, at = np.concatenate((a[order], b[order])), np.tile(np.arange(len(a)), 2)
    by = np.lexsort((at, ends))
    starts = np.searchsorted(ends[by], ends[by])
    near = at[by[np.arange(len(by)) - starts < NEAREST]]
    held[near[d[order][near] > clear]] = True
    return order[held]


def _verified(reach: int):
    """Candidates of rows sorted by variant."""
    clear = reach - SLACK - CLEAR

    def bucket(first: bool, one: np.ndarray, node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        for at in range(0, len(node), 128):
            far = _far(prints[at : at + 128], prints[at:])
            near = far <= reach
            if not first:
                near &= one[at : at + 128, None] != one[None, at:]
            i, j = np.nonzero(np.triu(near, 1))
            a, b, d = np.concatenate((a, i + at)), np.concatenate((b, j + at)), np.concatenate((d, far[i, j]))
            if len(a) > 16 * len(node):
                kept = closest(len(node), a, b, d, clear)
                a, b, d = a[kept], b[kept], d[kept]
        if len(node) > FEW and len(a) >= len(node):
            kept = closest(len(node), a, b, d, clear)
            a, b = a[kept], b[kept]
        return node[a], node[b]

    def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of a and b."""
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]

    class Large:
        """The members of one variant, piece by piece: each belongs to the closest leader and is linked with it, or is
        a leader. A member within `reach` of one of a leader's is within twice that of the leader, so only those are
        compared, and only while their classes differ: the links' components are those of all pairs."""

        def __init__(self) -> None:
            self.ids, self.own = np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64)
            self.members: list[list[tuple[np.ndarray, np.ndarray]]] = []
            self.label = np.zeros(0, np.int64)
            self.last = (np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64))

        def lead(self, node: np.ndarray, prints: np.ndarray) -> np.ndarray:
            """The leader of each row; rows without a near one become leaders."""
            of = np.full(len(node), -1)
            if len(self.ids):
                far = _far(prints, self.own)
                of = np.where(far.min(1) <= reach, far.argmin(1), -1)
            while (of < 0).any():
                first = int(np.argmax(of < 0))
                left = np.flatnonzero(of < 0)
                near = _far(prints[left], prints[first : first + 1])[:, 0] <= reach
                of[left[near]] = len(self.ids)
                self.label = np.append(self.label, len(self.ids))
                self.ids, self.own = np.append(self.ids, node[first]), np.concatenate((self.own, prints[first : first + 1]))
                self.members.append([])
            return of

        def add(self, node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = [node[:0]], [node[:0]]
            for at in range(0, len(node), 512):
                names, some = node[at : at + 512], prints[at : at + 512]
                of = self.lead(names, some)
                a.append(names)
                b.append(self.ids[of])
                for k in np.unique(of).tolist():
                    self.members[k].append((names[of == k], some[of == k]))
                self.last = (np.concatenate((self.last[0], names))[-HOT:], np.concatenate((self.last[1], some))[-HOT:])
                beside = _far(some, self.last[1])
                beside[names[:, None] == self.last[0]] = BITS
                rows = np.arange(len(names))
                for _ in range(min(NEAREST, len(self.last[0]))):
                    first = beside[rows].argmin(1)
                    least = beside[rows, first]
                    a.append(names[rows[least <= reach]])
                    b.append(self.last[0][first[least <= reach]])
                    beside[rows, first] = BITS
                    rows = rows[(least <= reach) & (least > clear)]
                far = _far(some, self.own)
                for k in np.flatnonzero(((far <= 2 * reach) & (self.label[of][:, None] != self.label)).any(0)).tolist():
                    for others, theirs in self.members[k]:
                        rows = np.flatnonzero((far[:, k] <= 2 * reach) & (self.label[of] != self.label[k]))
                        if not len(rows):
                            break
                        near = _far(some[rows], theirs) <= reach
                        hit = near.any(1)
                        a.append(names[rows[hit]])
                        b.append(others[near[hit].argmax(1)])
                        merge(self.label, of[rows[hit]], np.full(hit.sum(), k))
            x, y = np.concatenate(a), np.concatenate(b)
            return x[x != y], y[x != y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, key = None, None
        for long, (variant, one, node, prints) in _runs(batches, HOT):
            prints = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, BITS // 64)
            starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
            ends = np.append(starts[1:], len(variant))
            xs, ys = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if long or variant[s] == key:
                    if variant[s] != key:
                        key, large = variant[s], Large()
                    x, y = large.add(node[s:e], prints[s:e])
                else:
                    x, y = bucket((int(variant[s]) >> 32) % SEGMENT == 0, one[s:e], node[s:e], prints[s:e])
                xs.append(x)
                ys.append(y)
            x, y = np.concatenate(xs), np.concatenate(ys)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def _across(similarity: float):
    """Links of rows sorted by group: a variant's two parts p < q, of which the rows of the one are compared with those of
    the other, or p = q, a part's own rows. Of all pairs of different classes those that share no segment before."""

    def group(variant: int, within: bool, one: np.ndarray, left: np.ndarray, root: np.ndarray, words: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        s, bit = divmod(variant >> 32, SEGMENT)
        label = np.unique(root, return_inverse=True)[1]
        sizes = np.array([len(x) for x in sets])
        ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
        held = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), bool)
        for i in range(len(sets)) if within else np.flatnonzero(left).tolist():
            fits = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9) & (sizes > 0)
            if bit:
                fits &= one != one[i]
            fits &= np.arange(len(sets)) > i if within else ~left
            others = np.flatnonzero(fits)
            if s and len(others):
                differ = np.bitwise_count(words[others, :s] ^ words[i, :s])
                differ[:, SEGMENTS:] *= 2
                others = others[(differ > 1).all(1)]
            if not len(others):
                continue
            held[ids[i]] = True
            both = np.add.reduceat(held[np.concatenate([ids[k] for k in others.tolist()])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            held[ids[i]] = False
            for k in others[both >= similarity * (sizes[i] + sizes[others] - both) - 1e-9].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    yield i, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, variant, p, q, part, one, node, root, words, sets) in _runs(batches, sys.maxsize):
            words = np.frombuffer(b"".join(words), ">u4").reshape(-1, SEGMENTS + BANDS).astype(np.uint32)
            change = np.zeros(len(key) - 1, bool)
            for c in (key, variant, p, q):
                change |= c[1:] != c[:-1]
            starts = np.flatnonzero(np.concatenate(([True], change))).tolist()
            a, b = [], []
            for x, y in zip(starts, [*starts[1:], len(key)], strict=True):
                if y - x > 1:
                    own = [np.frombuffer(z, np.uint32) for z in sets[x:y]]
                    for i, k in group(int(variant[x]), bool(p[x] == q[x]), one[x:y], part[x:y] == p[x], root[x:y], words[x:y], own):
                        a.append(node[x + i])
                        b.append(node[x + k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def meetings(nodes: DataFrame) -> DataFrame:
    """(variant, one, node) of the nodes (node, words) that meet another one."""
    variants = map_batches(nodes.select("node", "words"), _variants, "variant long, one boolean, node long").repartition("variant").sortWithinPartitions("variant")
    return cut(variants.mapInArrow(_meeting, "variant long, one boolean, node long"), "meeting")


def candidates(nodes: DataFrame, meeting: DataFrame, reach: int) -> DataFrame:
    """Edges (a, b), a < b, each once, of the first pass between the nodes (node, shingles)."""
    dealt = meeting.join(nodes.select("node", "shingles"), "node").select("variant", "one", "node", "shingles").repartition("variant").sortWithinPartitions("variant", "node")
    found = map_batches(dealt, _verified(reach), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(nodes: DataFrame, meeting: DataFrame, known: DataFrame, found: DataFrame, similarity: float, part: int | None = None, part_bytes: int | None = None) -> DataFrame:
    """Links (a, b) between nodes of different classes, whose components with those classes are those of all pairs of that similarity
    that meet. known: (node, set); found: (node, root), a node that it lacks is a class."""
    rooted = nodes.select("node", "words").join(known, "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    light = meeting.join(rooted.select("node", "root", F.octet_length("set").alias("bytes")), "node")
    sizes = light.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(part or PART)), F.ceil(F.col("bytes") / F.lit(part_bytes or PART_BYTES))).cast("long")
    rows = meeting.join(sizes.select("variant", parts.alias("parts")), "variant").withColumn("part", F.expr("pmod(node, parts)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    rows = rows.join(rooted, "node").select(F.xxhash64("variant", "p", "q").alias("key"), "variant", "p", "q", "part", "one", "node", "root", "words", "set")
    return map_batches(rows.repartition("key").sortWithinPartitions("key", "variant", "p", "q"), _across(similarity), "a long, b long")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = text.lower().split()
    pieces = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, pieces), np.uint32, len(pieces)))


def _alike(similarity: float):
    """The edges whose sets are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs with one left of each group of near-duplicates, columns as they were: the one with the least id
    (null last), and among rows of that id the least by a hash of the whole row. Of rows that agree in all columns one
    stays."""
    held = held_rows(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shingles = zip(*(two_fingerprints(x, shingle) for x in text_bytes(batch.column(2))), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array(shingles, pa.binary())], ["_id", "_hash", "words", "shingles"])

    own = held.select("_id", "_hash", F.col(f"row.`{text_col}`").alias("text"))
    rows = cut(map_batches(own, run, "_id long, _hash long, words binary, shingles binary").withColumn("node", F.xxhash64("words", "shingles")), "fingerprints")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_hash"))
    nodes = cut(rows.groupBy("node", "words", "shingles").agg(F.min(order).alias("least")), "nodes")
    names = rows.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_n"))

    meeting = meetings(nodes)
    edges = cut(candidates(nodes, meeting, distance(similarity)), "candidates")
    ends = meeting.select("node").distinct()
    ends = nodes.join(ends, "node").select(F.col("least._id").alias("_id"), F.col("least._hash").alias("_hash"), "node")
    ends = cut(null_safe_join(ends, names, ["_id", "_hash"]), "ends")
    # The texts are read again where they are; only the sets of those that meet others are shuffled.
    table = docs.sparkSession.sparkContext.broadcast(Bitmap(ends, "_hash", 16, lambda bits: (0, 18, 36)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = pa.array(table.value.passing(batch.column(1).to_numpy().view(np.uint64)))
            found = [shingle_set(x, shingle).tobytes() for x in text_bytes(batch.column(2).take(take))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.binary())], ["_id", "_hash", "set"])

    passing = cut(map_batches(own, sets, "_id long, _hash long, set binary"), "passing")
    table.unpersist()
    known = cut(one_each(passing, ends).select("node", "set"), "sets")

    pairs = edges.join(known.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    found = cut(components(cut(map_batches(pairs.select("a", "b", "x", "y"), _alike(similarity), "a long, b long"), "links")), "classes")
    more = cut(across(nodes, meeting, known, found, similarity), "links")
    if not more.isEmpty():
        found = components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    linked = nodes.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    best = linked.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._id").alias("_id"), F.col("least._hash").alias("_hash")).distinct()
    best = cut(null_safe_join(best, names, ["_id", "_hash"]), "kept")
    return unheld(one_each(held, best), docs.schema)
