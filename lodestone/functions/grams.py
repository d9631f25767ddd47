"""Grams of byte strings: three-byte windows as 24-bit numbers, pairs with their frequency, and sparse grams chosen by
the rarity of pairs at their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as bt

#: Pairs that a sparse gram spans at most, and grams that cover a literal.
MAX_SPAN, MAX_COVERING = 24, 12

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fold(content: bytes) -> bytes:
    """ASCII letters in lower case."""
    return content.translate(_FOLD)


def pack_trigrams(content: bytes) -> np.ndarray:
    """The distinct three-byte windows as big-endian numbers, ascending."""
    b = np.frombuffer(content, np.uint8).astype(np.int32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    grams = np.sort((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])
    return grams[np.append(True, grams[1:] != grams[:-1])].astype(np.int64)


def unpack_trigram(gram: int) -> bytes:
    return int(gram).to_bytes(3, "big")


def gram_hash(gram: bytes) -> int:
    """The public hash of a gram: XXH3, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(gram)).astype(np.int64))


def trigram_hashes(grams: np.ndarray) -> np.ndarray:
    """gram_hash() of packed windows: XXH3 of three bytes with its default secret."""
    g = grams.astype(np.uint64)
    u = np.uint64
    h = (((g >> u(16)) << u(16)) | (((g >> u(8)) & u(255)) << u(24)) | (g & u(255)) | u(3 << 8)) ^ u(0x396CFEB8 ^ 0xBE4BA423)
    h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
    return (h ^ (h >> u(32))).astype(np.int64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def holding(content: Column, branches: list[set[int]], folded: bool = False) -> Column:
    """Whether a text has all grams of a branch: one bit of it leaves Python, not its grams."""
    wanted = [np.array(sorted(b), np.int64) for b in branches]

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        own = lambda b: pack_trigrams(b"" if b is None else fold(bytes(b)) if folded else bytes(b))
        return texts.map(lambda b: (lambda g: any(np.isin(w, g).all() for w in wanted))(own(b))).astype(bool)

    return run(content)


def trigrams(content: Column, folded: bool = False) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda b: np.zeros(0, np.int64) if b is None else pack_trigrams(fold(bytes(b)) if folded else bytes(b)))

    return run(content)


def bigram_frequency(docs: DataFrame) -> DataFrame:
    """(key, freq) over the contents of docs; key is first byte * 256 + second. Each piece of the texts is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for piece in bt.pieces(batches):
            texts = [np.frombuffer(t.as_py() or b"", np.uint8).astype(np.uint16) for t in piece.column(0)]
            total += np.bincount(np.concatenate([np.zeros(0, np.uint16), *((b[:-1] << 8) | b[1:] for b in texts)]), minlength=1 << 16)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["key", "freq"])

    return docs.select("content").mapInArrow(run, "key long, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))


class Rarity:
    """Weights of pairs: the largest frequency minus a pair's own, plus one. At most 65,536 numbers."""

    def __init__(self, frequency: dict[int, int]) -> None:
        self.frequency = frequency
        self.largest = max(frequency.values(), default=1)

    @classmethod
    def of(cls, bigrams: DataFrame) -> Rarity:
        return cls({int(r["key"]): int(r["freq"]) for r in bigrams.collect()})  # one row per pair of bytes at most

    def weights(self, content: bytes) -> np.ndarray:
        if not hasattr(self, "_table"):
            table = np.zeros(1 << 16, np.int64)
            for k, v in self.frequency.items():
                table[k] = v
            self._table = np.maximum(0, self.largest - table) + 1
        b = np.frombuffer(content, np.uint8).astype(np.int64)
        return self._table[(b[:-1] << 8) | b[1:]] if len(b) >= 2 else np.zeros(0, np.int64)


def sparse_spans(content: bytes, rarity: Rarity) -> list[tuple[int, int, int]]:
    """(start, end, score) of the sparse grams: windows whose first and last pair are both rarer than all between, in the
    order of their start and then end, each text once. All of them, so no document is missed by a gram that stands late in it."""
    w = rarity.weights(content)
    found = []
    if len(w) >= 2:
        inside = np.zeros(len(w) - 1, np.int64)
        for gap in range(1, min(MAX_SPAN, len(w))):
            n = len(w) - gap
            if gap > 1:
                inside = np.maximum(inside[:n], w[gap - 1 : gap - 1 + n])
            left, right = w[:n], w[gap:]
            at = np.flatnonzero((left > inside[:n]) & (right > inside[:n]))
            found.append(np.column_stack([at, at + gap + 2, np.minimum(left, right)[at]]))
    out, seen = [], set()
    if found:
        rows = np.concatenate(found)
        for a, b, score in rows[np.lexsort((rows[:, 1], rows[:, 0]))].tolist():
            if (gram := content[a:b]) not in seen:
                seen.add(gram)
                out.append((a, b, score))
    return out


def sparse_ngrams(content: bytes, rarity: Rarity) -> list[bytes]:
    return [content[a:b] for a, b, _ in sparse_spans(content, rarity)]


def covering_ngrams(literal: bytes, rarity: Rarity, limit: int = MAX_COVERING) -> list[bytes]:
    """Sparse grams of a literal that cover it: rarest first, longer first among equals, each with a byte not covered yet."""
    if len(literal) < 3:
        return []
    covered, out = np.zeros(len(literal), bool), []
    for a, b, _ in sorted(sparse_spans(literal, rarity), key=lambda g: (-g[2], g[0] - g[1])):
        if len(out) >= limit or covered.all():
            break
        if not covered[a:b].all():
            covered[a:b] = True
            out.append(literal[a:b])
    return out or [literal[:3]]


def index_hashes(content: bytes, rarity: Rarity) -> np.ndarray:
    """Hashes of a text's windows of three bytes, and of its sparse grams."""
    sparse = [gram_hash(content[a:b]) for a, b, _ in sparse_spans(content, rarity)]
    return np.unique(np.concatenate([trigram_hashes(pack_trigrams(content)), np.array(sparse, np.int64)]))


def hash_column(content: Column, rarity: Rarity) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda b: np.zeros(0, np.int64) if b is None else index_hashes(bytes(b), rarity))

    return run(content)


def sparse_column(content: Column, rarity: Rarity) -> Column:
    @F.pandas_udf("array<binary>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda b: [] if b is None else sparse_ngrams(bytes(b), rarity))

    return run(content)
