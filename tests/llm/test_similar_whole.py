"""Near-duplicates that differ in one contiguous passage, and large variants against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import similar
from test_similar import copies, expected, jaccard, kept, roots


def passages(kind, n=120, seed=6):
    """Originals at even ids, and behind each a copy that shares 0.82 to 0.9 of its five-word shingles."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    rows = []
    while len(rows) < 2 * n:
        words = [r.choice(vocabulary) for _ in range(r.randrange(150, 600))]
        k = len(words) // 8
        fresh = [r.choice(vocabulary) for _ in range(k)]
        at = r.randrange(len(words) - k)
        copy = {"appended": words + fresh, "prepended": fresh + words, "truncated": words[:-k], "replaced": words[:at] + fresh[: k // 2] + words[at + k // 2 :]}[kind]
        texts = [" ".join(x) for x in (words, copy)]
        if 0.82 <= jaccard(*texts) <= 0.9:
            rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("kind", ["appended", "prepended", "truncated", "replaced"])
def test_copies_with_another_passage_go(spark, kind):
    rows = passages(kind)
    out = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    originals = {i for i, _ in rows if i % 2 == 0}
    assert originals <= out and len(out - originals) <= 0.05 * len(originals)


@pytest.mark.parametrize(("hot", "size"), [(3, 40), (50, 700), (400, 1500)])
def test_large_variants_link_what_all_pairs_link(monkeypatch, hot, size):
    """One variant of members that are near some, not all, of their group: the components of a comparison of all."""
    monkeypatch.setattr(similar, "HOT", hot)
    r, reach = np.random.default_rng(size), similar.distance(0.8)
    bits = r.integers(0, 2, (6, similar.BITS))[r.integers(0, 6, size)]
    for row in bits:
        row[r.choice(similar.BITS, r.integers(12, 38), replace=False)] ^= 1
    prints = np.packbits(bits.astype(np.uint8), axis=1)
    table = pa.table({"variant": pa.array([5] * size, pa.int64()), "one": pa.array([True] * size), "node": pa.array(range(size), pa.int64()), "shingles": pa.array([p.tobytes() for p in prints], pa.binary())})
    table = pa.concat_tables([table, table.set_column(0, "variant", pa.array([32 << 32] * size, pa.int64()))])
    found = [(a, b) for batch in similar._verified(reach)(iter(table.to_batches(max_chunksize=97))) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    far = (bits[:, None, :] != bits[None, :, :]).sum(2)
    assert all(far[a, b] <= reach for a, b in found)
    near = [(a, b) for a, b in np.argwhere(np.triu(far <= reach, 1)).tolist()]
    assert roots(size, found) == roots(size, near) and 1 < len(set(roots(size, near))) < size


def test_large_groups_leave_what_all_pairs_leave(spark, monkeypatch):
    rows = copies(4, 80, seed=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string, first boolean")
    monkeypatch.setattr(similar, "HOT", 8)
    assert kept(similar.keep_one(docs)) == expected(docs.collect())


@pytest.mark.parametrize("rest", [1, 2])
def test_the_rest_of_a_long_variant_meets_too(monkeypatch, rest):
    monkeypatch.setattr(similar, "LONG", 10, raising=False)
    variants = [(3 << 32) | 7] * (12 + rest) + [(4 << 32) | 7]
    ones = [i % 2 == 0 for i in range(12)] + [True] * (rest + 1)
    table = pa.table({"variant": pa.array(variants, pa.int64()), "one": ones, "node": pa.array(range(13 + rest), pa.int64())})
    found = [n for batch in similar._meeting(iter(table.to_batches(max_chunksize=12))) for n in batch.column(2).to_pylist()]
    assert found == list(range(12 + rest))
