"""What the first pass over near-duplicates leaves out, against all pairs."""

import random

import pytest

from lodestone.llm import similar
from test_similar import copies, expected, kept


def family(seed, n=100, twins=20):
    """Texts that share 0.78 of their shingles with each other, and behind them twins of some that share 0.81: among so
    many texts about as far by fingerprint, the twin is seldom one of the closest."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(3, 9)))
    template = [word() for _ in range(268)]
    texts = [[*template[:100], *[word() for _ in range(32)], *template[100:]] for _ in range(n)]
    texts += [[*t[:106], *[word() for _ in range(26)], *template[100:]] for t in texts[:twins]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "part", "part_bytes"), [(0, 1 << 13, 8 << 20), (1, 7, 8 << 20), (2, 1 << 13, 9000)])
def test_partners_that_are_not_among_the_closest_go(spark, monkeypatch, seed, part, part_bytes):
    """In one group, and in parts by rows and by bytes."""
    monkeypatch.setattr(similar, "PART", part, raising=False)
    monkeypatch.setattr(similar, "PART_BYTES", part_bytes, raising=False)
    docs = spark.createDataFrame(family(seed), "doc_id long, text string")
    whole = expected(docs.collect())
    assert sum(whole.values()) == 100 and kept(similar.keep_one(docs)) == whole


@pytest.mark.parametrize("part", [1 << 13, 5])
def test_texts_far_by_fingerprint_that_meet_go(spark, monkeypatch, part):
    """The first pass finds hardly a candidate: all that meet are verified without it."""
    monkeypatch.setattr(similar, "SLACK", -30)
    monkeypatch.setattr(similar, "PART", part, raising=False)
    docs = spark.createDataFrame(copies(25, 12, seed=3), "doc_id long, text string, first boolean")
    whole = expected(docs.collect())
    assert sum(whole.values()) < docs.count() and kept(similar.keep_one(docs)) == whole
