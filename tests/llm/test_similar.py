"""Near-duplicates of a stated similarity against a comparison of all pairs."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from lodestone.llm import similar


def shingles(text, n=5):
    w = [x for x in re.split("[ \\t\\n\\r\\x0b\\x0c]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def pairs(sets, similarity):
    """All pairs of different sets that are that similar, by the shingles that they share."""
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = Counter()
    for found in holders.values():
        common.update(combinations(found, 2))
    return [(i, j) for (i, j), n in common.items() if n >= similarity * (len(sets[i]) + len(sets[j]) - n)]


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(x) for x in range(n)]


def expected(rows, similarity=0.8):
    """The ids that stay if every pair of texts is compared."""
    sets = [shingles(r.text) for r in rows]
    places = {s: k for k, s in enumerate(dict.fromkeys(sets))}
    label = roots(len(places), pairs(list(places), similarity))
    least = {}
    for s, r in zip(sets, rows, strict=True):
        key, root = (r.doc_id is None, r.doc_id or 0), label[places[s]]
        least[root] = min(least.get(root, key), key)
    return Counter(least.values())


def kept(df):
    return Counter((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def copies(n_originals, n_copies, seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    texts = []
    for _ in range(n_originals):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60, 400))]
        texts.append((words, True))
        for _ in range(r.randrange(0, n_copies + 1)):
            edited = list(words)
            for _ in range(max(1, len(words) // 60)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            texts.append((edited, False))
    return [(i, " ".join(w), first) for i, (w, first) in enumerate(texts)]


def test_all_pairs_agree(spark, odd_docs, no_docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for docs in (real, odd_docs):
        out = similar.keep_one(docs)
        assert out.columns == docs.columns
        assert kept(out) == expected(docs.collect())
    assert similar.keep_one(no_docs).count() == 0


def test_recall_on_a_whole_table(spark):
    """Of the rows that a comparison of all pairs would drop nine tenths go at least, and nothing else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    stay, whole = kept(similar.keep_one(docs)), expected(rows)
    assert not whole - stay
    different = len(set(sets.values()))
    gone = {name: different - len({sets[i] for _, i in ids}) for name, ids in (("found", stay), ("all", whole))}
    assert gone["found"] >= 0.9 * gone["all"] > 30
    assert sum(stay.values()) - sum(whole.values()) <= 0.1 * gone["all"]


@pytest.mark.parametrize("hot", [4096, 20])
def test_families_below_the_threshold_stay(spark, monkeypatch, hot):
    """Texts of one template that share 0.7 of their shingles, and a few copies: no chain of links runs through the family."""
    monkeypatch.setattr(similar, "HOT", hot)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(3, 9)))
    template = [word() for _ in range(300)]
    texts = []
    for _ in range(120):
        at = r.randrange(240)
        texts.append([*template[:at], *[word() for _ in range(60)], *template[at + 60 :]])
    texts += [[*t[:100], word(), *t[101:]] for t in texts[:20]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    stay, whole = kept(similar.keep_one(docs)), expected(docs.collect())
    assert not whole - stay and sum((stay - whole).values()) <= 2 and sum(whole.values()) > 60


def test_lightly_edited_copies_go_and_others_stay(spark):
    rows = copies(150, 3)
    out = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, first boolean")).collect()}
    originals = {i for i, _, first in rows if first}
    texts = {i: t for i, t, _ in rows}
    assert originals <= out
    close = [i for i, _, first in rows if not first and jaccard(texts[i], texts[max(o for o in originals if o < i)]) >= 0.8]
    assert len(close) > 100 and sum(i not in out for i in close) >= 0.95 * len(close)


@pytest.mark.parametrize("hot", [3, 8])
def test_large_groups_leave_one_each(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT", hot)
    rows = copies(6, 60, seed=4)
    out = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, first boolean")).collect()}
    assert {i for i, _, first in rows if first} <= out and len(out) <= 10
