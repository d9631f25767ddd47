"""Mixing, quality rules, sharding, SimHash and repeated strings against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, quality_rules, sharding, simhash, suffix
from lodestone.llm.common import components, with_prefix, with_running

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Shared parts.


def test_running_totals(spark):
    rows = [(g, i * 7919 % (1 << 31), i % 5) for i in range(9000) for g in (None if i % 3 else "hot",)]
    df = spark.createDataFrame(rows, "g string, h long, v long")
    found = with_running(df, ["g"], ["v"], "h", "v", len(rows), "t").collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.h, r.v)):
        by[r.g].append(r)
    assert len(found) == len(rows)
    for group in by.values():
        assert [r.t for r in group] == np.cumsum([r.v for r in group]).tolist()


def test_prefix(spark):
    df = spark.createDataFrame([(i * 31 % 1000, i) for i in range(1000)], "k long, v long").repartition(5)
    found = sorted((r.k, r.v, r.t) for r in with_prefix(df, ["k"], "v", "t").collect())
    assert [r[2] for r in found] == np.cumsum([r[1] for r in found]).tolist()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(2000, k) for k in range(2001, 2600)] + [(5, 5)]
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Quality rules.


def test_ledger_equals_plain_measures(spark, odd_docs):
    for docs in (documents(spark), odd_docs):
        texts = Counter((r.doc_id, brute.quality(r.text)) for r in docs.collect())
        found = quality_rules.ledger(docs).collect()
        assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found) == texts


def test_policies_and_ablation(spark):
    entries = quality_rules.apply_policy(quality_rules.ledger(documents(spark)), quality_rules.STRICT).persist()
    rows = entries.collect()
    for r in rows:
        assert r.kept == (r.failed & quality_rules.STRICT.mask == 0)
        assert bool(r.failed & 1) == (r.n_words < 50) and bool(r.failed & 2) == (100 * r.n_repeat_words > 50 * r.n_words)
    for a in quality_rules.ablation(entries, quality_rules.STRICT).collect():
        bit = 1 << quality_rules.BITS[a.rule]
        assert a.n_failed == sum(bool(r.failed & bit) for r in rows)
        assert a.n_failed_alone == sum(r.failed == bit for r in rows)
        assert a.n_kept_without == sum(r.failed & ~bit == 0 for r in rows)


def test_rules_find_the_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.STRICT).join(labels, "doc_id").where("n_words >= 50")
    table = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert table.get((0, True), 0) == 0 and table.get((1, False), 0) <= 0.01 * table[1, True]


def test_kept_rows(spark, odd_docs, no_docs):
    for docs in (documents(spark), odd_docs):
        kept = quality_rules.keep_rows(docs)
        assert kept.columns == docs.columns
        verdicts = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.STRICT)
        assert kept.count() == verdicts.where("kept").count()
        assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))
    assert quality_rules.keep_rows(no_docs).count() == quality_rules.ledger(no_docs).count() == 0


# Mixing.


def check_mix(docs, rows, weights=(1, 2, 3), epochs=3):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, len(brute.words(r.text))) for r in docs.collect())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        level = (total - sum(epochs * sizes[s] for s in full)) / free if free else 0
        more = {s for s in order if s not in full and epochs * sizes[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    taken, longest = Counter(), max((r.size for r in rows), default=0)
    for r in rows:
        target = epochs * sizes[r.source] if r.source in full else level * weight[r.source]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target)
        assert 0 <= r.taken <= epochs * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert total - longest <= sum(taken.values()) <= total
    for s in order:
        target = epochs * sizes[s] if s in full else level * weight[s]
        assert abs(taken[s] - target) <= longest + 1


def test_mix(spark, odd_docs, no_docs):
    for docs in (documents(spark), odd_docs):
        first = mixing.mix(docs).collect()
        check_mix(docs, first)
        assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, first))
    assert mixing.mix(no_docs).count() == 0


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(i, " ".join(["w"] * 20), "big" if i > 4 else f"s{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    check_mix(docs, found)
    assert max(r.taken for r in found if r.source == "s1") == 60


def test_mixed_rows(spark, odd_docs):
    for docs in (documents(spark), odd_docs):
        out = mixing.mix_rows(docs)
        assert out.columns == docs.columns
        taken = Counter()
        for r in mixing.mix(docs).collect():
            taken[r.doc_id, r.source] += r.taken
        got = Counter()
        for r in out.collect():
            got[r.doc_id, r.source] += len(brute.words(r.text))
        assert +got == +taken


# Sharding.


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, odd_docs, law):
    grouped = spark.createDataFrame([(i, f"text {i % 211 if i % 3 else 0} " * 9, "en", "s", 1) for i in range(1200)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (grouped, odd_docs, documents(spark)):
        rows = sharding.shard(docs, 40, law).collect()
        texts = docs.collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((t.doc_id, len((t.text or "").encode()) + 16, zlib.crc32((t.text or "").encode())) for t in texts)
        by = defaultdict(list)
        for r in rows:
            assert r.law == law and r.grown_shard is None and 0 <= r.shard < 40
            by[r.shard].append(r)
        for s in by.values():
            assert sorted(r.slot for r in s) == list(range(len(s)))
        if law == "rows":
            counts = [len(by[t]) for t in range(40)]
            assert max(counts) - min(counts) <= 1
        else:
            loads = [sum(r.size for r in by[t]) for t in range(40)]
            assert max(loads) - min(loads) <= 2 * max(r.size for r in rows) + 40


def test_small_groups_share_a_shard(spark):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(1200)], "doc_id long, text string")
    by = defaultdict(set)
    for r in sharding.shard(docs, 40, "rows").collect():
        by[r.text_crc32].add(r.shard)
    alone = sum(len(s) == 1 for s in by.values())
    assert alone > 0.7 * len(by)


def test_no_rows_and_unknown_law(no_docs):
    assert sharding.shard(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(no_docs, law="none")


# SimHash.


def check_simhash(docs, shingle=3, reach=2):
    rows = simhash.near_duplicates(docs, shingle=shingle, reach=reach).collect()
    texts = docs.select("doc_id", "text").collect()
    fps = sorted({brute.fingerprint(t.text, shingle) for t in texts})
    label = dict(zip(fps, brute.classes(fps, reach), strict=True))
    least = {}
    for t in texts:
        k = label[brute.fingerprint(t.text, shingle)]
        if t.doc_id is not None:
            least[k] = min(least.get(k, t.doc_id), t.doc_id)
    expected = Counter((t.doc_id, f"{(f := brute.fingerprint(t.text, shingle)):016x}", least.get(label[f])) for t in texts)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected


def test_simhash(spark, odd_docs, no_docs):
    check_simhash(odd_docs)
    check_simhash(documents(spark))
    check_simhash(odd_docs, 5, 3)
    assert simhash.near_duplicates(no_docs).count() == 0


def planted(n, r, bits):
    """Fingerprints in chains and crowds: links of up to `bits` bits, on both segments."""
    out = {0, (1 << 64) - 1}
    for _ in range(n):
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            out.add(f)
            for b in r.sample(range(64), r.randrange(1, bits + 2)):
                f ^= 1 << b
    crowd = r.getrandbits(64)
    out |= {crowd ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for _ in range(n)}
    return sorted(out)


@pytest.mark.parametrize("reach, hot", [(2, 4096), (2, 3), (3, 4096), (3, 4)])
def test_links_lose_nothing(spark, monkeypatch, reach, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = planted(60 if hot > 10 else 15, random.Random(reach), reach)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), reach).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all(1 <= (unsigned(a) ^ unsigned(b)).bit_count() <= reach for a, b in edges)
    place = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(place[unsigned(a)]), find(place[unsigned(b)])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == brute.classes(fps, reach)


# Repeated strings.


def check_repeats(docs):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    expected = Counter((d, *x) for (d, _), x in zip(texts, brute.repeats([t for _, t in texts]), strict=True))
    found = suffix.digests(suffix.remove_repeats(docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected


def repeated_docs(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(70), text(45), "same " * 90, "z" * 333, text(35)[:199], text(60)[:200]]
    rows = []
    for i in range(120):
        pieces = [text(r.randrange(0, 60)) for _ in range(r.randrange(0, 4))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, 30)
            pieces.insert(r.randrange(0, len(pieces) + 1), p[a:])
        rows.append((i, "".join(pieces)))
    rows += [(200, rows[3][1]), (201, rows[5][1] + "tail"), (5, rows[5][1]), (None, rows[7][1]), (202, None), (203, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    check_repeats(repeated_docs(spark, hot))


def test_repeats_of_real_and_odd_texts(spark, odd_docs, no_docs):
    check_repeats(documents(spark).where("n_chars < 6000"))
    check_repeats(odd_docs.where("n_chars < 1000 OR n_chars IS NULL"))
    assert suffix.remove_repeats(no_docs).count() == 0


def test_segments_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 300)
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in (0, 150, 200, 201, 1000, 0, 399, 200)] + [b"ab" * 400]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    row, start, windows, place, anchor = suffix.segments(flat, offsets)
    seen = Counter((int(a), int(b) + k) for a, b, n in zip(row, start, windows, strict=True) for k in range(n))
    assert seen == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 199))
    same = {}
    for a, b, n, p, h in zip(row, start, windows, place, anchor, strict=True):
        for k in range(n):
            assert same.setdefault(texts[a][b + k : b + k + 200], (h, p - k)) == (h, p - k)
