from collections import Counter

import brute
import pytest

import corpus_pipeline
from lodestone.llm import decontamination, quality_rules
from lodestone.llm.common import cut
from test_similar import expected
from test_texts import alignments

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name))
    return [x.toPandas() for x in out]


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_against_plain_versions(spark, stages):
    docs, good, single, clean, mixed, shards = stages
    for x in (good, single, clean, mixed):
        assert list(x.columns) == list(docs.columns)
    verdicts = quality_rules.apply_policy(quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")), quality_rules.STRICT).where("kept").toPandas()
    assert sorted(good.doc_id) == sorted(verdicts.doc_id)

    assert Counter((False, d) for d in single.doc_id) == expected(list(good.itertuples()))

    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    cut_up = lambda t: decontamination._TOKEN.findall((t or "").lower())
    passages = [cut_up(r.text) for r in items]
    enough = lambda t, p: sum((Counter(t) & Counter(p)).values()) >= min(8, len(p)) > 0
    leaking = {d for d, t in zip(single.doc_id, map(cut_up, single.text), strict=True) if any(enough(t, p) and alignments(t, p) for p in passages)}
    gone = set(single.doc_id) - set(clean.doc_id)
    assert gone <= leaking and len(gone) >= 0.95 * len(leaking) > 0

    sizes = {d: len(brute.words(t)) for d, t in zip(clean.doc_id, clean.text, strict=True)}
    times = Counter(mixed.doc_id)
    assert max(times.values()) <= 3 and set(times) <= set(sizes)
    total = sum(sizes.values())
    assert total - max(sizes.values()) <= sum(sizes[d] * n for d, n in times.items()) <= total

    counts = Counter(shards.shard)
    assert Counter(shards.doc_id) == times and len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1


def test_run_returns_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(found.doc_id, found["size"], strict=True)) == Counter(zip(stages[-1].doc_id, stages[-1]["size"], strict=True))
