"""The registered queries over a whole small table: their columns, and their rows against SQL or a plain version."""

import hashlib
import zlib
from collections import Counter

import brute
import duckdb
import pytest

from lodestone.llm import decontamination
from lodestone.llm.queries import QUERIES
from lodestone.llm.sql import SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op2_decontamination": ["doc_id", "item_id"], "op3_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op4_quality_classifier": ["doc_id", "score", "kept"], "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op6_html": ["page_id", "url", "text", "n_chars"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "quality_ablation": ["rule", "n_failed", "n_failed_alone", "n_kept_without"],
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return tables.sql("SELECT doc_id, text FROM documents").fetchall()


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple("" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def result(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(df.columns)
    return df.toPandas()


def test_registered_queries():
    assert set(QUERIES) == set(COLUMNS) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    assert rows(result(spark, name)) == rows(tables.sql(SQL[name]).df())


def test_op2(spark, tables, texts):
    items = tables.sql("SELECT item_id, text FROM benchmark").fetchall()
    found = result(spark, "op2_decontamination")
    plain = lambda t: " ".join(decontamination._TOKEN.findall((t or "").lower()))
    held = {(d, i) for d, t in texts for i, x in items if plain(x) in plain(t)}
    assert held and held <= set(zip(found.doc_id, found.item_id, strict=True))
    assert {d for d, _ in held} <= set(found.doc_id) and (found.matched <= found.item_tokens).all()


def test_op4(spark, texts):
    found = result(spark, "op4_quality_classifier")
    assert Counter(found.doc_id) == Counter(d for d, _ in texts) and found.score.between(0, 1).all()


def test_op6(spark, tables):
    found = result(spark, "op6_html")
    assert len(found) == len(tables.sql("SELECT page_id FROM pages").fetchall())
    assert (found.n_chars == found.text.map(len)).all() and found.text.notna().all()


def test_op7(spark, texts):
    found = result(spark, "op7_sharding")
    assert Counter(zip(found.doc_id, found["size"], found.text_crc32, strict=True)) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    counts = Counter(found.shard)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(40)) and set(found.law) == {"rows"}


def test_op8(spark, texts):
    found = result(spark, "op8_secrets")
    expected = Counter()
    for d, t in texts:
        spans = brute.secrets(t)
        kinds = Counter(k for _, k, _ in spans)
        expected[d, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()] += 1
    assert Counter(zip(found.doc_id, found.n_assign, found.n_access, found.n_hex, found.base_sha256, strict=True)) == expected


def test_op9(spark, texts):
    found = result(spark, "op9_simhash")
    fps = [brute.fingerprint(t, 3) for _, t in texts]
    distinct = sorted(set(fps))
    label = dict(zip(distinct, brute.classes(distinct, 2), strict=True))
    least = {}
    for (d, _), f in zip(texts, fps, strict=True):
        least[label[f]] = min(least.get(label[f], d), d)
    assert Counter(zip(found.doc_id, found.fingerprint, found.component_id, strict=True)) == Counter((d, f"{f:016x}", least[label[f]]) for (d, _), f in zip(texts, fps, strict=True))


def test_op10(spark, texts):
    found = result(spark, "op10_suffix")
    expected = Counter((d, *x) for (d, _), x in zip(texts, brute.repeats([(t or "").encode() for _, t in texts]), strict=True))
    assert Counter(zip(found.doc_id, found.n_bytes, found.n_removed, found.n_spans, found.kept_sha256, strict=True)) == expected
