"""What Python holds at once doesn't grow with the rows of a batch, nor the build with passes over the texts."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import batches as bt
from lodestone.functions.dialect import compile_pattern
from lodestone.functions.grams import fold, gram_hash, pack_trigrams, trigram_hashes, unpack_trigram
from lodestone.functions.positions import located, match_rows, match_spans, regex_finder
from lodestone.operators import index as ix
from lodestone.operators.search import HashSearchOptions, SearchOptions, Sources, hash_search, regex_search
from lodestone.sources.corpus import from_table


class Frame:
    """Stands for a DataFrame whose mapInArrow() shows what one task yields."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def texts_of(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([False] * n), pa.array(range(n), pa.int64()), pa.array(map(str, range(n))), pa.array(texts, pa.binary())], ["is_overlay", "doc_id", "path", "content"])


def test_matches_leave_in_batches_bounded_by_bytes():
    """a line with many matches is in all their snippets, and one batch has many such texts."""
    texts = [b"and so on " * 300] * 400
    out = match_rows(Frame(texts_of(texts)), regex_finder(compile_pattern("and "), 50))
    assert sum(map(len, out)) == 400 * 50
    assert max(b.nbytes for b in out) < 2 * bt.BATCH_BYTES < sum(b.nbytes for b in out)
    assert [r["doc_id"] for b in out for r in b.to_pylist()] == [i for i in range(400) for _ in range(50)]


@pytest.mark.parametrize("size", [1, 300, 1 << 30])
@pytest.mark.parametrize("cap", [None, 2])
def test_matches_are_the_same_in_pieces_of_any_size(monkeypatch, size, cap):
    texts = [("and " * (i % 7) + "x\n" + "wand é and \n" * (i % 3)).encode() if i % 11 else None for i in range(60)]
    monkeypatch.setattr(bt, "BATCH_BYTES", size)
    out = match_rows(Frame(texts_of(texts)), regex_finder(compile_pattern("and "), cap))
    found = [(r["path"], r["byte_offset"], r["end_offset"], r["snippet"]) for b in out for r in b.to_pylist()]
    spans = lambda t: match_spans(compile_pattern("and ").build(), t, cap)
    assert found == [(str(i), r["byte_offset"], r["end_offset"], r["snippet"]) for i, t in enumerate(texts) if t for r in located(spans(t), t, True)]


@pytest.mark.parametrize("name", ["limit_max_results", "limit_zero_is_default"])
def test_limited_query_equals_sql_in_order(spark, name):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = [tuple(r) for r in entry.queries()[name](spark, "/root/testdata/sf0.001").collect()]
    assert found == con.sql(entry.oracle_sql()[name]).fetchall()


def corpus_of(spark, texts):
    df = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return from_table(df.repartition(3), F.col("doc_id"), F.col("path"), F.col("text"), "t")


MANY = ["MIT License", "mit LICENSE Apache", "", "ab", "Lic ice cen ens nse", "é License\n"] + [f"License of {i} {i * i}" for i in range(300)]


@pytest.mark.parametrize("long_grams", [False, True])
def test_stored_tables_are_those_of_the_texts(spark, tmp_path, long_grams):
    """written from lists that are split at LISTED_DOCS documents."""
    corpus = corpus_of(spark, MANY)
    built = ix.build(corpus, long_grams)
    ix.write(built, str(tmp_path), corpus)
    stored = ix.load(spark, str(tmp_path), corpus)
    rows = lambda df: sorted(map(tuple, df.collect()))
    own = lambda made: sorted((int(g), i) for i, t in enumerate(MANY) for g in pack_trigrams(made(t.encode())))
    assert rows(stored.postings) == own(bytes) and rows(stored.folded) == own(fold)
    assert rows(stored.hashes) == rows(built.hashes) and rows(stored.counts) == rows(built.counts)
    assert long_grams or rows(stored.hashes) == sorted((gram_hash(unpack_trigram(g)), i) for g, i in own(bytes))


def test_build_reads_the_texts_once_for_all_postings(spark, tmp_path):
    """the range partitioning samples what it sorts, and each table was made from the texts twice and more."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    df = spark.createDataFrame([(i, t) for i, t in enumerate(MANY)], "doc_id long, text string").select("doc_id", counted("text").alias("text"))
    corpus = from_table(df, F.col("doc_id"), F.col("doc_id").cast("string"), F.col("text"), "t")
    index = ix.build(corpus, False)
    ix.write(ix.Index(corpus.meta.limit(0), index.postings, index.folded, index.hashes, index.bigrams.limit(0), index.counts, docs=index.docs), str(tmp_path), corpus)
    assert 0 < read.value < 4 * len(MANY)


@pytest.mark.parametrize("native", [64, 0])
@pytest.mark.parametrize("case", [True, False])
@pytest.mark.parametrize("pattern", ["License", "MIT License|Apache", "é License"])
def test_scan_and_index_admit_the_same_documents(spark, monkeypatch, pattern, case, native):
    """a text with all grams but not the string is a candidate, as it is in SQL; no grams of texts leave Python."""
    monkeypatch.setattr("lodestone.plans.candidates.NATIVE_GRAMS", native)
    corpus = corpus_of(spark, MANY[:12])
    ids = lambda use: sorted(r.doc_id for r in regex_search(Sources(corpus, ix.build(corpus, False)), pattern, SearchOptions(return_mode="paths", use_index=use, case_sensitive=case)).candidates.collect())
    assert ids("never") == ids("always")
    assert pattern != "License" or 4 in ids("never")


def test_hashes_of_windows():
    """F4, F6, F8: hashes are worked out for whole arrays; no join with a dictionary of all grams."""
    grams = np.array([0, 1, 255, 256, 0x4C6963, 0xFFFFFF, *range(0, 1 << 24, 99_991)], np.int64)
    assert trigram_hashes(grams).tolist() == [gram_hash(unpack_trigram(g)) for g in grams]


@pytest.mark.parametrize("logic", ["and", "or"])
def test_hash_search_takes_only_wanted_postings(spark, logic):
    corpus = corpus_of(spark, MANY[:20])
    wanted = [gram_hash(b"Lic"), gram_hash(b"MIT")]
    index = ix.build(corpus, False)
    assert {r.hash for r in index.hashed(wanted).collect()} == set(wanted)
    found = hash_search(Sources(corpus, index), wanted, logic, HashSearchOptions(return_mode="ids")).candidates
    assert "Join" not in index.hashed(wanted)._jdf.queryExecution().optimizedPlan().toString()
    test = all if logic == "and" else any
    assert sorted(r.doc_id for r in found.collect()) == [i for i, t in enumerate(MANY[:20]) if test(g in t for g in ("Lic", "MIT"))]


def piece_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "content"])


@pytest.mark.parametrize("folded", [False, True])
def test_postings_leave_in_bounded_batches(folded):
    """postings are rows when they leave Python, of a piece of the texts at a time; the unwanted stay there."""
    texts = [bytes((i * 31 + j * j) % 251 for j in range(20_000)) for i in range(800)]
    out = ix.postings_of(Frame(piece_of(texts)), folded)
    assert len(out) > 3 and max(b.nbytes for b in out) <= 16 * bt.BATCH_BYTES
    some = ix.postings_of(Frame(piece_of(texts)), folded, [0x010203, int(out[0].column(0)[0].as_py())])
    assert sum(map(len, some)) < sum(map(len, out)) // 10
