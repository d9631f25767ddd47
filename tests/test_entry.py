import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "byte_offset", "end_offset", "line", "column", "snippet"] and df.count() > 0


CHEAP = ["corpus_docs", "path_globs_union", "regex_matches_offsets", "regex_caseless", "regex_multiline", "literal_metachar", "trigram_postings", "candidates_or", "hash_verify_literal", "overlay_search", "limit_max_results"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, tables, name):
    assert rows_of(entry.queries()[name](spark, SF).toPandas()) == rows_of(tables.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
