"""Queries over the driver's tables, one or more for each operator of the search engine, and the same in DuckDB SQL.

Corpora: `documents` with the path source/lang/doc_id, `conversations` with conv_id/turn, `pages` with the url,
`benchmark` with the item id. A text that is null is no document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.grams import Rarity, bigram_frequency, covering_ngrams, gram_hash, pack_trigrams
from .operators import index as ix
from .operators.engine import Engine
from .operators.overlay import Overlay, classified, outcome_counts
from .operators.search import HashSearchOptions, SearchOptions, Sources, hash_search, hot_search, literal_search, match_counts, matching_docs, regex_search
from .operators.synthetic import PATTERNS, synthetic
from .plans import candidates as cand
from .plans.planner import plan_literal, plan_pattern
from .sources.corpus import MAX_FILE_BYTES, Corpus, from_table
from .sources.paths import PathFilter, glob_predicate, not_guarded, not_skipped, relative_path
from .sources.store import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str, max_file_bytes: int = MAX_FILE_BYTES) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return from_table(df, F.col("doc_id"), path, F.col("text"), "documents", max_file_bytes=max_file_bytes)


def conversations(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return from_table(df, F.col("conv_id") * 1000 + F.col("turn"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("text"), "conversations")


def pages(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return from_table(df, F.col("page_id"), F.col("url"), F.col("html"), "pages")


def benchmark(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return from_table(df, F.col("item_id"), F.col("item_id").cast("string"), F.col("text"), "benchmark")


DOCS = "SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id::VARCHAR AS path, text FROM documents WHERE text IS NOT NULL"
CONVERSATIONS = "SELECT conv_id * 1000 + turn AS doc_id, conv_id::VARCHAR || '/' || turn::VARCHAR AS path, text FROM conversations WHERE text IS NOT NULL"
PAGES = "SELECT page_id AS doc_id, url AS path, html AS text FROM pages WHERE html IS NOT NULL"
BENCHMARK = "SELECT item_id AS doc_id, item_id::VARCHAR AS path, text FROM benchmark WHERE text IS NOT NULL"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches_sql(docs: str, pattern: str, flags: str = "", where: str = "TRUE", snippet: bool = True, tail: str = "") -> str:
    """Matches from the pieces between them: a match's offset is the bytes of all that stands before it."""
    p = sql_text(f"(?{flags}){pattern}" if flags else pattern)
    text = "CASE WHEN nl = 0 THEN last_piece || rest WHEN nl = length(rest) THEN last_piece || rest ELSE last_piece || left(rest, nl - 1) END" if snippet else "''"
    return f"""WITH d AS (SELECT * FROM ({docs}) WHERE regexp_matches(text, {p}) AND ({where})),
h AS (SELECT doc_id, path, text, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps FROM d),
e AS (SELECT doc_id, path, text, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM h),
b AS (SELECT doc_id, path, text, hits[k] AS hit, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS chars FROM e),
c AS (SELECT doc_id, path, hit, left(text, chars::BIGINT) AS pre, substr(text, chars::BIGINT + 1) AS rest FROM b),
f AS (SELECT doc_id, path, hit, pre, rest, list_last(string_split(pre, chr(10))) AS last_piece, instr(rest, chr(10)) AS nl FROM c)
SELECT path, strlen(pre)::BIGINT AS byte_offset, (strlen(pre) + strlen(hit))::BIGINT AS end_offset,
  (1 + strlen(pre) - strlen(replace(pre, chr(10), '')))::BIGINT AS "line", (strlen(last_piece) + 1)::BIGINT AS "column", {text} AS snippet
FROM f {tail}"""


def regex_query(name: str, corpus: Callable[[SparkSession, str], Corpus], docs: str, pattern: str, options: SearchOptions, sql_pattern: str | None = None, flags: str = "", where: str = "TRUE", tail: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return regex_search(Sources(corpus(spark, sf_dir)), pattern, options).matches

    query(name, matches_sql(docs, sql_pattern or pattern, flags, where, not options.no_snippet, tail))(run)


ALL = {"max_results": None}
_LICENSE = [gram_hash(int(g).to_bytes(3, "big")) for g in pack_trigrams(b"License")]
HEX = "[a-f0-9]{40}"

# Sources.


@query("corpus_docs", f"SELECT doc_id, path, strlen(text)::BIGINT AS size, strlen(text) <= 4096 AS indexed FROM ({DOCS})")
def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, 4096).docs.select("doc_id", "path", "size", "indexed")


@query("dense_doc_ids", f"SELECT path, (row_number() OVER (ORDER BY encode(path)) - 1)::BIGINT AS doc_id FROM ({DOCS})")
def dense_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.corpus import numbered

    return numbered(documents(spark, sf_dir).meta).select("path", "doc_id")


@query("skip_dirs_filter", """SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(^|/)(\\.git|\\.lodestone|target|node_modules)(/|$)') AND NOT starts_with(url, '.git/') AND NOT starts_with(url, '.lodestone/')""")
def skip_dirs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where(not_skipped(F.col("url")) & not_guarded(F.col("url"))).select("page_id", "url")


@query("path_normalise", "SELECT page_id, CASE WHEN starts_with(replace(url, '\\', '/'), 'http:/') THEN substr(replace(url, '\\', '/'), 7) ELSE replace(url, '\\', '/') END AS path FROM pages")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", relative_path(F.col("url"), "http:/").alias("path"))


# Path filters.


def _filtered(paths: PathFilter) -> Query:
    return lambda spark, sf_dir: documents(spark, sf_dir).meta.where(paths.predicate(F.col("path"))).select("doc_id", "path")


query("path_include", f"SELECT doc_id, path FROM ({DOCS}) WHERE starts_with(path, 'src1/')")(_filtered(PathFilter(include=("src1/*",))))
query("path_exclude", f"SELECT doc_id, path FROM ({DOCS}) WHERE regexp_matches(path, '^src[0-4]/') AND NOT regexp_matches(path, '/(de|fr)/')")(_filtered(PathFilter(include=("src[0-4]/**",), exclude=("*/{de,fr}/*",))))
query("path_globs_union", f"SELECT doc_id, path FROM ({DOCS}) WHERE starts_with(path, 'src2/') OR suffix(path, '7') OR regexp_full_match(path, 'src.5/e[^n]/.*')")(_filtered(PathFilter(include=("src2/**",), globs=("*7", "src?5/e[!n]/*"))))
query("path_suffix", "SELECT page_id, url FROM pages WHERE suffix(url, '.html')")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").where(glob_predicate(F.col("url"), "*.html")).select("page_id", "url"))

# Regular expressions.

query("regex_doc_filter", f"SELECT doc_id, path FROM ({DOCS}) WHERE regexp_matches(text, 'License|Copyright')")(lambda spark, sf_dir: matching_docs(Sources(documents(spark, sf_dir)), "License|Copyright"))
regex_query("regex_matches_offsets", documents, DOCS, "the ", SearchOptions(**ALL))
regex_query("regex_alternation", documents, DOCS, "Apache License|MIT License|Released under", SearchOptions(**ALL))
regex_query("regex_class_heavy", documents, DOCS, "[0-9]{3}-[0-9]{4}", SearchOptions(**ALL))
regex_query("regex_hex_fallback", documents, DOCS, HEX, SearchOptions(**ALL))
regex_query("regex_caseless", documents, DOCS, "license[a-z ]*", SearchOptions(case_sensitive=False, **ALL), flags="i")
regex_query("regex_dotall", conversations, CONVERSATIONS, "[.].[A-Z]", SearchOptions(dotall=True, **ALL), flags="s")
regex_query("regex_multiline", documents, DOCS, "^The [a-z]+", SearchOptions(multiline=True, **ALL), flags="m")
regex_query("regex_no_snippet", documents, DOCS, "token = ", SearchOptions(no_snippet=True, **ALL))
regex_query("regex_path_filtered", documents, DOCS, "example[.]com", SearchOptions(include=("src1/*", "src3/*"), exclude=("*/de/*",), **ALL), where="(starts_with(path, 'src1/') OR starts_with(path, 'src3/')) AND NOT regexp_matches(path, '/de/')")
regex_query("regex_posix_class", documents, DOCS, "[[:upper:]][[:lower:]]+ License", SearchOptions(**ALL), sql_pattern="[A-Z][a-z]+ License")
regex_query("regex_quoted", documents, DOCS, r"\Q+1 (\E[0-9]+", SearchOptions(**ALL), sql_pattern="[+]1 [(][0-9]+")
regex_query("regex_repeat", documents, DOCS, "tion+s{0,2} of", SearchOptions(**ALL))
regex_query("limit_max_results", documents, DOCS, "and ", SearchOptions(max_results=50), tail="ORDER BY doc_id, byte_offset LIMIT 50")
regex_query("limit_zero_is_default", documents, DOCS, "ing", SearchOptions(max_results=0), tail="ORDER BY doc_id, byte_offset LIMIT 200")
regex_query("html_search", pages, PAGES, "<h1>[A-Z][a-z]+", SearchOptions(no_snippet=True, **ALL))
regex_query("conversation_search", conversations, CONVERSATIONS, "[Tt]he [a-z]+ing", SearchOptions(**ALL))


@query("match_count_per_doc", f"SELECT doc_id, path, len(regexp_extract_all(text, 'tion[a-z]'))::BIGINT AS n FROM ({DOCS}) WHERE regexp_matches(text, 'tion[a-z]')")
def match_count_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(Sources(documents(spark, sf_dir)), "tion[a-z]")


@query("match_count_total", f"SELECT sum(len(regexp_extract_all(text, '{HEX}')))::BIGINT AS n_matches, count(*)::BIGINT AS n_docs FROM ({DOCS}) WHERE regexp_matches(text, '{HEX}')")
def match_count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(Sources(documents(spark, sf_dir)), HEX).agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_docs"))


#: Every byte starts an empty match, but for those within a run of `the` and the one that a run ends at.
EMPTY = f"""WITH t AS (SELECT path, hex(encode(text)) AS h FROM ({BENCHMARK})),
b AS (SELECT path, h, length(h) // 2 AS n, p, substr(h, 2 * p + 1, 6) = '746865' AS here, p >= 3 AND substr(h, 2 * p - 5, 6) = '746865' AS gone FROM (SELECT path, h, unnest(range(0, length(h) // 2 + 1)) AS p FROM t)),
s AS (SELECT *, coalesce(max(CASE WHEN substr(h, 2 * p + 1, 2) = '0A' THEN p + 1 END) OVER w, 0) AS first, count(CASE WHEN substr(h, 2 * p + 1, 2) = '0A' THEN 1 END) OVER w AS above FROM b WINDOW w AS (PARTITION BY path ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT path, p, first, above, min(CASE WHEN gone AND NOT here THEN p END) OVER (PARTITION BY path ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, here, gone,
  coalesce(max(CASE WHEN here THEN p + 3 END) OVER (PARTITION BY path ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS until FROM s)
SELECT path, p AS byte_offset, CASE WHEN here THEN stop ELSE p END AS end_offset, (above + 1)::BIGINT AS "line", (p - first + 1)::BIGINT AS "column", '' AS snippet FROM o WHERE p > until OR (here AND NOT gone AND p >= until)"""


@query("regex_empty_matches", EMPTY)
def regex_empty_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_search(Sources(benchmark(spark, sf_dir)), "(?:the)*", SearchOptions(no_snippet=True, **ALL)).matches


# Literals.


def literal_query(name: str, corpus: Callable, docs: str, literal: str, options: SearchOptions, pattern: str, flags: str = "") -> None:
    query(name, matches_sql(docs, pattern, flags))(lambda spark, sf_dir: literal_search(Sources(corpus(spark, sf_dir)), literal, options).matches)


literal_query("literal_matches", documents, DOCS, "MIT License", SearchOptions(**ALL), "MIT License")
literal_query("literal_short", benchmark, BENCHMARK, "th", SearchOptions(**ALL), "th")
literal_query("literal_caseless", conversations, CONVERSATIONS, "THE OF", SearchOptions(case_sensitive=False, **ALL), "the of", "i")
literal_query("literal_metachar", documents, DOCS, "+1 (", SearchOptions(**ALL), "[+]1 [(]")
literal_query("literal_non_ascii", documents, DOCS, "für ", SearchOptions(**ALL), "für ")

# Grams and the index.

GRAMS = "SELECT DISTINCT doc_id, ('0x' || substr(h, 2 * i + 1, 6))::BIGINT AS gram FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 2)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM ({docs})))"
PAIRS = "SELECT ('0x' || substr(h, 2 * i + 1, 4))::BIGINT AS key, count(*)::BIGINT AS freq FROM (SELECT h, unnest(range(0, length(h) // 2 - 1)) AS i FROM (SELECT hex(encode(text)) AS h FROM ({docs}))) GROUP BY 1"


@query("trigram_postings", f"SELECT gram, doc_id FROM ({GRAMS.format(docs=DOCS)})")
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings_of(documents(spark, sf_dir).docs)


@query("folded_postings", f"SELECT gram, doc_id FROM ({GRAMS.format(docs=DOCS.replace(', text FROM', ', translate(text, $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$) AS text FROM'))})")
def folded_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings_of(documents(spark, sf_dir).docs, True)


@query("posting_lists", f"SELECT gram, count(*)::BIGINT AS n_docs, array_to_string(list_sort(list(doc_id)), ',') AS doc_ids FROM ({GRAMS.format(docs=DOCS)}) GROUP BY gram")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ix.posting_lists(ix.postings_of(documents(spark, sf_dir).docs))
    return found.select("gram", F.size("doc_ids").cast("long").alias("n_docs"), F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


@query("gram_document_frequency", f"SELECT gram, count(*)::BIGINT AS n_docs FROM ({GRAMS.format(docs=CONVERSATIONS)}) GROUP BY gram")
def gram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings_of(conversations(spark, sf_dir).docs).groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))


@query("bigram_frequency", PAIRS.format(docs=BENCHMARK))
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigram_frequency(benchmark(spark, sf_dir).docs)


@query("bigram_weights", f"WITH p AS ({PAIRS.format(docs=BENCHMARK)}) SELECT key, ((SELECT max(freq) FROM p) - freq + 1)::BIGINT AS weight FROM p")
def bigram_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bigram_frequency(benchmark(spark, sf_dir).docs)
    return found.crossJoin(F.broadcast(found.agg(F.max("freq").alias("_max")))).select("key", (F.col("_max") - F.col("freq") + 1).alias("weight"))


SPARSE = f"""WITH f AS ({PAIRS.format(docs=BENCHMARK)}), t AS (SELECT doc_id, hex(encode(text)) AS h FROM ({BENCHMARK})),
p AS (SELECT doc_id, h, i, (SELECT max(freq) FROM f) - freq + 1 AS w FROM (SELECT doc_id, h, i, ('0x' || substr(h, 2 * i + 1, 4))::BIGINT AS key FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 1)) AS i FROM t)) JOIN f USING (key)),
g AS (SELECT a.doc_id, a.h, a.i AS l, b.i AS r, least(a.w, b.w) AS w FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i < a.i + 24)
SELECT DISTINCT doc_id, substr(h, 2 * l + 1, 2 * (r - l + 2)) AS ngram FROM g WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.doc_id = g.doc_id AND c.i > g.l AND c.i < g.r AND c.w >= g.w)"""


@query("sparse_ngrams", SPARSE)
def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.sparse_table(benchmark(spark, sf_dir)).select("doc_id", F.hex("ngram").alias("ngram"))


@query("covering_grams")
def covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rarity = Rarity.of(bigram_frequency(benchmark(spark, sf_dir).docs))
    rows = [(text, i, g.decode()) for text in ("License", "theating", "onerbleretion") for i, g in enumerate(covering_ngrams(text.encode(), rarity))]
    return spark.createDataFrame(rows, "literal string, position long, ngram string")


@query("gram_hashes")
def gram_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.gram_dictionary(ix.postings_of(benchmark(spark, sf_dir).docs))


# Candidates.


def _held(pattern_sql: str) -> str:
    return f"SELECT doc_id, path FROM ({DOCS}) WHERE {pattern_sql}"


def _all_grams(*strings: str) -> str:
    return " AND ".join(f"contains(text, {sql_text(s[i : i + 3])})" for s in strings for i in range(len(s) - 2))


def _indexed(spark: SparkSession, sf_dir: str) -> Sources:
    corpus = documents(spark, sf_dir)
    return Sources(corpus, ix.build(corpus, long_grams=False))


def _listed(spark: SparkSession, sf_dir: str, pattern: str, **options) -> DataFrame:
    found = regex_search(_indexed(spark, sf_dir), pattern, SearchOptions(return_mode="paths", use_index="always", **options))
    return found.candidates.select("doc_id", "path")


query("candidates_and", _held(_all_grams("token = ")))(lambda spark, sf_dir: _listed(spark, sf_dir, "token = .[0-9a-f]+"))
query("candidates_or", _held(f"({_all_grams('MIT License')}) OR ({_all_grams('Apache')})"))(lambda spark, sf_dir: _listed(spark, sf_dir, "MIT License|Apache [A-Z]"))
query("candidates_fallback", f"SELECT doc_id, path FROM ({DOCS})")(lambda spark, sf_dir: _listed(spark, sf_dir, HEX))
query("candidates_repeat", _held(f"({_all_grams('thou')}) AND ({_all_grams('unter')})"))(lambda spark, sf_dir: _listed(spark, sf_dir, "thou+nter"))
query("candidates_caseless", f"SELECT doc_id, path FROM ({DOCS}) WHERE " + " AND ".join(f"contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{'license'[i : i + 3]}')" for i in range(5)))(lambda spark, sf_dir: _listed(spark, sf_dir, "LICENSE", case_sensitive=False))


@query("candidate_ids", f"SELECT doc_id FROM ({DOCS}) WHERE {_all_grams('License')}")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_search(_indexed(spark, sf_dir), "License", SearchOptions(return_mode="ids", use_index="always")).candidate_ids()


@query("candidate_paths", f"SELECT path FROM ({DOCS}) WHERE {_all_grams('License')}")
def candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_search(_indexed(spark, sf_dir), "License", SearchOptions(return_mode="paths")).candidate_paths()


@query("candidate_count", f"SELECT count(*)::BIGINT AS candidate_count FROM ({DOCS}) WHERE {_all_grams('License')}")
def candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regex_search(_indexed(spark, sf_dir), "License", SearchOptions(return_mode="count"))
    return found.candidates.agg(F.count(F.lit(1)).alias("candidate_count"))


@query("candidate_reduction", f"SELECT round(100.0 * (1 - (count(*) FILTER (WHERE {_all_grams('License')}))::DOUBLE / count(*)), 6) AS reduction FROM ({DOCS})")
def candidate_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _indexed(spark, sf_dir)
    n = sources.corpus.meta.agg(F.count(F.lit(1)).alias("docs"))
    found = regex_search(sources, "License", SearchOptions(return_mode="count")).candidates.agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(n).select(F.round(100.0 * (1 - F.col("n") / F.col("docs")), 6).alias("reduction"))


@query("candidates_unindexed", f"SELECT doc_id, path FROM ({DOCS}) WHERE strlen(text) > 4096 OR ({_all_grams('License')})")
def candidates_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir, 4096)
    return regex_search(Sources(corpus, ix.build(corpus, False)), "License", SearchOptions(return_mode="ids", use_index="always")).candidates.select("doc_id", "path")


@query("indexed_equals_scan", matches_sql(DOCS, "Apache License, Version [0-9]"))
def indexed_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_search(_indexed(spark, sf_dir), "Apache License, Version [0-9]", SearchOptions(use_index="always", **ALL)).matches


@query("indexed_with_budget", matches_sql(DOCS, "Apache License, Version [0-9]|MIT License"))
def indexed_with_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_search(_indexed(spark, sf_dir), "Apache License, Version [0-9]|MIT License", SearchOptions(use_index="always", budget=True, **ALL)).matches


# The stored index: written, loaded and looked up.

_stored_at: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> Sources:
    corpus, key = documents(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored_at:
        root = scratch(spark)
        ix.write(ix.build(corpus, long_grams=False), root, corpus)
        _stored_at[key] = root
    return Sources(corpus, ix.load(spark, _stored_at[key], corpus))


query("stored_index_matches", matches_sql(DOCS, "Apache License, Version [0-9]"))(lambda spark, sf_dir: regex_search(_stored(spark, sf_dir), "Apache License, Version [0-9]", SearchOptions(use_index="always", **ALL)).matches)
query("stored_index_candidates", _held(f"({_all_grams('MIT License')}) OR ({_all_grams('Apache')})"))(lambda spark, sf_dir: regex_search(_stored(spark, sf_dir), "MIT License|Apache [A-Z]", SearchOptions(return_mode="paths", use_index="always")).candidates.select("doc_id", "path"))
query("stored_index_caseless", matches_sql(DOCS, "license", "i"))(lambda spark, sf_dir: regex_search(_stored(spark, sf_dir), "license", SearchOptions(case_sensitive=False, use_index="always", **ALL)).matches)
query("stored_index_hashes", _held(_all_grams("License")))(lambda spark, sf_dir: hash_search(_stored(spark, sf_dir), _LICENSE, "and", HashSearchOptions(return_mode="ids")).candidates.select("doc_id", "path"))


@query("stored_index_postings", f"SELECT ('0x' || hex(g))::BIGINT AS gram, doc_id FROM ({DOCS}), (VALUES ('Lic'), ('the'), ('zq~')) t(g) WHERE contains(text, g)")
def stored_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).index.postings.where(F.col("gram").isin([int.from_bytes(g, "big") for g in (b"Lic", b"the", b"zq~")]))


@query("stored_index_statistics", f"SELECT gram, folded, count(*)::BIGINT AS n FROM (SELECT gram, doc_id, FALSE AS folded FROM ({GRAMS.format(docs=DOCS)}) UNION ALL SELECT gram, doc_id, TRUE FROM ({GRAMS.format(docs=DOCS.replace(', text FROM', ', translate(text, $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$) AS text FROM'))})) GROUP BY ALL")
def stored_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).index.counts


@query("posting_any", f"SELECT doc_id FROM ({DOCS}) WHERE contains(text, 'Lic') OR contains(text, 'Apa')")
def posting_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand.any_of(ix.postings_of(documents(spark, sf_dir).docs), [int.from_bytes(b"Lic", "big"), int.from_bytes(b"Apa", "big")])


@query("plan_admits_column", f"SELECT doc_id FROM ({DOCS}) WHERE {_all_grams('License')}")
def plan_admits_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.grams import trigrams

    plan = plan_literal(b"License")
    return documents(spark, sf_dir).docs.where(cand.admitted(trigrams(F.col("content")), plan)).select("doc_id")


#: What the patterns require, worked out by hand: trigrams of License 5; of MIT License 9 and Apache 4; of user_ 3 and _event_ 5, and so on.
REPORT = """SELECT * FROM (VALUES ('License', 'and', 1::BIGINT, 5::BIGINT, 'License', FALSE), ('MIT License|Apache', 'or', 2, 13, 'MIT License,Apache', FALSE), ('user_[0-9]{4}_event_[A-Z]{3}', 'and', 1, 8, 'user_,_event_', FALSE),
  ('[a-f0-9]{40}', 'all', 0, 0, '', TRUE), ('abc+def', 'and', 1, 3, 'abc,cdef', FALSE), ('xa{1,3}yz', 'and', 1, 1, 'ayz', FALSE), ('(?i)foobar', 'and', 1, 4, 'foobar', FALSE), ('\\x41bcd', 'and', 1, 2, 'Abcd', FALSE), ('a|bcd', 'all', 0, 0, '', TRUE)) t(pattern, kind, branches, grams, literals, used_fallback)"""


@query("plan_report", REPORT)
def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for p in ("License", "MIT License|Apache", "user_[0-9]{4}_event_[A-Z]{3}", HEX, "abc+def", "xa{1,3}yz", "(?i)foobar", r"\x41bcd", "a|bcd"):
        plan = plan_pattern(p)
        rows.append((p, plan.kind, len(plan.grams), sum(map(len, plan.grams)), ",".join(plan.literals), plan.used_fallback))
    return spark.createDataFrame(rows, "pattern string, kind string, branches long, grams long, literals string, used_fallback boolean")


# Hash search.

def _hashed(spark: SparkSession, sf_dir: str, hashes: list[int], logic: str, **options) -> DataFrame:
    found = hash_search(_indexed(spark, sf_dir), hashes, logic, HashSearchOptions(**options))
    return found.matches if options.get("verify_literal") else found.candidates.select("doc_id", "path")


query("hash_and", _held(_all_grams("License")))(lambda spark, sf_dir: _hashed(spark, sf_dir, _LICENSE, "and", return_mode="ids"))
query("hash_or", _held("contains(text, 'Lic') OR contains(text, 'Apa')"))(lambda spark, sf_dir: _hashed(spark, sf_dir, [gram_hash(b"Lic"), gram_hash(b"Apa")], "or", return_mode="paths"))
query("hash_and_empty", f"SELECT doc_id, path FROM ({DOCS})")(lambda spark, sf_dir: _hashed(spark, sf_dir, [], "and", return_mode="ids"))
query("hash_or_empty", f"SELECT doc_id, path FROM ({DOCS}) WHERE FALSE")(lambda spark, sf_dir: _hashed(spark, sf_dir, [], "or", return_mode="ids"))
query("hash_verify_literal", matches_sql(DOCS, "MIT License"))(lambda spark, sf_dir: _hashed(spark, sf_dir, _LICENSE, "and", verify_literal="MIT License", max_results=None))


@query("hash_long_gram")
def hash_long_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the hash of a sparse gram longer than three bytes, taken from the corpus itself."""
    corpus = benchmark(spark, sf_dir)
    index = ix.build(corpus)
    rarity = Rarity.of(index.bigrams)
    first = bytes(corpus.docs.orderBy("doc_id").first()["content"])
    long = max(covering_ngrams(first, rarity), key=len)
    return hash_search(Sources(corpus, index), [gram_hash(long)], "and", HashSearchOptions(return_mode="ids")).candidates.select("doc_id", "path")


# Overlay: every 97th document changes, every 89th goes.

CHANGED = f"""SELECT doc_id, path, CASE WHEN doc_id % 97 = 0 THEN 'overlay License text' || chr(10) || doc_id::VARCHAR ELSE text END AS text, doc_id % 97 = 0 AS is_overlay FROM ({DOCS}) WHERE doc_id % 89 <> 0 OR doc_id % 97 = 0"""


def _changes(corpus: Corpus) -> DataFrame:
    """Deletions first; a path that is both comes back with the changes of the next generation."""
    new = F.concat(F.lit("overlay License text\n"), F.col("doc_id").cast("string"))
    return corpus.docs.where("doc_id % 97 = 0").select("path", F.lit("modified").alias("op"), F.encode(new, "UTF-8").alias("content"))


def _overlaid(spark: SparkSession, sf_dir: str) -> Sources:
    corpus, overlay = documents(spark, sf_dir), Overlay(spark)
    overlay.append(corpus.docs.where("doc_id % 89 = 0").select("path", F.lit("deleted").alias("op"), F.lit(None).cast("binary").alias("content")))
    overlay.append(_changes(corpus))
    return Sources(corpus, None, overlay.snapshot())


query("overlay_search", matches_sql(f"SELECT doc_id, path, text FROM ({CHANGED})", "License"))(lambda spark, sf_dir: regex_search(_overlaid(spark, sf_dir), "License", SearchOptions(**ALL)).matches)
query("overlay_modified", matches_sql(f"SELECT doc_id, path, text FROM ({CHANGED})", "overlay License text"))(lambda spark, sf_dir: literal_search(_overlaid(spark, sf_dir), "overlay License text", SearchOptions(**ALL)).matches)
query("overlay_shadow", f"SELECT path, is_overlay FROM ({CHANGED}) WHERE {_all_grams('License')}")(lambda spark, sf_dir: regex_search(_overlaid(spark, sf_dir), "License", SearchOptions(return_mode="paths")).candidates.select("path", "is_overlay"))
query("overlay_order", matches_sql(f"SELECT doc_id, path, text, is_overlay FROM ({CHANGED})", "License", tail="").replace("FROM f ", "FROM f JOIN (SELECT path AS p2, is_overlay FROM (" + CHANGED + ")) o ON o.p2 = f.path ORDER BY is_overlay, CASE WHEN is_overlay THEN NULL ELSE doc_id END, path, byte_offset LIMIT 40"))(lambda spark, sf_dir: regex_search(_overlaid(spark, sf_dir), "License", SearchOptions(max_results=40)).matches)


@query("overlay_deleted", f"SELECT doc_id, path FROM ({DOCS}) WHERE doc_id % 89 <> 0 AND doc_id % 97 <> 0")
def overlay_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaid(spark, sf_dir).base(PathFilter()).select("doc_id", "path")


@query("overlay_generation", f"SELECT path, 'deleted' AS op FROM ({DOCS}) WHERE doc_id % 89 = 0")
def overlay_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, overlay = documents(spark, sf_dir), Overlay(spark)
    overlay.append(corpus.docs.where("doc_id % 89 = 0").select("path", F.lit("deleted").alias("op"), F.lit(None).cast("binary").alias("content")))
    overlay.append(_changes(corpus))
    return overlay.snapshot(1).select("path", "op")


@query("update_outcomes", "SELECT count(*) FILTER (WHERE doc_id % 7 <> 0)::BIGINT AS updated, count(*) FILTER (WHERE doc_id % 7 = 0)::BIGINT AS deleted, 0::BIGINT AS skipped FROM documents WHERE text IS NOT NULL")
def update_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).docs
    return outcome_counts(classified(docs.select("path", F.when(F.col("doc_id") % 7 != 0, F.col("content")).alias("content"), F.lit(True).alias("is_file"))))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over documents with the same changes, taken in by two calls."""
    corpus = documents(spark, sf_dir)
    engine = Engine(spark, lambda: corpus, auto_index=False)
    engine.index_update_files(corpus.docs.where("doc_id % 89 = 0").select("path", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("is_file")))
    engine.index_update_files(_changes(corpus).select("path", "content", F.lit(True).alias("is_file")))
    return engine


@query("overlay_status", f"SELECT 'NO_VERSION' AS base_commit, count(*) FILTER (WHERE doc_id % 89 = 0 OR doc_id % 97 = 0)::BIGINT AS overlay_dirty_files, count(*)::BIGINT AS indexed_docs, 1::BIGINT AS base_generation, 'idle' AS state, CASE WHEN count(*) FILTER (WHERE doc_id % 89 = 0 OR doc_id % 97 = 0) > 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM ({DOCS})")
def overlay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _engine(spark, sf_dir).index_status()
    return spark.createDataFrame([(s["base_commit"], s["overlay_dirty_files"], s["indexed_docs"], s["base_generation"], s["rebuild_state"]["state"], s["freshness"])], "base_commit string, overlay_dirty_files long, indexed_docs long, base_generation long, state string, freshness string")


@query("overlay_rebuild", matches_sql(f"SELECT doc_id, path, text FROM ({CHANGED})", "License"))
def overlay_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild over a table that has none of the changes: all of them stay."""
    engine = _engine(spark, sf_dir)
    engine.index_rebuild("foreground")
    return regex_search(engine._sources()[0], "License", SearchOptions(**ALL)).matches


@query("overlay_rebuilt_in", matches_sql(f"SELECT doc_id, path, text FROM ({CHANGED})", "License"))
def overlay_rebuilt_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild over a table that has every second changed text and no deleted row: the overlay keeps the rest."""
    engine = _engine(spark, sf_dir)
    corpus = engine._base.corpus
    new = F.when(F.col("doc_id") % 194 == 0, F.encode(F.concat(F.lit("overlay License text\n"), F.col("doc_id").cast("string")), "UTF-8")).otherwise(F.col("content"))
    engine._open = lambda: Corpus(corpus.docs.withColumn("content", new).where("doc_id % 89 <> 0 OR doc_id % 97 = 0"), corpus.name)
    engine.index_rebuild("foreground")
    return regex_search(engine._sources()[0], "License", SearchOptions(**ALL)).matches


@query("overlay_same_path", f"SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'modified' ELSE 'deleted' END AS op, CASE WHEN doc_id % 2 = 0 THEN 'last ' || doc_id::VARCHAR END AS text FROM ({DOCS}) WHERE doc_id % 7 = 0")
def overlay_same_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several changes of a path in one batch: the one with the largest sequence counts."""
    docs, overlay = documents(spark, sf_dir).docs.where("doc_id % 7 = 0"), Overlay(spark)
    last = docs.select("path", F.when(F.col("doc_id") % 2 == 0, "modified").otherwise("deleted").alias("op"), F.when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.lit("last "), F.col("doc_id").cast("string")), "UTF-8")).alias("content"), F.lit(2).alias("sequence"))
    first = docs.select("path", F.when(F.col("doc_id") % 2 == 0, "deleted").otherwise("modified").alias("op"), F.when(F.col("doc_id") % 2 == 1, F.col("content")).alias("content"), F.lit(1).alias("sequence"))
    overlay.append(last.unionByName(first))
    return overlay.snapshot().select("path", "op", F.col("content").cast("string").alias("text"))


# Hot documents and the synthetic corpus.


@query("hot_recent_docs", matches_sql(f"SELECT * FROM ({DOCS}) ORDER BY doc_id DESC LIMIT 128", "the "))
def hot_recent_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = documents(spark, sf_dir).docs.orderBy(F.desc("doc_id")).limit(128)
    return hot_search(last.select(F.col("doc_id").alias("position"), "path", "content"), "the ", SearchOptions(**ALL)).matches


@query("synthetic_headline", "SELECT * FROM (VALUES ('literal', 43::BIGINT, 43::BIGINT), ('alternation', 52, 49), ('class_heavy', 14, 14), ('hex_fallback', 18, 301)) t(name, matches, candidates)")
def synthetic_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = synthetic(spark, 300)
    sources = Sources(corpus, ix.build(corpus, False))
    out = None
    for name, pattern in PATTERNS.items():
        found = regex_search(sources, pattern, SearchOptions(use_index="always", no_snippet=True, **ALL))
        counted = found.matches.agg(F.count(F.lit(1)).alias("matches")).crossJoin(found.candidates.agg(F.count(F.lit(1)).alias("candidates"))).select(F.lit(name).alias("name"), "matches", "candidates")
        out = counted if out is None else out.unionByName(counted)
    return out
