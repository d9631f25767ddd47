import io
import json
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.errors import CorruptIndex, InvalidRequest, SearchTimeout
from lodestone.functions.dialect import compile_pattern
from lodestone.functions.grams import Rarity, gram_hash, pack_trigrams, sparse_ngrams, unpack_trigram
from lodestone.functions.positions import match_spans
from lodestone.operators import index as ix
from lodestone.operators import server
from lodestone.operators.engine import Engine, HotDocuments
from lodestone.operators.overlay import Overlay
from lodestone.operators.search import HashSearchOptions, SearchOptions, Sources, hash_search, literal_search, regex_search
from lodestone.operators.synthetic import PATTERNS, candidate_reduction, expected, percentile, report, synthetic
from lodestone.sources.corpus import from_files, from_table

TEXTS = {
    "src/a.txt": "hello world\nhello rust\n", "src/b.txt": "another line\n", "c.txt": "abc+def abcdef abccdef", "d.md": "é hello HELLO", "e.md": "xayz xaayz", "f.txt": "", "g.txt": "ab", "h.txt": "afoo ]foo", "i.txt": "License\n" * 5,
    "j.txt": "cursor search engine\nfast engine\n",
}


def corpus_of(spark, texts, **options):
    rows = [(i, p, t) for i, (p, t) in enumerate(sorted(texts.items(), key=lambda x: x[0].encode()))]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return from_table(df, F.col("doc_id"), F.col("path"), F.col("text"), "test", **options)


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_of(spark, TEXTS)


@pytest.fixture(scope="module")
def sources(corpus):
    index = ix.build(corpus)
    return Sources(corpus, ix.Index(*(getattr(index, t).persist() for t in ix.TABLES)))


def scan(texts, pattern, **options):
    engine = compile_pattern(pattern, **options).build()
    return sorted((p, a, b) for p, t in texts.items() for a, b in match_spans(engine, t.encode()))


def found(result):
    return sorted((r.path, r.byte_offset, r.end_offset) for r in result.rows)


PATTERNS_TRIED = ["hello", "abc+def", "xa{1,3}yz", "[[:alpha:]]foo", "(?i)hello", "engine|hello", "l+o?", "^h", "a*", "zzz", r"\bfast\b", "abc[+]def", "hello.*HELLO"]


@pytest.mark.parametrize("pattern", PATTERNS_TRIED)
def test_indexed_equals_scan(sources, pattern):
    for case in (True, False):
        expected_ = scan(TEXTS, pattern, case_sensitive=case)
        for use in ("always", "never", "auto"):
            assert found(regex_search(sources, pattern, SearchOptions(use_index=use, case_sensitive=case, max_results=None))) == expected_


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text("abcdefghilnorstu ", min_size=3, max_size=6))
def test_literals_equal_scan(sources, literal):
    expected_ = scan(TEXTS, literal, literal=True)
    assert found(literal_search(sources, literal, SearchOptions(use_index="always", max_results=None))) == expected_
    assert found(regex_search(sources, literal, SearchOptions(use_index="always", literal=True, max_results=None))) == expected_


def test_metacharacters_are_literal(sources):
    assert [r.byte_offset for r in literal_search(sources, "abc+def").rows] == [0]
    assert found(literal_search(sources, "HELLO", SearchOptions(case_sensitive=False))) == scan(TEXTS, "hello", case_sensitive=False)


def test_order_and_limits(sources):
    every = regex_search(sources, "l", SearchOptions(max_results=None)).rows
    assert [(r.path, r.byte_offset) for r in every] == sorted(((r.path, r.byte_offset) for r in every), key=lambda x: (x[0].encode(), x[1]))
    assert regex_search(sources, "l", SearchOptions(max_results=3)).rows == every[:3]
    assert SearchOptions(max_results=0).limit == 200


def test_paths_and_flags(sources):
    assert {p for p, *_ in found(regex_search(sources, "hello", SearchOptions(include=("*.md",))))} == {"d.md"}
    assert {p for p, *_ in found(regex_search(sources, "hello", SearchOptions(include=("*.md",), globs=("src/**",), exclude=("*.md",))))} == {"src/a.txt"}
    assert all(r.snippet == "" for r in regex_search(sources, "hello", SearchOptions(no_snippet=True)).rows)
    assert len(regex_search(sources, "^hello", SearchOptions(multiline=True)).rows) == 2
    assert len(regex_search(sources, "world.hello", SearchOptions(dotall=True)).rows) == 1


def test_candidates(sources):
    result = regex_search(sources, "hello", SearchOptions(return_mode="ids", use_index="always"))
    assert result.candidate_count() == 2 and result.matches is None
    assert [r.path for r in result.candidate_paths().collect()] == ["d.md", "src/a.txt"]
    scanned = regex_search(sources, "hello", SearchOptions(return_mode="ids", use_index="never"))
    assert scanned.candidate_ids().collect() == result.candidate_ids().collect()
    assert regex_search(sources, "[a-z]+", SearchOptions(return_mode="count")).candidate_count() == len(TEXTS)
    budget = regex_search(sources, "another line", SearchOptions(return_mode="count", use_index="always", budget=True))
    assert budget.candidate_count() == 1


def test_unindexed_documents_stay_candidates(spark):
    corpus = corpus_of(spark, TEXTS, max_file_bytes=10)
    result = regex_search(Sources(corpus, ix.build(corpus)), "hello", SearchOptions(use_index="always", max_results=None))
    assert found(result) == scan(TEXTS, "hello") and result.candidate_count() > 2


def test_hash_search(sources):
    hashes = [gram_hash(unpack_trigram(g)) % (1 << 64) for g in pack_trigrams(b"hello")]
    ids = HashSearchOptions(return_mode="ids")
    assert hash_search(sources, hashes, "and", ids).candidate_count() == 2
    assert hash_search(sources, [gram_hash(b"fas"), gram_hash(b"xay")], "or", ids).candidate_count() == 2
    assert hash_search(sources, [], "and", ids).candidate_count() == len(TEXTS)
    assert hash_search(sources, [], "or", ids).candidate_count() == 0
    assert found(hash_search(sources, hashes, "and", HashSearchOptions(verify_literal="hello"))) == scan(TEXTS, "hello")
    with pytest.raises(InvalidRequest):
        hash_search(sources, hashes, "and", HashSearchOptions())
    with pytest.raises(InvalidRequest):
        hash_search(sources, hashes, "xor", ids)


def test_empty_pattern(sources):
    for search in (regex_search, literal_search):
        with pytest.raises(InvalidRequest):
            search(sources, "")


def test_files(spark, tmp_path):
    for path, data in {"src/x.txt": b"needle\n", "node_modules/y.txt": b"needle", "bad.bin": b"\xff\xfeneedle", "z.txt": b"a" * 50 + b"needle"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    corpus = from_files(spark, str(tmp_path), max_file_bytes=40)
    assert [(r.doc_id, r.path, r.indexed) for r in corpus.meta.orderBy("doc_id").collect()] == [(0, "src/x.txt", True), (1, "z.txt", False)]
    assert [r.path for r in regex_search(Sources(corpus), "needle").rows] == ["src/x.txt", "z.txt"]


def test_engine_over_files(spark, tmp_path):
    home = tmp_path / "ws"
    (home / "src").mkdir(parents=True)
    (home / "src/main.txt").write_text("before\n")
    (home / "src/y.txt").write_text("needle user_0420_event_ABC\n")
    engine = Engine.over_files(spark, str(home), str(tmp_path / "index"))
    assert engine.regex_search("after")["matches"] == []
    (home / "src/main.txt").write_text("after value\n")
    (home / "src/y.txt").unlink()
    assert {k: v for k, v in engine.index_update_files(["src/main.txt", "src/y.txt", "src"]).items() if k != "generation"} == {"updated": 1, "deleted": 1, "skipped": 1}
    answer = engine.regex_search("after")
    assert [(m["path"], m["byte_offset"]) for m in answer["matches"]] == [("src/main.txt", 0)] and answer["overlay_generation"] == 1
    assert engine.regex_search("needle")["matches"] == []
    status = engine.index_status()
    assert status["freshness"] == "stale" and status["overlay_dirty_files"] == 2
    done = engine.index_rebuild("foreground")
    assert done["doc_count"] == 1 and done["posting_count"] > 0
    assert engine.index_status()["freshness"] == "fresh"
    assert len(engine.literal_search("after")["matches"]) == 1
    assert [m["path"] for m in engine.hot_search("value")["matches"]] == ["src/main.txt"]
    assert engine.index_rebuild("background")["posting_count"] == 0
    engine._thread.join(120)
    assert engine.index_status()["rebuild_state"]["state"] == "idle"


def test_searches_and_updates_at_once(spark):
    corpus = corpus_of(spark, {"src/live.txt": "alpha\nalpha\nalpha\n"})
    engine = Engine(spark, lambda: corpus)
    empty = []

    def search():
        for _ in range(4):
            if not engine.regex_search("alpha")["matches"]:
                empty.append(1)

    worker = threading.Thread(target=search)
    worker.start()
    for i in range(4):
        engine.index_update_files(spark.createDataFrame([("src/live.txt", bytearray(f"alpha {i}\n".encode()), True)], "path string, content binary, is_file boolean"))
    worker.join()
    assert not empty and engine.overlay.generation == 4
    assert engine.overlay.snapshot(2).first().content == b"alpha 1\n"


def test_stored_index_and_damage(spark, tmp_path, corpus):
    root = str(tmp_path / "index")
    first = ix.load_or_build(root, corpus)
    assert first.postings.count() == ix.build(corpus).postings.count()
    stored = ix.load(spark, root, corpus)
    assert found(regex_search(Sources(corpus, stored), "hello", SearchOptions(use_index="always"))) == scan(TEXTS, "hello")
    damaged = next((tmp_path / "index").rglob("postings/part-*.parquet"))
    damaged.unlink()
    for crc in damaged.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(CorruptIndex):
        ix.load(spark, root, corpus)
    again = ix.load_or_build(root, corpus)
    assert again.postings.count() == first.meta.sparkSession.read.parquet(str(next(p for p in (tmp_path / "index").rglob("postings") if p != damaged.parent))).count()


def test_timeout(spark, corpus):
    slow = F.udf(lambda b: __import__("time").sleep(2) or b, "binary")
    late = Sources(type(corpus)(corpus.docs.withColumn("content", slow("content")), "slow"))
    with pytest.raises(SearchTimeout):
        regex_search(late, "hello", SearchOptions(timeout_ms=300, request_id="r1")).rows  # noqa: B018


def test_synthetic_counts(spark):
    n = 143
    corpus = synthetic(spark, n)
    sources = Sources(corpus, ix.build(corpus, False))
    for name in ("literal", "hex_fallback"):
        result = regex_search(sources, PATTERNS[name], SearchOptions(use_index="always", no_snippet=True, max_results=None))
        assert (len(result.rows), result.candidate_count()) == expected(n)[name]
    assert expected(3000) == {"literal": (429, 429), "alternation": (504, 483), "class_heavy": (131, 131), "hex_fallback": (177, 3001)}


def test_figures():
    assert percentile([3, 1, 2], 0.5) == 2 and percentile([1, 2, 3], 0.95) == 3 and percentile([], 0.5) == 0
    assert candidate_reduction(429, 3001) == pytest.approx(85.7, abs=0.1)
    assert "| a | 1 | 1 | 50.0%" in report([{"name": "a", "matches": 1, "candidates": 1, "docs": 2, "indexed": [1.0], "scan": [2.0]}])


def test_hot_documents_forget_the_oldest():
    hot = HotDocuments(2)
    hot.add(["a", "b", "a", "c"])
    assert hot.entries() == ["b", "c"]


def test_server(spark, corpus):
    engine = Engine(spark, lambda: corpus)
    ask = [
        {"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"method": "notifications/initialized"}, {"id": 3, "method": "tools/call", "params": {"name": "regex_search", "arguments": {"pattern": "world", "options": {"no_snippet": True}, "max_results": 1}}},
        {"id": 4, "method": "nope"}, {"id": 5, "method": "hash_search", "params": {"hashes": [-1]}}, {"id": 6, "method": "index_status"},
    ]
    source, sink = io.BytesIO(), io.BytesIO()
    for message in ask:
        server.write_message(source, message)
    source.seek(0)
    server.serve(engine, source, sink)
    sink.seek(0)
    got = []
    while (m := server.read_message(sink)) is not None:
        got.append(m)
    assert [m["id"] for m in got] == [1, 2, 3, 4, 5, 6]
    assert len(got[1]["result"]["tools"]) == 7
    assert got[2]["result"]["structuredContent"]["matches"][0]["path"] == "src/a.txt"
    assert json.loads(got[2]["result"]["content"][0]["text"])["matches"][0]["snippet"] == ""
    assert got[3]["error"]["code"] == got[4]["error"]["code"] == -32000
    assert got[5]["result"]["indexed_docs"] == len(TEXTS)
    assert server.handle(engine, [])["error"]["code"] == -32700
    with pytest.raises(ValueError):
        server.read_message(io.BytesIO(b"\r\n{}"))
    assert not server.arguments(["--no-auto-index"], {}).auto_index and server.arguments(["--no-auto-index"], {"LODESTONE_AUTO_INDEX": "YES"}).auto_index


def test_streamed_changes(spark, corpus, tmp_path):
    from lodestone.streaming.ingest import ingest_changes

    engine = Engine(spark, lambda: corpus, str(tmp_path / "index"))
    arrivals = tmp_path / "in"
    spark.createDataFrame([("new.txt", "brand old text", 1), ("new.txt", "brand new text", 2), ("src/b.txt", None, 1)], "path string, content string, sequence long").repartition(3).write.parquet(str(arrivals))

    def ingest(engine, checkpoint):
        stream = spark.readStream.schema("path string, content string, sequence long").parquet(str(arrivals))
        ingest_changes(engine, stream, str(tmp_path / checkpoint), availableNow=True).awaitTermination(120)

    ingest(engine, "cp")
    assert [m["snippet"] for m in engine.regex_search("brand")["matches"]] == ["brand new text"]
    assert engine.regex_search("another")["matches"] == []
    # After a restart the changes are there; a batch that comes again isn't taken in twice.
    later = Engine(spark, lambda: corpus, str(tmp_path / "index"))
    assert [m["path"] for m in later.regex_search("brand new")["matches"]] == ["new.txt"]
    ingest(later, "cp2")
    assert later.overlay.generation == 1


def changes(spark, *rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c.encode()), True) for p, c in rows], "path string, content binary, is_file boolean")


@pytest.mark.parametrize("stored", [False, True])
def test_a_rebuild_keeps_what_the_corpus_lacks(spark, tmp_path, stored):
    texts = {"a.txt": "old", "b.txt": "beta", "c.txt": "gamma"}
    engine = Engine(spark, lambda: corpus_of(spark, texts), str(tmp_path / "index") if stored else None)
    engine.index_update_files(changes(spark, ("a.txt", "changed"), ("b.txt", "beta two"), ("c.txt", None)))
    texts |= {"b.txt": "beta two"}  # the new corpus has one of them
    engine.index_rebuild("foreground")
    paths = lambda e, pattern: [m["path"] for m in e.regex_search(pattern)["matches"]]
    for e in (engine, Engine(spark, lambda: corpus_of(spark, texts), str(tmp_path / "index"))) if stored else (engine,):
        assert paths(e, "changed") == ["a.txt"] and paths(e, "old") == paths(e, "gamma") == [] and paths(e, "beta two") == ["b.txt"]
        assert e.index_status()["overlay_dirty_files"] == 2
    texts |= {"a.txt": "changed"}
    del texts["c.txt"]
    engine.index_rebuild("foreground")
    assert engine.index_status()["freshness"] == "fresh" and paths(engine, "changed") == ["a.txt"]
    engine.index_update_files(changes(spark, ("d.txt", "delta")))
    assert engine.overlay.generation == 2 and paths(engine, "delta") == ["d.txt"]
    engine.overlay.tidy()
    assert paths(engine, "delta") == ["d.txt"]


def test_overlay_generations(spark, tmp_path):
    for store in (None, str(tmp_path / "overlay")):
        overlay = Overlay(spark, store)
        for i in range(1, 20):  # more than TABLES: merged on the way
            overlay.append(changes(spark, ("a", f"text {i}"), (f"p{i}", "x")).selectExpr("path", "'modified' AS op", "content"))
        assert len(overlay._changes) < 18 and overlay.generation == 19
        for g in (1, 4, 18, 19):
            rows = {r.path: bytes(r.content).decode() for r in overlay.snapshot(g).collect()}
            assert rows == {"a": f"text {g}"} | {f"p{i}": "x" for i in range(1, g + 1)}
    again = Overlay(spark, str(tmp_path / "overlay"))
    assert again.generation == 19 and again.snapshot().count() == 20
    again.tidy()
    assert Overlay(spark, str(tmp_path / "overlay")).snapshot().count() == 20
    same = Overlay(spark)
    same.append(spark.createDataFrame([("a", "modified", "first", 1), ("a", "deleted", None, 2), ("b", "deleted", None, 1), ("b", "modified", "last", 2)], "path string, op string, content string, sequence long"))
    assert {r.path: r.op for r in same.snapshot().collect()} == {"a": "deleted", "b": "modified"}


def test_limits_read_in_parts(spark, monkeypatch):
    from lodestone.operators import search

    texts = {f"d{i:03}.txt": "needle " * (i % 3) + ("rare" if i == 70 else "") for i in range(90)}
    corpus = corpus_of(spark, texts)
    overlay = Overlay(spark)
    overlay.append(changes(spark, ("d001.txt", "needle new"), ("zz.txt", "needle")).selectExpr("path", "'modified' AS op", "content"))
    for sources in (Sources(corpus), Sources(corpus, ix.build(corpus, False), overlay.snapshot())):
        for pattern, limit in (("needle", 1), ("needle", 7), ("needle", 88), ("needle", 500), ("rare", 5), ("nothing", 5)):
            options = SearchOptions(max_results=limit, use_index="never" if sources.index is None else "always")
            whole = [tuple(r) for r in regex_search(sources, pattern, options).rows]
            monkeypatch.setattr(search, "EARLY_DOCS", 1)
            result = regex_search(sources, pattern, options)
            assert [tuple(r) for r in result.rows] == whole
            monkeypatch.undo()
    monkeypatch.setattr(search, "EARLY_DOCS", 1)
    result, made = regex_search(Sources(corpus), "needle", SearchOptions(max_results=1)), []
    plain = result.parts
    object.__setattr__(result, "parts", lambda: (made.append(1) or part for part in plain()))
    assert len(result.rows) == 1 and len(made) < 4


def test_late_grams_are_found(spark):
    """A sparse gram at the end of a text with tens of thousands of grams."""
    import random

    r = random.Random(2)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000)) + "#@!~^"
    corpus = corpus_of(spark, {"long.txt": text, "b.txt": "short"})
    index = ix.build(corpus)
    last = max(sparse_ngrams(text.encode(), Rarity.of(index.bigrams))[-3:], key=len)
    result = hash_search(Sources(corpus, index), [gram_hash(last)], "and", HashSearchOptions(return_mode="paths"))
    assert [x.path for x in result.candidate_paths().collect()] == ["long.txt"]
