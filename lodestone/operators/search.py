"""The search operators over a corpus, an optional index and an overlay, as lazy DataFrames."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest, SearchTimeout
from ..functions.dialect import Compiled, compile_pattern
from ..functions.grams import Rarity, hash_column, signed
from ..functions.positions import Finder, literal_finder, match_rows, regex_finder
from ..plans import candidates as cand
from ..plans.planner import QueryPlan, plan_compiled, plan_literal
from ..sources.corpus import Corpus
from ..sources.paths import PathFilter
from .index import Index

MAX_RESULTS = 200
MODES = ("matches", "ids", "paths", "count")
#: Bytes of a corpus from which the index may pay; below, one scan is cheaper than a second stage.
AUTO_INDEX_BYTES = 4 << 30
#: Candidates up to which their ids are looked up first.
LOOKUP_IDS = 2000
#: Candidates of a stored index up to which their ids, 8 bytes each, go to all executors, so that no text is shuffled.
SENT_IDS = 1 << 20
#: Documents from which a limited search goes through them in parts by id; the first is this share of them, each next one twice the last.
EARLY_DOCS, FIRST_PART = 1 << 16, 64


@dataclass(frozen=True)
class SearchOptions:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    max_results: int | None = MAX_RESULTS
    case_sensitive: bool = True
    dotall: bool = False
    multiline: bool = False
    no_snippet: bool = False
    literal: bool = False
    parallel: bool = True
    return_mode: str = "matches"
    timeout_ms: int | None = None
    request_id: str | None = None
    use_index: str = "auto"
    budget: bool = False

    def __post_init__(self) -> None:
        if self.return_mode not in MODES:
            raise InvalidRequest(f"unknown return mode {self.return_mode!r}")

    @property
    def limit(self) -> int | None:
        """0 stands for the default; None for no limit, which only the DataFrame interface has."""
        return self.max_results if self.max_results is None else self.max_results or MAX_RESULTS

    @property
    def filter(self) -> PathFilter:
        return PathFilter(self.include, self.globs, self.exclude)


@dataclass(frozen=True)
class HashSearchOptions(SearchOptions):
    verify_literal: str | None = None


@dataclass(frozen=True)
class Sources:
    """What a search reads: one consistent snapshot."""

    corpus: Corpus
    index: Index | None = None
    overlay: DataFrame | None = None

    def base(self, paths: PathFilter) -> DataFrame:
        """Documents that pass the filter and that no change hides, even one whose own path doesn't pass."""
        docs = self.corpus.docs.where(paths.predicate(F.col("path")))
        return docs if self.overlay is None else docs.join(self.overlay.select("path"), "path", "left_anti")

    def changed(self, paths: PathFilter) -> DataFrame | None:
        if self.overlay is None:
            return None
        return self.overlay.where(F.col("op") == "modified").where(paths.predicate(F.col("path"))).select("path", "content")


@dataclass(frozen=True)
class SearchResult:
    """Lazy frames: candidates (is_overlay, doc_id, path) and matches (path, byte_offset, end_offset, line, column, snippet)."""

    candidates: DataFrame
    matches: DataFrame | None
    plan: QueryPlan
    options: SearchOptions
    #: Makes the matches in parts, in their order, each with at most a given number.
    parts: Callable[[], Iterator[Callable[[int], DataFrame]]] | None = field(default=None, compare=False)

    def candidate_count(self) -> int:
        return self.candidates.count()

    def candidate_ids(self) -> DataFrame:
        return self.candidates.where("NOT is_overlay").select("doc_id").orderBy("doc_id")

    def candidate_paths(self) -> DataFrame:
        return self.candidates.select("is_overlay", "doc_id", "path").orderBy("is_overlay", "doc_id", "path").select("path")

    @cached_property
    def rows(self) -> list:
        """The matches; with a limit, no more documents are read than part by part are needed to reach it."""
        if self.matches is None:
            return []
        return self._within(self._read if self.parts is not None else self.matches.collect)

    def _read(self) -> list:
        out: list = []
        for part in self.parts():
            out += part(self.options.limit - len(out)).collect()
            if len(out) >= self.options.limit:
                break
        return out

    def _within(self, action):
        """Run an action; its jobs are cancelled at the deadline."""
        o, sc = self.options, self.candidates.sparkSession.sparkContext
        if not o.timeout_ms:
            return action()
        tag, late = f"search-{o.request_id or id(self)}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(o.timeout_ms / 1000, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            out = action()
        except Exception as e:
            if late.is_set():
                raise SearchTimeout(o.request_id, o.timeout_ms) from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        if late.is_set():
            raise SearchTimeout(o.request_id, o.timeout_ms)
        return out


def _with_index(sources: Sources, plan: QueryPlan, use_index: str) -> bool:
    if use_index not in ("auto", "always", "never"):
        raise InvalidRequest(f"unknown use_index {use_index!r}")
    if sources.index is None or plan.kind == "all" or use_index == "never":
        return False
    if use_index == "always":
        return True
    size, n = sources.index.size()
    return size >= AUTO_INDEX_BYTES and cand.rarest(sources.index.gram_counts(plan.folded, cand.wanted_grams(plan)), plan) <= cand.SELECTIVE * n


def _candidates(sources: Sources, plan: QueryPlan, options: SearchOptions, indexed: bool) -> tuple[DataFrame, DataFrame | None]:
    """Documents with content that the plan admits: of the base, and of the overlay.

    The grams come from the index or, without it, from the texts as they are scanned: the same documents either way.
    """
    base, changed = sources.base(options.filter), sources.changed(options.filter)
    if plan.kind != "all":
        if indexed:
            hit = cand.by_plan(sources.index.grams(plan.folded, cand.wanted_grams(plan)), plan)
            ids = hit.unionByName(sources.index.meta.where("NOT indexed").select("doc_id"))
            base = _looked_up(base, ids, sources, plan)
        else:
            base = base.where(~F.col("indexed") | cand.held(F.col("content"), plan))
        if changed is not None:
            changed = changed.where(cand.held(F.col("content"), plan))
    return base, changed


def _looked_up(base: DataFrame, ids: DataFrame, sources: Sources, plan: QueryPlan) -> DataFrame:
    """The documents of some ids. A few ids that a stored index names go into the scan's filter, which skips what holds none of them."""
    most = None if sources.index.doc_count is None else cand.rarest(sources.index.gram_counts(plan.folded, cand.wanted_grams(plan)), plan)
    if most is not None and most <= LOOKUP_IDS:
        few = [r[0] for r in ids.limit(LOOKUP_IDS + 1).collect()]
        if len(few) <= LOOKUP_IDS:
            return base.where(F.col("doc_id").isin(few))
    return base.join(F.broadcast(ids) if most is not None and most <= SENT_IDS else ids, "doc_id", "left_semi")


def _listed(base: DataFrame, changed: DataFrame | None) -> DataFrame:
    out = base.select(F.lit(False).alias("is_overlay"), "doc_id", "path")
    if changed is not None:
        out = out.unionByName(changed.select(F.lit(True).alias("is_overlay"), F.lit(None).cast("long").alias("doc_id"), "path"))
    return out


def located_matches(base: DataFrame, changed: DataFrame | None, found: Finder, options: SearchOptions, limit: int | None) -> DataFrame:
    """Base matches by doc_id and offset, then those of the overlay by path and offset."""
    texts = base.select(F.lit(False).alias("is_overlay"), "doc_id", "path", "content")
    if changed is not None:
        texts = texts.unionByName(changed.select(F.lit(True).alias("is_overlay"), F.lit(None).cast("long").alias("doc_id"), "path", "content"))
    rows = match_rows(texts, found, not options.no_snippet).orderBy("is_overlay", "doc_id", "path", "byte_offset", "end_offset")
    return (rows if limit is None else rows.limit(limit)).select("path", "byte_offset", "end_offset", "line", "column", "snippet")


def _parts(docs: DataFrame, base: DataFrame, changed: DataFrame | None, found: Finder, options: SearchOptions) -> Callable | None:
    """located_matches() by ranges of ids, and the overlay's last."""
    if options.limit is None:
        return None

    def made() -> Iterator[Callable[[int], DataFrame]]:
        low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
        if n < EARLY_DOCS:
            yield lambda left: located_matches(base, changed, found, options, left)
            return
        step, start, own = max(1, (high - low + 1) // FIRST_PART), None, F.col("doc_id")
        while start is None or start <= high:
            end = low + step if start is None else start + step
            within = own.isNull() | (own < end) if start is None else own >= start if end > high else (own >= start) & (own < end)
            yield lambda left, within=within: located_matches(base.where(within), None, found, options, left)
            start, step = end, 2 * step
        if changed is not None:
            yield lambda left: located_matches(base.where(F.lit(False)), changed, found, options, left)

    return made


def _verifiable(base: DataFrame, changed: DataFrame | None, plan: QueryPlan, prefilter: bool) -> tuple[DataFrame, DataFrame | None]:
    """Only texts with the required strings reach Python."""
    if not prefilter:
        return base, changed
    keep = cand.required_bytes(F.col("content"), plan)
    return base.where(keep), changed.where(keep) if changed is not None else None


def _searched(sources: Sources, plan: QueryPlan, options: SearchOptions, found: Finder) -> SearchResult:
    indexed = _with_index(sources, plan, options.use_index)
    base, changed = _candidates(sources, plan, options, indexed)
    matches = parts = None
    if options.return_mode == "matches":
        if indexed:
            texts = _verifiable(base, changed, plan, True)
        else:  # the scan verifies at once: grams of the text would cost more than the pattern
            texts = _verifiable(sources.base(options.filter), sources.changed(options.filter), plan, True)
        matches = located_matches(*texts, found, options, options.limit)
        parts = _parts(sources.corpus.docs if sources.index is None else sources.index.meta, *texts, found, options)
    return SearchResult(_listed(base, changed), matches, plan, options, parts)


def regex_search(sources: Sources, pattern: str, options: SearchOptions = SearchOptions()) -> SearchResult:
    if not pattern:
        raise InvalidRequest("pattern cannot be empty")
    compiled = compile_pattern(pattern, options.case_sensitive, options.dotall, options.multiline, options.literal)
    budget = Rarity.of(sources.index.bigrams) if options.budget and sources.index is not None else None
    plan = plan_literal(pattern.encode(), options.case_sensitive, budget) if options.literal else plan_compiled(compiled, options.case_sensitive, budget)
    return _searched(sources, plan, options, regex_finder(compiled, options.limit))


def literal_search(sources: Sources, literal: str, options: SearchOptions = SearchOptions()) -> SearchResult:
    if not literal:
        raise InvalidRequest("literal cannot be empty")
    if not options.case_sensitive:
        return regex_search(sources, literal, SearchOptions(**{**options.__dict__, "literal": True}))
    plan = plan_literal(literal.encode(), True)
    if plan.kind == "all":  # too short for grams, but the text still has to hold it
        plan = QueryPlan("all", used_fallback=plan.used_fallback, strings=((literal.encode(),),))
    return _searched(sources, plan, options, literal_finder(literal.encode(), options.limit))


def hash_search(sources: Sources, hashes: list[int], logic: str = "and", options: HashSearchOptions = HashSearchOptions()) -> SearchResult:
    """Documents by public gram hashes (unsigned or signed), verified by a literal if one is given."""
    if logic not in ("and", "or"):
        raise InvalidRequest(f"unknown logic {logic!r}")
    if sources.index is None:
        raise InvalidRequest("hash search needs an index")
    if options.verify_literal is None and options.return_mode == "matches":
        raise InvalidRequest("hash search without a literal to verify has no matches to return")
    wanted = sorted({signed(int(h)) for h in hashes})
    base, changed = sources.base(options.filter), sources.changed(options.filter)
    if wanted or logic == "or":
        hashes = sources.index.hashed(wanted)
        hit = cand.all_of(hashes, wanted, "hash") if logic == "and" else cand.any_of(hashes, wanted, "hash")
        base = base.join(hit.unionByName(sources.index.meta.where("NOT indexed").select("doc_id")), "doc_id", "left_semi")
    if changed is not None:
        rarity = Rarity.of(sources.index.bigrams)
        changed = changed.where(cand.hashes_admitted(hash_column(F.col("content"), rarity), wanted, logic))
    matches = None
    if options.verify_literal is not None:
        compiled: Compiled = compile_pattern(options.verify_literal, options.case_sensitive, literal=True)
        matches = located_matches(base, changed, regex_finder(compiled, options.limit), options, options.limit)
    return SearchResult(_listed(base, changed), matches, QueryPlan("all"), options)


def hot_search(hot: DataFrame, pattern: str, options: SearchOptions = SearchOptions()) -> SearchResult:
    """Search remembered documents only: hot is (position, path, content), oldest first."""
    if not pattern:
        raise InvalidRequest("pattern cannot be empty")
    compiled = compile_pattern(pattern, options.case_sensitive, options.dotall, options.multiline, options.literal)
    kept = hot.where(options.filter.predicate(F.col("path"))).select(F.col("position").alias("doc_id"), "path", "content")
    matches = None
    if options.return_mode == "matches":
        matches = located_matches(kept, None, regex_finder(compiled, options.limit), options, options.limit)
    return SearchResult(_listed(kept, None), matches, QueryPlan("all"), options)


def match_counts(sources: Sources, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(doc_id, path, n): verified matches of every document that has any."""
    from ..functions.positions import match_count

    compiled = compile_pattern(pattern, options.case_sensitive, options.dotall, options.multiline, options.literal)
    plan = plan_literal(pattern.encode(), options.case_sensitive) if options.literal else plan_compiled(compiled, options.case_sensitive)
    docs = sources.base(options.filter).where(cand.required_bytes(F.col("content"), plan))
    return docs.select("doc_id", "path", match_count(F.col("content"), compiled).alias("n")).where("n > 0")


def matching_docs(sources: Sources, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(doc_id, path) with a match: in the JVM where its engine decides as ours does, else through match counts."""
    from ..functions.dialect import java_predicate

    java = java_predicate(pattern, options.case_sensitive) if not (options.dotall or options.multiline or options.literal) else None
    if java is None:
        return match_counts(sources, pattern, options).select("doc_id", "path")
    return sources.base(options.filter).where(F.col("content").cast("string").rlike(java)).select("doc_id", "path")
