"""The engine: a corpus, its stored index, an overlay of changes and recently searched documents behind seven methods."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest, RebuildAlreadyRunning
from ..sources.corpus import Corpus, from_files, git_head
from ..sources.paths import relative_path
from . import index as ix
from .overlay import Overlay, classified, not_held, outcome_counts
from .search import HashSearchOptions, SearchOptions, SearchResult, Sources, hash_search, hot_search, literal_search, regex_search

HOT_DOCUMENTS = 128
#: Candidates that an answer lists at most; their number is always whole.
LISTED = 10_000


@dataclass(frozen=True)
class _Base:
    """An immutable snapshot: readers keep the one they started with."""

    corpus: Corpus
    index: ix.Index
    generation: int


class HotDocuments:
    """Paths of documents in recent results, the oldest first; a path keeps its place from its first insertion."""

    def __init__(self, size: int = HOT_DOCUMENTS) -> None:
        self.size, self._paths, self._lock = size, OrderedDict(), threading.Lock()

    def add(self, paths: Sequence[str]) -> None:
        with self._lock:
            for p in paths:
                self._paths.setdefault(p, None)
                while len(self._paths) > self.size:
                    self._paths.popitem(last=False)

    def entries(self) -> list[str]:
        with self._lock:
            return list(self._paths)


class Engine:
    """open_corpus makes the current corpus; it is called again by each rebuild. Without index_root the index isn't stored, and
    the overlay ends with the session."""

    def __init__(self, spark: SparkSession, open_corpus: Callable[[], Corpus], index_root: str | None = None, auto_index: bool = True) -> None:
        self.spark, self._open, self._root = spark, open_corpus, index_root
        self._lock, self._running, self._failure = threading.Lock(), False, None
        self.hot = HotDocuments()
        corpus = open_corpus()
        self.overlay = Overlay(spark, f"{index_root.rstrip('/')}/overlay/repo_id={ix.repo_id(corpus.name)}" if index_root else None)
        self._base = _Base(corpus, self._indexed(corpus, False) if auto_index else None, 1)

    @classmethod
    def over_files(cls, spark: SparkSession, root: str, index_root: str | None = None, auto_index: bool = True) -> Engine:
        """Files of a directory, or of its git commit. The index goes below the directory unless told otherwise."""

        def open_corpus() -> Corpus:
            head = git_head(root)
            return from_files(spark, root, None if head == "NO_VERSION" else head)

        out = cls(spark, open_corpus, index_root or f"{root.rstrip('/')}/.lodestone/index", auto_index)
        out.workspace = root
        return out

    workspace: str | None = None

    def _indexed(self, corpus: Corpus, fresh: bool) -> ix.Index:
        if self._root is None:
            return ix.build(corpus)
        if fresh:
            ix.write(ix.build(corpus), self._root, corpus)
        return ix.load_or_build(self._root, corpus)

    def _sources(self) -> tuple[Sources, int, int]:
        with self._lock:
            base, generation, empty = self._base, self.overlay.generation, self.overlay.empty
            return Sources(base.corpus, base.index, None if empty else self.overlay.snapshot()), base.generation, generation

    # The seven methods.

    def regex_search(self, pattern: str, options: SearchOptions = SearchOptions()) -> dict:
        return self._answer(lambda s: regex_search(s, pattern, options), listed=True)

    def literal_search(self, literal: str, options: SearchOptions = SearchOptions()) -> dict:
        return self._answer(lambda s: literal_search(s, literal, options), listed=not options.case_sensitive)

    def hash_search(self, hashes: list[int], logic: str = "and", options: HashSearchOptions = HashSearchOptions()) -> dict:
        return self._answer(lambda s: hash_search(s, hashes, logic, options), listed=False, remember=False)

    def hot_search(self, pattern: str, options: SearchOptions = SearchOptions()) -> dict:
        sources, base, overlay = self._sources()
        order = [(i, p) for i, p in enumerate(self.hot.entries())]
        places = self.spark.createDataFrame(order, "position long, path string")
        hot = sources.corpus.docs.select("path", "content").join(F.broadcast(places), "path")  # HOT_DOCUMENTS rows at most
        return self._response(hot_search(hot, pattern, options), base, overlay, listed=False)

    def index_status(self) -> dict:
        with self._lock:
            base, dirty = self._base, 0 if self.overlay.empty else self.overlay.snapshot().count()
            state = {"state": "running"} if self._running else {"state": "failed", "message": self._failure} if self._failure else {"state": "idle"}
        current = git_head(self.workspace) if self.workspace else base.corpus.version
        fresh = current == base.corpus.version and not dirty
        return {"base_commit": base.corpus.version, "current_commit": current, "repo_id": ix.repo_id(base.corpus.name), "freshness": "fresh" if fresh else "stale", "overlay_dirty_files": dirty, "rebuild_state": state, "indexed_docs": base.corpus.meta.count(), "base_generation": base.generation}

    def index_update_files(self, changed: Sequence[str] | DataFrame, batch: int | None = None) -> dict:
        """Paths below the workspace, whose contents are read now; or a table (path, content, is_file), perhaps with a sequence that
        orders changes of one path. batch: see Overlay.append."""
        rows = changed if isinstance(changed, DataFrame) else self._read(changed)
        found = classified(rows)
        kept = found.where("outcome <> 'skipped'").select("path", "op", "content", *(["sequence"] if "sequence" in found.columns else []))
        counts = outcome_counts(found).first().asDict()
        with self._lock:
            if counts["updated"] + counts["deleted"]:
                self.overlay.append(kept, batch)
            return counts | {"generation": self.overlay.generation}

    def index_rebuild(self, mode: str = "background") -> dict:
        if mode not in ("foreground", "background"):
            raise InvalidRequest(f"unknown rebuild mode {mode!r}")
        if mode == "foreground":
            self._rebuild()
            return {"mode": mode, "doc_count": self._base.corpus.meta.count(), "posting_count": self._base.index.postings.count()}
        with self._lock:
            if self._running:
                raise RebuildAlreadyRunning("a rebuild is running")
            self._running, self._failure = True, None

        def run() -> None:
            try:
                self._rebuild()
            except Exception as e:
                with self._lock:
                    self._failure = str(e)[:500]
            finally:
                with self._lock:
                    self._running = False

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return {"mode": mode, "doc_count": self._base.corpus.meta.count(), "posting_count": 0}

    def _rebuild(self) -> None:
        """A new snapshot takes the place of the old one at once; changes that it holds leave the overlay, others stay."""
        with self._lock:
            seen, before = self.overlay.generation, None if self.overlay.empty else self.overlay.latest()
        corpus = self._open()
        index = self._indexed(corpus, True)
        left = None if before is None else not_held(before, corpus.docs, corpus.live).persist()
        if left is not None:
            left.count()  # outside the lock
        with self._lock:
            self._base = _Base(corpus, index, self._base.generation + 1)
            if left is not None:
                self.overlay.replace(left, seen)
        if left is not None:
            left.unpersist()

    def _read(self, paths: Sequence[str]) -> DataFrame:
        """Contents of a list of files as long as the request."""
        import os

        root = (self.workspace or "").removeprefix("file://")
        rows = []
        for p in dict.fromkeys(paths):
            full = p if os.path.isabs(p) else os.path.join(root, p)
            if not os.path.exists(full):
                rows.append((full, None, True))
            elif not os.path.isfile(full):
                rows.append((full, None, False))
            else:
                with open(full, "rb") as f:
                    rows.append((full, f.read(), True))
        made = self.spark.createDataFrame([(a, None if b is None else bytearray(b), c) for a, b, c in rows], "path string, content binary, is_file boolean")
        return made.withColumn("path", relative_path(F.col("path"), root))

    def _answer(self, search: Callable[[Sources], SearchResult], listed: bool, remember: bool = True) -> dict:
        sources, base, overlay = self._sources()
        out = self._response(search(sources), base, overlay, listed)
        if remember and out["return_mode"] == "matches":
            self.hot.add(list(dict.fromkeys(m["path"] for m in out["matches"])))
        return out

    @staticmethod
    def _response(result: SearchResult, base: int, overlay: int, listed: bool) -> dict:
        mode = result.options.return_mode
        count = result._within(result.candidate_count)
        ids, paths = [], []
        if (listed or mode != "matches") and mode != "count":
            ids = [r[0] for r in result._within(lambda: result.candidate_ids().limit(LISTED).collect())]
            paths = [r[0] for r in result._within(lambda: result.candidate_paths().limit(LISTED).collect())]
        return {"matches": [r.asDict() for r in result.rows], "candidate_count": count, "used_fallback": result.plan.used_fallback, "extracted_literals": list(result.plan.literals), "base_generation": base, "overlay_generation": overlay, "candidate_doc_ids": ids, "candidate_paths": paths, "return_mode": mode}
