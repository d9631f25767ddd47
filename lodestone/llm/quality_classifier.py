"""A quality classifier by co-training.

Two views of a document are classified apart: its text (hashed words and byte pairs, repeats) and its page's metadata
(language, source, stated length, and the page's make-up: lines, links, marks and markup). Both start from the labelled rows. In each round each view
scores all documents without a label, and hands the ones it is surest of, with its verdict as their label, to the other. At the end each
view's scores are calibrated on labelled rows that neither was fitted on, and every document gets the combination of its two calibrated views.

Each document's features are computed once and written, a byte each. Both classifiers are logistic and fitted on the driver: on FIT_ROWS labelled
rows at most, chosen by a hash of the id, and on HANDED documents of each verdict that a view hands on in a round. All
documents without a label are candidates for these in every round; equal ones count once. A document with any label, fitted on or
not, is never handed on, so rows held out stay out.

Defined results: a null text counts as empty, null metadata are values of their own. Repeated rows get equal scores; a
document with contradicting labels counts once for each. Without both labels there is nothing to learn and every
document scores 0.5, which keeps it. An empty table gives an empty one. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, text_bytes

FIT_ROWS = 8000
#: Rounds of co-training, and documents of each verdict that a view hands on in each.
ROUNDS, HANDED = 4, 200
#: How sure a view must be of what it hands on.
SURE = 0.95
#: Buckets that words, byte pairs, and languages and sources are hashed into.
WORDS, PAIRS, BUCKETS = 128, 128, 64
#: Ridge penalty of standardised features.
PENALTY = 3.0

_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"!", b"#*$%&<>", b"|", b"=+/_@~^\\[]{}`", bytes(range(128, 256))), start=1):
    _CLASS[list(_members)] = _k
CLASSES = 12
TEXT_FEATURES, META_BYTES = WORDS + PAIRS + 6, CLASSES + 10


class _Buckets(dict):
    """Buckets of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh32_intdigest(word) % WORDS
        return found


def _byte(x: np.ndarray | float) -> np.ndarray:
    """Numbers of 0 to 1 as bytes."""
    return np.clip(np.rint(255 * np.asarray(x, float)), 0, 255).astype(np.uint8)


def text_features(text: bytes, buckets: _Buckets) -> np.ndarray:
    words = text.lower().split()
    n, w = len(text), len(words)
    found = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, w), minlength=WORDS)
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    pairs = np.bincount((b[:-1] * 31 + b[1:]) % PAIRS, minlength=PAIRS) if n > 1 else np.zeros(PAIRS)
    distinct = len(set(words))
    neighbours = list(zip(words, words[1:], strict=False))
    rates = np.sqrt(np.concatenate((found / max(1, w), pairs / max(1, n))))
    more = [np.log1p(w) / 14, min(n / max(1, w), 40) / 40, distinct / max(1, w), 1 - len(set(neighbours)) / max(1, len(neighbours)), float(w < 50), (1 - distinct / max(1, w)) * np.log1p(w) / 14]
    return _byte(np.concatenate((rates, more)))


def meta_features(lang: str | None, source: str | None, n_chars: int | None, text: bytes) -> np.ndarray:
    """The buckets of language and source, and numbers."""
    n = len(text)
    named = [xxhash.xxh32_intdigest(x) % (BUCKETS - 1) + 1 if x is not None else 0 for x in (lang, source)]
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = max(0, n_chars or 0)
    more = [np.log1p(size) / 20, (np.log1p(size) / 20) ** 2, float(size < 300), float(n_chars is None), np.log1p(len(lines)) / 10, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 14, np.log1p(text.count(b"://")) / 7]
    return np.concatenate((np.array(named, np.uint8), _byte(np.log1p(100 * counts / max(1, n)) / 5), _byte(more)))


def _expanded(text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stored bytes as numbers, buckets as columns."""
    named = np.zeros((len(meta), 2 * BUCKETS))
    rows = np.arange(len(meta))
    named[rows, meta[:, 0]] = 1
    named[rows, BUCKETS + meta[:, 1]] = 1
    return text / 255.0, np.concatenate((named, meta[:, 2:] / 255.0), axis=1)


def _views(text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _expanded(np.frombuffer(b"".join(text), np.uint8).reshape(-1, TEXT_FEATURES), np.frombuffer(b"".join(meta), np.uint8).reshape(-1, META_BYTES))


@dataclass
class Logistic:
    """Ridge-penalised logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(30):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Two views, the calibration of each (log odds to log odds), the base rate of the labels, and what each round handed on."""

    views: tuple[Logistic, Logistic]
    calibrations: tuple[Logistic, Logistic]
    base: float
    rounds: list[tuple[int, int]]

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The calibrated score of each view and their combination: the evidence of both beside the base rate, once."""
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, xs, strict=True)]
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0] + odds[1] - self.base)


#: Of two views and the keys that each view has handed on, what each is surest of now: rows' views, their verdicts and their keys.
Hand = Callable[[list[Logistic], list[set]], list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray, list]]]


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, hand: Hand, rounds: int = ROUNDS) -> CoTrained | None:
    """Rows come in a hashed order; every fourth labelled row is held out for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if min((y[~held] == k).sum() for k in (0, 1)) == 0 or min((y[held] == k).sum() for k in (0, 1)) == 0:
        return None
    own = [(labelled[v][~held], y[~held].astype(float)) for v in (0, 1)]
    taken, given = [set(), set()], []
    views = [Logistic.fit(*own[v]) for v in (0, 1)]
    for _ in range(rounds):
        found = hand(views, taken)
        for v, (xs, verdicts, keys) in enumerate(found):
            other = 1 - v
            taken[v].update(keys)
            own[other] = (np.concatenate((own[other][0], xs[other])), np.concatenate((own[other][1], verdicts)))
        given.append(tuple(len(f[2]) for f in found))
        if not any(given[-1]):
            break
        views = [Logistic.fit(*own[v]) for v in (0, 1)]
    marks = y[held].astype(float)
    calibrations = [Logistic.fit(views[v].odds(labelled[v][held])[:, None], marks, 0.1) for v in (0, 1)]
    rate = marks.mean()
    return CoTrained(tuple(views), tuple(calibrations), float(np.log(rate / (1 - rate))), given)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_x, meta_x) of (doc_id, text, lang, source, n_chars): a byte for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            texts = text_bytes(batch.column(1))
            text_x = [text_features(x, buckets).tobytes() for x in texts]
            meta_x = [meta_features(*m, x).tobytes() for *m, x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_x, pa.binary()), pa.array(meta_x, pa.binary())], ["doc_id", "text_x", "meta_x"])

    return map_batches(docs, run, "doc_id long, text_x binary, meta_x binary")


def _handed(pool: DataFrame, views: list[Logistic], taken: list[set], sure: float, handed: int) -> list:
    """For each view the `handed` surest documents of each verdict: each task names its own, and the surest of those are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, tuple[float, bytes, bytes]]] = {(v, k): {} for v in (0, 1) for k in (0, 1)}
        for batch in batches:
            if not len(batch):
                continue
            text, meta = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for v, x in enumerate(_views(text, meta)):
                odds = views[v].odds(x)
                for k in (0, 1):
                    own, signed = best[v, k], odds if k else -odds
                    for i in np.flatnonzero(_sigmoid(signed) >= sure).tolist():
                        key = xxhash.xxh64_intdigest(text[i] + meta[i]) - (1 << 63)
                        if key not in taken[v]:
                            own[key] = (round(float(signed[i]), 6), text[i], meta[i])
                    if len(own) > 4 * handed:
                        best[v, k] = dict(sorted(own.items(), key=lambda e: (-e[1][0], e[0]))[:handed])
        rows = [(v, k, key, *row) for (v, k), own in best.items() for key, row in sorted(own.items(), key=lambda e: (-e[1][0], e[0]))[:handed]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["view", "verdict", "key", "odds", "text_x", "meta_x"])

    named = cut(map_batches(pool, run, "view int, verdict int, key long, odds double, text_x binary, meta_x binary"), "handed").dropDuplicates(["view", "verdict", "key"])
    parts = [named.where((F.col("view") == v) & (F.col("verdict") == k)).orderBy(F.desc("odds"), "key").limit(handed) for v in (0, 1) for k in (0, 1)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).collect()  # 4 * handed at most
    out = []
    for v in (0, 1):
        own = sorted((r for r in rows if r["view"] == v), key=lambda r: (r["verdict"], -r["odds"], r["key"]))
        out.append((_views([r["text_x"] for r in own], [r["meta_x"] for r in own]), np.array([r["verdict"] for r in own], float), [r["key"] for r in own]))
    return out


def fit(found: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, handed: int = HANDED, sure: float = SURE) -> CoTrained | None:
    """found: features() of all documents, written. labels: doc_id, quality."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    some = marks.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(fit_rows)  # the broadcast's bound
    rows = found.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "quality", "text_x", "meta_x").limit(fit_rows).collect()
    if not rows:
        return None
    pool = cut(found.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").select("text_x", "meta_x"), "pool")
    return co_train(_views([r["text_x"] for r in rows], [r["meta_x"] for r in rows]), np.array([r["quality"] for r in rows], int), lambda views, taken: _handed(pool, views, taken, sure, handed))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, handed: int = HANDED, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept), one row for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    found = cut(features(own), "features")
    model = fit(found, labels, fit_rows, handed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            scores = model.scores(_views(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if model is not None and n else [np.full(n, 0.5)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores), pa.array(scores[2] >= threshold)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return map_batches(found, run, "doc_id long, text_score double, meta_score double, score double, kept boolean")
