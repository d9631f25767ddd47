"""The inverted index: built from a corpus, stored as versioned Parquet with a manifest, loaded only when whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptIndex
from ..functions import batches as bt
from ..functions.grams import Rarity, bigram_frequency, fold, index_hashes, pack_trigrams, sparse_column, trigram_hashes
from ..sources.corpus import Corpus
from ..sources.store import exists, remove

#: Postings that Python inverts at once while an index is written, and documents that a row of the inverted ones names at most.
INVERTED, LISTED_DOCS = 1 << 21, 128
TABLES = ("meta", "postings", "folded", "hashes", "bigrams", "counts")


def repo_id(name: str) -> str:
    return f"{xxhash.xxh3_64_intdigest(name.encode()):016x}"


@dataclass(frozen=True)
class Index:
    """meta (doc_id, path, size, mtime_secs, indexed), postings and folded (gram, doc_id), hashes (hash, doc_id),
    bigrams (key, freq), counts (gram, folded, n): the documents of each gram. A stored index knows its documents and their bytes."""

    meta: DataFrame
    postings: DataFrame
    folded: DataFrame
    hashes: DataFrame
    bigrams: DataFrame
    counts: DataFrame
    doc_count: int | None = None
    doc_bytes: int | None = None
    #: Where the tables aren't made yet: the documents that they come from, and for long grams the pairs' rarity.
    docs: DataFrame | None = field(default=None, compare=False)
    rarity: Rarity | None = field(default=None, compare=False)

    def size(self) -> tuple[int, int]:
        """Bytes and number of the documents."""
        if self.doc_count is not None and self.doc_bytes is not None:
            return self.doc_bytes, self.doc_count
        return tuple(self.meta.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first())

    def gram_counts(self, folded: bool, wanted: Iterable[int]) -> DataFrame:
        if self.docs is not None:
            return self.grams(folded, wanted).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        return self.counts.where((F.col("folded") == folded) & _in("gram", wanted)).select("gram", "n")

    def grams(self, folded: bool, wanted: Iterable[int]) -> DataFrame:
        """The postings of some grams. Without tables the others go before they leave Python."""
        if self.docs is not None:
            return postings_of(self.docs, folded, wanted)
        return (self.folded if folded else self.postings).where(_in("gram", wanted))

    def hashed(self, wanted: Iterable[int]) -> DataFrame:
        """The documents of some hashes, in the same way."""
        if self.docs is not None:
            return hashes_of(self.docs, self.rarity, wanted)
        return self.hashes.where(_in("hash", wanted))


def _in(column: str, wanted: Iterable[int]) -> Column:
    return F.col(column).isin(sorted({int(w) for w in wanted}))


def postings_of(docs: DataFrame, folded: bool = False, wanted: Iterable[int] | None = None) -> DataFrame:
    """(gram, doc_id): of all grams, or of some."""
    return _keys(docs, "gram", lambda text: pack_trigrams(fold(text) if folded else text), wanted)


def hashes_of(docs: DataFrame, rarity: Rarity | None, wanted: Iterable[int] | None = None) -> DataFrame:
    """(hash, doc_id): of three-byte grams and, with the pairs' rarity, of sparse ones."""
    return _keys(docs, "hash", _hasher(rarity), wanted)


def _hasher(rarity: Rarity | None) -> Callable[[bytes], np.ndarray]:
    return (lambda text: trigram_hashes(pack_trigrams(text))) if rarity is None else lambda text: index_hashes(text, rarity)


def _keys(docs: DataFrame, name: str, keys: Callable[[bytes], np.ndarray], wanted: Iterable[int] | None) -> DataFrame:
    """(name, doc_id) of the distinct keys of each text, in rows as they leave Python: a piece of the texts is held at once."""
    only = None if wanted is None else np.array(sorted({int(w) for w in wanted}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in bt.pieces(batches):
            ids, found = _found(piece, keys)
            if only is not None:
                keep = np.isin(found, only)
                ids, found = ids[keep], found[keep]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ids)], [name, "doc_id"])

    return docs.select("doc_id", "content").mapInArrow(run, f"{name} long, doc_id long")


def _found(piece: pa.RecordBatch, keys: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and keys of a piece's texts, one of each for a posting."""
    texts = [keys(t.as_py() or b"") for t in piece.column(1)]
    ids = np.repeat(piece.column(0).to_numpy(zero_copy_only=False), [len(t) for t in texts])
    return ids, np.concatenate(texts) if texts else np.zeros(0, np.int64)


#: Rows of _inverted(): which table they belong to, and the key as a gram (tables 0 and 1) and as a hash (0 without long grams, and 2).
_INVERTED = "which int, gram long, hash long, doc_ids array<long>"


def _inverted(docs: DataFrame, rarity: Rarity | None) -> DataFrame:
    """All tables' postings in one pass over the texts, as lists: the documents of a key within a part of the texts, LISTED_DOCS of
    them at most, so rows are few and none is long. Postings of 0 are the grams, of 1 the folded ones, of 2 the long grams' hashes."""
    made: list[Callable[[bytes], np.ndarray]] = [pack_trigrams, lambda text: pack_trigrams(fold(text))]
    if rarity is not None:
        made.append(_hasher(rarity))

    def lists(which: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, keys = (np.concatenate(x) for x in zip(*parts))
        # Grams leave room for their place, and sorting values is much faster than sorting places.
        order = np.argsort(keys, kind="stable") if which == 2 else np.sort((keys << 32) | np.arange(len(keys))) & 0xFFFFFFFF
        ids, keys = ids[order], keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        within = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
        starts = np.flatnonzero(within % LISTED_DOCS == 0)
        key, none = keys[starts], pa.nulls(len(starts), pa.int64())
        gram = none if which == 2 else pa.array(key)
        hashed = pa.array(key) if which == 2 else pa.array(trigram_hashes(key)) if which == 0 and rarity is None else none
        doc_ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), which, np.int32)), gram, hashed, doc_ids], ["which", "gram", "hash", "doc_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[] for _ in made]
        held = [0] * len(made)
        for piece in bt.pieces(batches):
            for which, keys in enumerate(made):
                ids, found = _found(piece, keys)
                parts[which].append((ids, found))
                held[which] += len(ids)
                if held[which] >= INVERTED:
                    yield lists(which, parts[which])
                    parts[which], held[which] = [], 0
        for which, left in enumerate(parts):
            if held[which]:
                yield lists(which, left)

    return docs.select("doc_id", "content").mapInArrow(run, _INVERTED)


def posting_lists(postings: DataFrame, by: str = "gram") -> DataFrame:
    """The list form: sorted, distinct ids of each gram."""
    return postings.groupBy(by).agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def gram_dictionary(postings: DataFrame) -> DataFrame:
    """(gram, hash): the public hash of each gram that occurs, computed once for each."""

    @F.pandas_udf("long")
    def run(grams):
        return pd.Series(trigram_hashes(grams.to_numpy()))

    return postings.select("gram").distinct().select("gram", run("gram").alias("hash"))


def build(corpus: Corpus, long_grams: bool = True) -> Index:
    """A lazy index. Grams are distinct within a document before the shuffle, so postings need no further aggregation."""
    docs = corpus.docs.where("indexed")
    bigrams = bigram_frequency(docs)
    rarity = Rarity.of(bigrams) if long_grams else None
    postings, folded = postings_of(docs), postings_of(docs, True)
    return Index(corpus.meta, postings, folded, hashes_of(docs, rarity), bigrams, counts_of(postings, folded), docs=docs, rarity=rarity)


def counts_of(postings: DataFrame, folded: DataFrame) -> DataFrame:
    one = lambda p, f: p.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).select("gram", F.lit(f).alias("folded"), "n")
    return one(postings, False).unionByName(one(folded, True))


def sparse_table(corpus: Corpus, bigrams: DataFrame | None = None) -> DataFrame:
    """(doc_id, ngram): the sparse grams of every indexed document."""
    docs = corpus.docs.where("indexed")
    rarity = Rarity.of(bigrams if bigrams is not None else bigram_frequency(docs))
    return docs.select("doc_id", F.explode(sparse_column(F.col("content"), rarity)).alias("ngram"))


def _home(root: str, corpus: Corpus) -> str:
    return f"{root.rstrip('/')}/repo_id={repo_id(corpus.name)}/commit_id={corpus.version}"


def write(index: Index, root: str, corpus: Corpus) -> str:
    """A new version folder; its manifest comes last, so a version without one was never finished.

    Postings are range-sorted by gram: a lookup reads the row groups whose range holds it.
    """
    spark = corpus.docs.sparkSession
    home = f"{_home(root, corpus)}/version={uuid.uuid4().hex}"
    index.meta.repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{home}/meta")
    index.bigrams.coalesce(1).sortWithinPartitions("key").write.parquet(f"{home}/bigrams")
    if index.docs is None:
        for name, key in (("postings", "gram"), ("folded", "gram"), ("hashes", "hash")):
            getattr(index, name).repartitionByRange(key).sortWithinPartitions(key, "doc_id").write.parquet(f"{home}/{name}")
        grams = counts_of(*(spark.read.parquet(f"{home}/{t}") for t in ("postings", "folded")))
    else:
        grams = _write_inverted(index, home)
    # 2 ** 24 grams of each kind at most.
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{home}/counts")
    remove(spark, f"{home}/inverted")
    size = spark.read.parquet(f"{home}/meta").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    counts = {t: spark.read.parquet(f"{home}/{t}").count() for t in TABLES}
    manifest = spark.range(1).select(F.lit(home).alias("home"), F.current_timestamp().alias("written"), F.lit(size).cast("long").alias("bytes"), *[F.lit(n).cast("long").alias(t) for t, n in counts.items()])
    manifest.coalesce(1).write.mode("append").parquet(f"{_home(root, corpus)}/manifest")
    return home


def _write_inverted(index: Index, home: str) -> DataFrame:
    """Postings, folded and hashes from lists that are made and written once: what is sampled, shuffled and sorted are lists. Returns
    the counts of the grams."""
    spark = index.docs.sparkSession
    _inverted(index.docs, index.rarity).write.parquet(f"{home}/inverted")
    lists = spark.read.schema(_INVERTED).parquet(f"{home}/inverted")
    for name, key, which in (("postings", "gram", 0), ("folded", "gram", 1), ("hashes", "hash", 0 if index.rarity is None else 2)):
        rows = lists.where(F.col("which") == which).select(key, F.element_at("doc_ids", 1).alias("_first"), "doc_ids")
        rows = rows.repartitionByRange(key, "_first").sortWithinPartitions(key, "_first")
        rows.select(key, F.explode("doc_ids").alias("doc_id")).write.parquet(f"{home}/{name}")
    counted = lists.where("which < 2").groupBy("gram", "which").agg(F.sum(F.size("doc_ids")).cast("long").alias("n"))
    return counted.select("gram", (F.col("which") == 1).alias("folded"), "n")


def load(spark: SparkSession, root: str, corpus: Corpus) -> Index | None:
    """The version finished last; None if there is none; CorruptIndex if its tables aren't what the manifest says."""
    path = f"{_home(root, corpus)}/manifest"
    if not exists(spark, path):
        return None
    try:
        last = spark.read.parquet(path).orderBy(F.desc("written")).first()
        tables = {t: spark.read.parquet(f"{last['home']}/{t}") for t in TABLES}
        wrong = [t for t in TABLES if tables[t].count() != last[t]]
    except Exception as e:
        raise CorruptIndex(f"{path}: {str(e)[:200]}") from e
    if wrong:
        raise CorruptIndex(f"{last['home']}: {', '.join(wrong)} differ from the manifest")
    return Index(*(tables[t] for t in TABLES), doc_count=last["meta"], doc_bytes=last["bytes"])


def load_or_build(root: str, corpus: Corpus) -> Index:
    """Load; where there is nothing whole to load, build, write and load."""
    spark = corpus.docs.sparkSession
    try:
        found = load(spark, root, corpus)
    except CorruptIndex:
        found = None
    if found is None:
        write(build(corpus), root, corpus)
        found = load(spark, root, corpus)
    return found
