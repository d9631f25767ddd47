"""Changes since the index was built: a table (path, op, content, generation, sequence), the last one of a path counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import children, remove, scratch

SCHEMA = "path string, op string, content binary, generation long, sequence long"
#: Tables that a snapshot reads at most; more are merged into one.
TABLES = 16
_NAME = re.compile(r"(change|merged)-(\d{12})-(-?\d+)")


class Overlay:
    """Append-only changes. One call of append() makes one generation; within it `sequence` tells which change of a path is the last, and
    without it a deletion goes before what writes the path, and texts follow their bytes' order.

    Each generation is a table of its own, written to `store`, so a snapshot is one scan of a few tables, and an overlay over the same store goes on where
    another one ended. Without a store the tables are lazy, and lost with the session, until they are too many and go to a folder of the session.
    A merged table stands for all generations up to its own.
    """

    def __init__(self, spark: SparkSession, store: str | None = None) -> None:
        self.spark, self.store = spark, store
        self.generation, self.batch = 0, -1
        self._changes: list[tuple[int, DataFrame]] = []
        if store is not None:
            self._load()

    def _load(self) -> None:
        found = [(m[1], int(m[2]), int(m[3]), name) for name in children(self.spark, self.store) if (m := _NAME.fullmatch(name))]
        merged = max((x for x in found if x[0] == "merged"), key=lambda x: x[1], default=None)
        kept = ([merged] if merged else []) + sorted((x for x in found if x[0] == "change" and (merged is None or x[1] > merged[1])), key=lambda x: x[1])
        self._changes = [(g, self._read(name)) for _, g, _, name in kept]
        self.generation = max((g for _, g, _, _ in kept), default=0)
        self.batch = max((b for _, _, b, _ in kept), default=-1)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.store}/{name}")

    def _written(self, rows: DataFrame, kind: str, generation: int) -> DataFrame:
        name = f"{kind}-{generation:012d}-{self.batch}"
        rows.write.mode("overwrite").parquet(f"{self.store}/{name}")
        return self._read(name)

    @property
    def empty(self) -> bool:
        return not self._changes

    def append(self, changes: DataFrame, batch: int | None = None) -> None:
        """changes: (path, op, content), perhaps with sequence; op `modified` or `deleted`. batch: the number of a stream's batch; one that
        was taken in before changes nothing."""
        if batch is not None and batch <= self.batch:
            return
        generation = self.generation + 1
        sequence = F.col("sequence") if "sequence" in changes.columns else F.lit(0)
        rows = changes.select("path", "op", F.col("content").cast("binary").alias("content"), F.lit(generation).cast("long").alias("generation"), sequence.cast("long").alias("sequence"))
        if batch is not None:
            self.batch = batch
        self._changes = [*self._changes, (generation, rows if self.store is None else self._written(rows, "change", generation))]
        self.generation = generation
        if len(self._changes) > TABLES:
            self._merge(self._all(), generation)

    def _merge(self, rows: DataFrame, generation: int) -> None:
        """Put rows in the place of all generations up to this one."""
        if self.store is None:
            self.store = scratch(self.spark)
        later = [(g, c) for g, c in self._changes if g > generation]
        self._changes = [(generation, self._written(rows, "merged", generation)), *later]

    def _all(self, generation: int | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], SCHEMA)
        for g, c in self._changes:
            out = out.unionByName(c)
        return out if generation is None else out.where(F.col("generation") <= generation)

    def replace(self, rows: DataFrame, generation: int) -> None:
        """Of all generations up to this one only these rows (as _all() has them) go on."""
        if rows.limit(1).count():
            self._merge(rows, generation)
            return
        self._changes = [(g, c) for g, c in self._changes if g > generation]
        if self.store is not None:
            self._written(self.spark.createDataFrame([], SCHEMA), "merged", generation)

    def tidy(self) -> None:
        """Remove the stored tables that a merged one stands for. Searches that began before it may still read them."""
        found = [(m[1], int(m[2]), name) for name in (children(self.spark, self.store) if self.store else ()) if (m := _NAME.fullmatch(name))]
        last = max((g for kind, g, _ in found if kind == "merged"), default=-1)
        for kind, g, name in found:
            if g < last or (g == last and kind == "change"):
                remove(self.spark, f"{self.store}/{name}")

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], SCHEMA), self.generation)

    def latest(self, generation: int | None = None) -> DataFrame:
        """The last change of each path up to a generation, whole."""
        last = F.max_by(F.struct("op", "content", "generation", "sequence"), F.struct("generation", "sequence", (F.col("op") == "modified").alias("m"), "content"))
        return self._all(generation).groupBy("path").agg(last.alias("c")).select("path", "c.*")

    def snapshot(self, generation: int | None = None) -> DataFrame:
        """(path, op, content): the last change of each path up to a generation. Generations that a rebuild took out are gone."""
        return self.latest(generation).select("path", "op", "content")


def not_held(changes: DataFrame, docs: DataFrame, live: bool = False) -> DataFrame:
    """The changes (path, op, content, more) that a corpus (path, content) doesn't hold: other texts, and deleted paths that are
    there. A live corpus was read after the changes, so what it has of a path is right."""
    own = docs.select(F.col("path").alias("_path"), F.xxhash64("content").alias("_text"))
    found = changes.join(own, changes["path"] == own["_path"], "left")
    there = F.col("_path").isNotNull()
    held = F.when(F.col("op") == "deleted", F.lit(True) if live else ~there).otherwise(there & (F.lit(True) if live else F.col("_text") == F.xxhash64("content")))
    return found.where(~held).select(*changes.columns)


def classified(changes: DataFrame) -> DataFrame:
    """(path, op, content, outcome, more) of raw changes (path, content, is_file): a missing file is a deletion, what is no file
    or no UTF-8 is skipped."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    outcome = F.when(~F.coalesce(F.col("is_file"), F.lit(True)), "skipped").when(F.col("content").isNull(), "deleted").when(valid, "updated").otherwise("skipped")
    return changes.withColumn("outcome", outcome).withColumn("op", F.when(F.col("outcome") == "deleted", "deleted").otherwise("modified"))


def outcome_counts(changes: DataFrame) -> DataFrame:
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return changes.agg(n("updated"), n("deleted"), n("skipped"))
