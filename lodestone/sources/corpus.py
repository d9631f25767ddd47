"""The documents that are searched: (doc_id, path, content, size, mtime_secs, indexed)."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import not_guarded, not_skipped, relative_path
from .store import scratch

#: Larger documents are searched but not indexed.
MAX_FILE_BYTES = 2 << 20


@dataclass(frozen=True)
class Corpus:
    """A snapshot of documents. doc_id orders them like their paths' bytes, unless the source has ids of its own."""

    docs: DataFrame
    name: str
    version: str = "NO_VERSION"
    #: Whether contents are read where they change, each time anew.
    live: bool = False

    @property
    def meta(self) -> DataFrame:
        return self.docs.drop("content")


def _classified(docs: DataFrame, max_file_bytes: int) -> DataFrame:
    """Texts that are no valid UTF-8 go; oversize ones stay, unindexed."""
    size = F.octet_length("content").cast("long")
    fits = size <= F.lit(max_file_bytes)
    return docs.where(F.coalesce(~fits | F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))).withColumn("size", size).withColumn("indexed", fits).select("doc_id", "path", "content", "size", "mtime_secs", "indexed")


def from_table(df: DataFrame, doc_id: Column, path: Column, text: Column, name: str, version: str = "NO_VERSION", max_file_bytes: int = MAX_FILE_BYTES) -> Corpus:
    """Documents of a table with a stable id. Null texts are no documents."""
    docs = df.select(doc_id.cast("long").alias("doc_id"), path.cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"), F.lit(0).cast("long").alias("mtime_secs"))
    return Corpus(_classified(docs.where("content IS NOT NULL"), max_file_bytes), name, version)


def numbered(docs: DataFrame) -> DataFrame:
    """Replace doc_id by the rank of the path in byte order, from 0: a range sort, and one number per partition to add. The
    sorted paths are written, so a lost executor can't sort them into other ranges."""
    from pyspark.sql.window import Window

    home = scratch(docs.sparkSession)
    docs.select("path").repartitionByRange("path").withColumn("_pid", F.spark_partition_id()).write.parquet(home)
    ranged = docs.sparkSession.read.schema("path string, _pid int").parquet(home)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    ids = ranged.join(F.broadcast(counts), "_pid").select("path", (F.row_number().over(Window.partitionBy("_pid").orderBy("path")) - 1 + F.col("_before")).cast("long").alias("doc_id"))
    return docs.drop("doc_id").join(ids, "path")


def from_files(spark: SparkSession, root: str, commit: str | None = None, max_file_bytes: int = MAX_FILE_BYTES) -> Corpus:
    """All files below root; with a commit, those that it lists. Contents are those of the working tree when a search
    reads them; a file that is gone by then is skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    docs = raw.select(F.lit(0).cast("long").alias("doc_id"), relative_path(F.col("path"), root).alias("path"), "content", F.unix_seconds("modificationTime").alias("mtime_secs"))
    listed = git_files(root, commit) if commit else []
    docs = docs.join(spark.createDataFrame([(p,) for p in listed], "path string"), "path", "left_semi") if listed else docs.where(not_skipped(F.col("path")))
    docs = numbered(_classified(docs.where(not_guarded(F.col("path"))), max_file_bytes))
    return Corpus(docs.select("doc_id", "path", "content", "size", "mtime_secs", "indexed"), root, commit or "NO_VERSION", True)


def git_files(root: str, commit: str) -> list[str]:
    """The names in a commit's tree; none if git can't tell."""
    try:
        done = subprocess.run(["git", "-C", root.removeprefix("file://"), "ls-tree", "-r", "-z", "--name-only", commit], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return []
    return [x.decode("utf-8", "replace") for x in done.stdout.split(b"\0") if x]


def git_head(root: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root.removeprefix("file://"), "rev-parse", "HEAD"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return "NO_VERSION"
    return done.stdout.decode().strip()
