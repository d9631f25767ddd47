"""What the corpus operators share: tables, shared intermediate storage, ranks and running totals that never
need one task, and connected components over an edge table."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of a batch that are worked on at once, or one longer row: arrays of eight bytes for each of them stay small.
BATCH_BYTES = 4 << 20
#: Rows that one bucket of a running total holds on average.
BUCKET_ROWS = 4096
#: The words of a text are the runs of bytes outside this class. bytes.split() uses the same one.
SPACES = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or a fresh one where a local session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if own := _local_dirs.get(spark.sparkContext.applicationId):
        return own
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    holder = tempfile.TemporaryDirectory(prefix="lodestone-")
    atexit.register(holder.cleanup)
    _local_dirs[spark.sparkContext.applicationId] = f"file://{holder.name}"
    return _local_dirs[spark.sparkContext.applicationId]


_local_dirs: dict[str, str] = {}


def drop_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str = "part", codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, lost executors cost nothing
    that came before, and later jobs don't compute it again. It stays until the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(drop_path, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lodestone_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Remove a table made by cut() that no later plan reads."""
    drop_path(df.sparkSession, df._lodestone_path)


def pieces(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `size` bytes at most, or of one longer row."""
    size = BATCH_BYTES if size is None else size
    for batch in batches:
        stack = [batch]
        while stack:
            piece = stack.pop()
            if len(piece) > 1 and piece.nbytes > size:
                half = len(piece) // 2
                stack += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches that are bounded by bytes. Spark itself bounds what it sends by
    spark.sql.execution.arrow.maxBytesPerBatch."""
    return df.mapInArrow(lambda batches: fn(pieces(batches)), schema)


class Bitmap:
    """Bits at `probes` places of each of a table's longs, which shows most others not to be among them. The bits are put
    together in Spark, 4 KiB a row; their number follows that of the longs and ends at MOST: 32 MiB, whatever the table's size."""

    LEAST, MOST = 1 << 18, 1 << 28

    def __init__(self, values: DataFrame, column: str, each: int, shifts: Callable[[int], Sequence[int]]) -> None:
        bits = self.LEAST
        wanted = each * values.count()
        while bits < min(wanted, self.MOST):
            bits *= 2
        self.shifts = list(shifts(bits))
        places = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) + 1 for s in self.shifts]))
        rows = values.select(places.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
        table = np.zeros((bits >> 15, 4096), np.uint8)
        for k, part in rows:
            table[k - 1] = np.frombuffer(part, np.uint8)
        self.table = table.ravel()

    def passing(self, values: np.ndarray) -> np.ndarray:
        """Places of the values (unsigned longs) that may be among the table's."""
        spots, mask = np.arange(len(values)), 8 * len(self.table) - 1
        for s in self.shifts:
            bit = (values[spots] >> np.uint64(s)).astype(np.int64) & mask
            spots = spots[self.table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]
        return spots


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def flat_bytes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, and the offsets of their ends and starts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values between each pair of neighbouring offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def with_running(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], hashed: str, value: str | Column, rows: int, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group up to and including this one, in the order of the
    unsigned 31-bit column `hashed` and then `order`.

    One group may hold any share of the rows. Its rows are dealt over as many hash ranges as hold about BUCKET_ROWS
    each; sums of the ranges are added up apart and joined back, so no task sees more than a range.
    `rows`: about how many rows df has.
    """
    n = max(1, -(-rows // BUCKET_ROWS))
    keys = list(groups)
    dealt = df.withColumn("_range", (F.col(hashed).cast("long") * F.lit(n) / F.lit(1 << 31)).cast("long"))
    dealt = dealt.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    totals = dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    # Ranges of one group in turn; one level more keeps this window's partitions at about BUCKET_ROWS ranges too.
    totals = totals.withColumn("_high", (F.col("_range") / F.lit(BUCKET_ROWS)).cast("long"))
    high = totals.groupBy(*keys, "_high").agg(F.sum("_sum").alias("_hsum"))
    high = high.withColumn("_hbefore", F.sum("_hsum").over(Window.partitionBy(*keys).orderBy("_high")) - F.col("_hsum")).drop("_hsum")
    totals = null_safe_join(totals, high, [*keys, "_high"])
    totals = totals.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys, "_high").orderBy("_range")) - F.col("_sum") + F.col("_hbefore"))
    joined = null_safe_join(dealt, totals.select(*keys, "_range", "_before"), [*keys, "_range"])
    own = Window.partitionBy(*keys, "_range").orderBy(hashed, *order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.sum("_value").over(own) + F.col("_before")).drop("_range", "_value", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null keys meet each other; the key columns come from the left."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b) of longs: root is the least node reachable.

    Large-star and small-star rounds alternate until nothing changes. Every round is two aggregations and two joins
    over the edges, whose result is written to shared storage; only its row count and checksum reach the driver.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut(flat, "edges")
    seen = _checksum(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        moved = large.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        following = cut(moved.unionByName(least.withColumnRenamed("_m", "b")).distinct(), "edges")
        drop_cut(current)
        current, before = following, seen
        seen = _checksum(current)
        if seen == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _checksum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def with_prefix(df: DataFrame, order: Sequence[str], value: str | Column, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over all rows up to and including this one in the global order of the columns
    `order`, ascending, nulls first.

    The rows are range-sorted and written with their range's number; the sums of the ranges, one row for each partition,
    are added up and joined back.
    """
    ranged = df.withColumn("_value", F.col(value) if isinstance(value, str) else value).repartitionByRange(*order)
    ranged = cut(ranged.withColumn("_pid", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_pid").agg(F.sum("_value").alias("_sum"))
    totals = totals.withColumn("_before", F.sum("_sum").over(Window.orderBy("_pid")) - F.col("_sum")).drop("_sum")
    own = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each partition of the range sort: its number bounds the broadcast.
    return ranged.join(F.broadcast(totals), "_pid").withColumn(out, F.sum("_value").over(own) + F.col("_before")).drop("_pid", "_value", "_before")


def held_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """(_id, _hash, row): each row as one column, so that no name of its own can clash, and what names it."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return held.select(F.col(f"row.`{id_col}`").cast("long").alias("_id"), F.xxhash64("row").alias("_hash"), "row")


def one_each(held: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of held_rows() that `chosen` (_id, _hash, _n, more) names, with its other columns: one for each name.
    _n says how many rows share the name."""
    found = null_safe_join(held, chosen, ["_id", "_hash"])
    return found.where("_n = 1").unionByName(found.where("_n > 1").dropDuplicates(["_id", "_hash"])).drop("_n")


def unheld(held: DataFrame, schema: T.StructType) -> DataFrame:
    return held.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields])
