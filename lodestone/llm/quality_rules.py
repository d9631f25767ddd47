"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each failed rule.
A policy is a named, versioned set of rules: which documents it keeps, and what would change without one of its
rules, follows from the bits alone and never reads the texts again.

Defined results: a null text counts as empty, and fails the word rules. Rows are independent, so repeated rows and
ties each get their own. Columns of the input other than the id and the text don't matter, whatever their names. An
empty table has an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_bytes, map_batches, sums, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")

#: Name and failing condition of each rule, over the measurements. A rule's place is its bit; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 34 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("capitals", "100 * n_upper > 40 * n_letters"),
    ("exclamations", "10 * n_marks > n_words"),
)
BITS = {name: bit for bit, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rules that reject a document, by name."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[x] for x in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(BITS))

_CLASSES = {
    "symbol": b"#*$%&|<>",
    "space": b" \t\n\r\x0b\x0c",
    "upper": bytes(range(65, 91)),
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)),
    "mark": b"!",
}


def _lookup(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


def _repeat_words(words: list[bytes]) -> int:
    """Words in a window of three that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[x] > 1 for x in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def _dup_lines(lines: list[bytes]) -> tuple[int, int]:
    full = [x for x in lines if x.strip()]
    return len(full), len(full) - len(set(full))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = {k: _lookup(v) for k, v in _CLASSES.items()}
    first = np.ones(256, np.uint8)
    first[0x80:0xC0] = 0  # bytes that go on with a code point
    first[list(_CLASSES["space"])] = 0
    for batch in batches:
        texts = text_bytes(batch.column(1))
        flat, offsets = flat_bytes(texts)
        n_words, repeats, n_lines, dups = [], [], [], []
        for text in texts:
            words = text.split()
            n_words.append(len(words))
            repeats.append(_repeat_words(words))
            lines, again = _dup_lines(text.split(b"\n"))
            n_lines.append(lines)
            dups.append(again)
        found = {
            "n_words": n_words, "word_chars": sums(first[flat], offsets), "n_symbols": sums(tables["symbol"][flat], offsets), "n_dup_lines": dups, "n_repeat_words": repeats,
            "n_lines": n_lines, "n_upper": sums(tables["upper"][flat], offsets), "n_letters": sums(tables["letter"][flat], offsets), "n_marks": sums(tables["mark"][flat], offsets),
        }
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], pa.int64()) for k in MEASURES)], ["doc_id", *MEASURES])


def failure_bits() -> Column:
    out = F.lit(0).cast("long")
    for bit, (_, fails) in enumerate(RULES):
        out = out.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failed): one row for each row of docs; bit k of `failed` is set if it fails RULES[k]."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(own, _measure, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES)).withColumn("failed", failure_bits())


def apply_policy(entries: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    return entries.withColumn(out, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, how many fail it alone, and how many would be kept
    without it. One aggregation over bits."""
    failed = F.col("failed").bitwiseAND(F.lit(policy.mask))
    found = []
    for name in policy.rules:
        bit = 1 << BITS[name]
        found.append(F.struct(F.lit(name).alias("rule"), F.sum(F.when(failed.bitwiseAND(F.lit(bit)) != 0, 1).otherwise(0)).alias("n_failed"), F.sum(F.when(failed == bit, 1).otherwise(0)).alias("n_failed_alone"), F.sum(F.when(failed.bitwiseAND(F.lit(policy.mask & ~bit)) == 0, 1).otherwise(0)).alias("n_kept_without")))
    return entries.agg(F.array(*found).alias("r")).select(F.inline("r"))


def keep_rows(docs: DataFrame, policy: Policy = STRICT, text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns as they were. The ledger's entry rides beside each row,
    so nothing is joined by an id, and the policy reads its bits."""
    schema = docs.schema
    place = schema.fieldNames().index(text_col)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            own = pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), rows.field(place)], ["doc_id", "text"])
            for found in _measure(iter([own])):
                yield pa.RecordBatch.from_arrays([rows, *found.columns[1:]], ["row", *MEASURES])

    kind = T.StructType([T.StructField("row", schema), *(T.StructField(k, T.LongType()) for k in MEASURES)])
    entries = map_batches(held, entered, kind).withColumn("failed", failure_bits())
    return apply_policy(entries, policy).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in schema.fieldNames()])
