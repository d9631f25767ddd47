"""A corpus with known answers, as expressions over a range, and the figures of a benchmark run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import Corpus, from_table

#: Fixed values of the corpus: its words, in order, and its lines per document.
WORDS = "engine planner posting lookup overlay commit workspace search literal sparse trigram candidate regex parser builder reader writer offset binary mmap latency throughput result snippet timeout request response module package service storage queue".split()
LINES = 80
#: The four headline patterns.
PATTERNS = {"literal": "needle_alpha_beta", "alternation": "alpha_service_endpoint|gamma_worker_token", "class_heavy": "user_[0-9]{4}_event_[A-Z]{3}", "hex_fallback": "[a-f0-9]{40}"}


def synthetic(spark: SparkSession, n: int, partitions: int = 8) -> Corpus:
    """n generated documents and a marker document, which counts as one."""
    i = F.col("idx")
    words = F.array(*map(F.lit, WORDS))

    def word(a: int, b: int, line: Column) -> Column:
        return F.element_at(words, (F.pmod(i * a + line * b, F.lit(len(WORDS))) + 1).cast("int"))

    def padded(x: Column, width: int) -> Column:
        return F.lpad(x.cast("string"), width, "0")

    def every(step: int, text: Column) -> Column:
        return F.when(i % step == 0, text).otherwise(F.lit(""))

    lines = F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), lambda l: F.concat(F.lit("const entry_"), padded(l, 3), F.lit(' = "'), word(13, 3, l), F.lit("_"), word(7, 11, l), F.lit("_"), word(17, 5, l), F.lit("_"), (i % 1000).cast("string"), F.lit("_"), l.cast("string"), F.lit('";\n')))
    letter = lambda step: F.char(F.floor(i / step).cast("long") % 26 + 65)
    text = F.concat(
        F.lit("// synthetic benchmark corpus\n// file_index="), i.cast("string"), F.lit("\n\n"), F.array_join(lines, ""),
        every(7, F.lit('const FEATURE_FLAG = "needle_alpha_beta";\n')), every(11, F.lit('const API_NAME = "alpha_service_endpoint";\n')), every(13, F.lit('const API_ALT = "gamma_worker_token";\n')),
        every(17, F.concat(F.lit("// digest: "), F.lower(F.lpad(F.hex(i * 97531), 40, "0")), F.lit("\n"))),
        every(23, F.concat(F.lit('let event = "user_'), padded(i % 10000, 4), F.lit("_event_"), letter(23), letter(13), letter(7), F.lit('";\n'))),
    )
    kind = F.when(i % 3 == 0, "ts").when(i % 3 == 1, "rs").otherwise("md")
    path = F.concat(F.lit("packages/pkg_"), padded(F.floor(i / 30), 4), F.lit("/src/module_"), padded(i % 30, 2), F.lit("."), kind)
    docs = spark.range(0, n, 1, partitions).select(F.col("id").alias("idx")).select(i, path.alias("path"), text.alias("text"))
    marker = spark.range(1).select(F.lit(n).cast("long").alias("idx"), F.lit("zz-marker.json").alias("path"), F.lit(f'{{\n  "dataset": "synthetic",\n  "files": {n},\n  "format": 1\n}}').alias("text"))
    return from_table(docs.unionByName(marker), F.col("idx"), F.col("path"), F.col("text"), f"synthetic-{n}")


def expected(n: int) -> dict[str, tuple[int, int]]:
    """Matches and documents with all required grams of each headline pattern."""
    up = lambda k: -(-n // k)
    return {"literal": (up(7), up(7)), "alternation": (up(11) + up(13), up(11) + up(13) - up(143)), "class_heavy": (up(23), up(23)), "hex_fallback": (up(17), n + 1)}


def percentile(values: Sequence[float], p: float) -> float:
    """Nearest rank."""
    ordered = sorted(values)
    return ordered[int((len(ordered) - 1) * p + 0.5)] if ordered else 0.0


def candidate_reduction(candidates: int, docs: int) -> float:
    return 100.0 * (1 - candidates / docs) if docs else 0.0


def report(rows: Sequence[dict]) -> str:
    """A Markdown table of benchmark rows: name, matches, candidates, docs, indexed and scan seconds."""
    head = "| query | matches | candidates | reduction | indexed p50/p95 s | scan p50/p95 s |\n|---|---:|---:|---:|---:|---:|\n"
    line = lambda r: f"| {r['name']} | {r['matches']} | {r['candidates']} | {candidate_reduction(r['candidates'], r['docs']):.1f}% | " + " | ".join(f"{percentile(r[k], 0.5):.3f}/{percentile(r[k], 0.95):.3f}" for k in ("indexed", "scan")) + " |"
    return head + "\n".join(map(line, rows)) + "\n"
