"""Candidate documents from postings (gram, doc_id): intersections and unions as one join and one aggregation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import holding, unpack_trigram
from .planner import QueryPlan

#: Share of the documents with a plan's rarest gram above which a scan is cheaper.
SELECTIVE = 0.1
#: Strings of a plan's grams up to which the JVM looks for them in a text; more go to Python.
NATIVE_GRAMS = 64


def _in(column: str, values: Iterable[int]) -> Column:
    return F.col(column).isin(sorted(int(v) for v in values))


def all_of(postings: DataFrame, grams: Iterable[int], column: str = "gram") -> DataFrame:
    """(doc_id) with every gram. Postings name a document once for each gram, so counting is enough."""
    wanted = set(grams)
    return postings.where(_in(column, wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select("doc_id")


def any_of(postings: DataFrame, grams: Iterable[int], column: str = "gram") -> DataFrame:
    return postings.where(_in(column, set(grams))).select("doc_id").distinct()


def by_plan(postings: DataFrame, plan: QueryPlan) -> DataFrame:
    """(doc_id) that the plan admits: all its branches in one pass. The branch table is as small as the pattern."""
    if plan.kind == "and":
        return all_of(postings, plan.grams[0])
    spark = postings.sparkSession
    rows = [(b, int(g), len(grams)) for b, grams in enumerate(plan.grams) for g in grams]
    branches = spark.createDataFrame(rows, "branch int, gram long, _size long")
    hit = postings.where(_in("gram", {r[1] for r in rows})).join(F.broadcast(branches), "gram")
    return hit.groupBy("branch", "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size")).where("_n = _size").select("doc_id").distinct()


def admitted(grams: Column, plan: QueryPlan) -> Column:
    """The same test on a column with a document's grams."""
    if plan.kind == "all":
        return F.lit(True)
    out = F.lit(False)
    for wanted in plan.grams:
        out = out | (F.size(F.array_except(F.array(*[F.lit(int(g)).cast("long") for g in sorted(wanted)]), grams)) == 0)
    return out


def held(content: Column, plan: QueryPlan) -> Column:
    """The same test on the text itself. A few grams are looked for in the JVM, byte by byte and letter by letter of either case."""
    if plan.kind == "all":
        return F.lit(True)
    spelled = [[_spellings(int(g), plan.folded) for g in sorted(wanted)] for wanted in plan.grams]
    if sum(len(s) for branch in spelled for s in branch) > NATIVE_GRAMS:
        return holding(content, [{int(g) for g in wanted} for wanted in plan.grams], plan.folded)
    out = F.lit(False)
    for branch in spelled:
        has = F.lit(True)
        for spellings in branch:
            has = has & reduce(or_, [F.contains(content, F.lit(bytearray(s))) for s in spellings])
        out = out | has
    return out


def _spellings(gram: int, folded: bool) -> list[bytes]:
    each = [(b, b - 32) if folded and 97 <= b <= 122 else (b,) for b in unpack_trigram(gram)]
    return [bytes(s) for s in product(*each)]


def hashes_admitted(hashes: Column, wanted: list[int], logic: str) -> Column:
    """All (of none: true) or any (of none: false) of the wanted hashes."""
    if not wanted:
        return F.lit(logic == "and")
    own = F.array(*[F.lit(int(h)).cast("long") for h in wanted])
    return F.size(F.array_except(own, hashes)) == 0 if logic == "and" else F.arrays_overlap(own, hashes)


def wanted_grams(plan: QueryPlan) -> set[int]:
    return {int(g) for grams in plan.grams for g in grams}


def rarest(counts: DataFrame, plan: QueryPlan) -> int:
    """An upper bound of the documents that the plan admits, from (gram, n): the rarest gram's number of each branch, added up."""
    wanted = wanted_grams(plan)
    found = {r["gram"]: r["n"] for r in counts.where(_in("gram", wanted)).collect()}  # one row for each gram of the pattern
    return sum(min(found.get(g, 0) for g in grams) for grams in plan.grams)


def required_bytes(content: Column, plan: QueryPlan) -> Column:
    """A pre-filter on the text itself, run in the JVM before any Python: the strings that each branch requires."""
    if plan.kind == "all" or plan.folded or not plan.strings:
        return F.lit(True)
    out = F.lit(False)
    for strings in plan.strings:
        keep = F.lit(True)
        for s in strings:
            if s:
                keep = keep & F.contains(content, F.lit(bytearray(s)))
        out = out | keep
    return out
