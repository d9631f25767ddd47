"""Matches with byte offsets, lines, columns and snippets, one row for each."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as bt
from .dialect import Compiled

FIELDS = ("byte_offset", "end_offset", "line", "column", "snippet")
MATCHES = "is_overlay boolean, doc_id long, path string, byte_offset long, end_offset long, line long, column long, snippet string"
#: Makes the function that finds the matches in a text; called once in each task.
Finder = Callable[[], Callable[[bytes], Iterator[tuple[int, int]]]]


def match_spans(engine, content: bytes, cap: int | None = None):
    """Non-overlapping matches from the left; an empty match that touches the one before it is none."""
    found, last = 0, None
    for m in engine.finditer(content):
        start, end = m.span()
        if start == end and end == last:
            continue
        yield start, end
        last, found = end, found + 1
        if cap is not None and found >= cap:
            return


def literal_spans(literal: bytes, content: bytes, cap: int | None = None):
    at, found = content.find(literal), 0
    while at >= 0:
        yield at, at + len(literal)
        found += 1
        if cap is not None and found >= cap:
            return
        at = content.find(literal, at + len(literal))


def line_starts(content: bytes) -> list[int]:
    out, at = [0], content.find(b"\n")
    while at >= 0 and at + 1 < len(content):
        out.append(at + 1)
        at = content.find(b"\n", at + 1)
    return out


def places(spans, content: bytes, snippets: bool) -> Iterator[tuple[int, int, int, int, str]]:
    """(byte_offset, end_offset, line, column, snippet) of each span."""
    starts, shown, text = None, -1, ""
    for start, end in spans:
        if starts is None:
            starts = line_starts(content)
        line = bisect_right(starts, start)
        first = starts[line - 1]
        if snippets and line != shown:  # the last line runs to the end of the text, with a line end there
            stop = starts[line] - 1 if line < len(starts) else len(content)
            shown, text = line, content[first:stop].decode("utf-8", "replace")
        yield start, end, line, start - first + 1, text


def located(spans, content: bytes, snippets: bool) -> list[dict]:
    return [dict(zip(FIELDS, row)) for row in places(spans, content, snippets)]


def regex_finder(pattern: Compiled, cap: int | None = None) -> Finder:
    """At most `cap` matches of each document, which a limit over ordered results never needs more of."""

    def made():
        engine = pattern.build()
        return lambda content: match_spans(engine, content, cap)

    return made


def literal_finder(literal: bytes, cap: int | None = None) -> Finder:
    return lambda: lambda content: literal_spans(literal, content, cap)


def match_rows(texts: DataFrame, finder: Finder, snippets: bool = True) -> DataFrame:
    """The matches in texts (is_overlay, doc_id, path, content). Python holds a piece of the texts and as many bytes of rows: a line
    with many matches is in all their snippets, so the rows of one text may be far longer than it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = finder()
        for piece in bt.pieces(batches):
            at, rows, held = [], [], 0
            for i, content in enumerate(piece.column(3)):
                if (content := content.as_py()) is None:
                    continue
                for row in places(found_in(content), content, snippets):
                    at.append(i)
                    rows.append(row)
                    held += 256 + len(row[4])
                    if held >= bt.BATCH_BYTES:
                        yield _rows(piece, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield _rows(piece, at, rows)

    return texts.select("is_overlay", "doc_id", "path", "content").mapInArrow(run, MATCHES)


def _rows(piece: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    of = pa.array(at, pa.int32())
    *numbers, snippets = zip(*rows)
    columns = [piece.column(i).take(of) for i in range(3)] + [pa.array(n, pa.int64()) for n in numbers] + [pa.array(snippets, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["is_overlay", "doc_id", "path", *FIELDS])


def match_count(content: Column, pattern: Compiled) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        engine = pattern.build()
        return texts.map(lambda b: 0 if b is None else sum(1 for _ in match_spans(engine, bytes(b))))

    return run(content)
