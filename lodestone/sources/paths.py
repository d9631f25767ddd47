"""Globs and path filters, compiled on the driver into column predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GlobError

#: Directories that a walk skips, and roots that no build reads.
SKIPPED_DIRS = (".git", ".lodestone", "target", "node_modules")
GUARDED_ROOTS = (".git/", ".lodestone/")


def glob_to_regex(glob: str) -> str:
    """An anchored expression in the common subset of Java's and Python's dialects.

    `*` and `?` cross `/`; `**/` at the start and `/**/` also stand for nothing between; `/**` at the end needs a name
    below; `[a-z]`, `[!a]` and `{a,b}` are classes and choices; a backslash takes the next character as it is.
    """
    out, i, choices = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/"):
            end = i + 2
            if glob.startswith("/", end):  # **/ or /**/: any number of directories
                out.append("(?:.*/)?")
                i = end + 1
                continue
            if end == len(glob):
                out.append(".*" if i == 0 else ".+")
                i = end
                continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            i, piece = _class(glob, i)
            out.append(piece)
            continue
        elif c == "{":
            choices += 1
            out.append("(?:")
        elif c == "}":
            if not choices:
                raise GlobError(f"unopened alternates in {glob!r}")
            choices -= 1
            out.append(")")
        elif c == "," and choices:
            out.append("|")
        elif c == "\\":
            if i + 1 == len(glob):
                raise GlobError(f"dangling escape in {glob!r}")
            i += 1
            out.append(_quoted(glob[i]))
        else:
            out.append(_quoted(c))
        i += 1
    if choices:
        raise GlobError(f"unclosed alternates in {glob!r}")
    return "^(?s:" + "".join(out) + r")\z"


def _quoted(c: str) -> str:
    return "\\" + c if c in r".^$*+?()[]{}|\-&~#" else c


def _class(glob: str, at: int) -> tuple[int, str]:
    i, negated, members = at + 1, False, []
    if i < len(glob) and glob[i] in "!^":
        negated, i = True, i + 1
    first = True
    while i < len(glob) and (glob[i] != "]" or first):
        first = False
        if i + 2 < len(glob) and glob[i + 1] == "-" and glob[i + 2] != "]":
            if glob[i] > glob[i + 2]:
                raise GlobError(f"bad range in {glob!r}")
            members.append(_quoted(glob[i]) + "-" + _quoted(glob[i + 2]))
            i += 3
        else:
            members.append(_quoted(glob[i]))
            i += 1
    if i >= len(glob):
        raise GlobError(f"unclosed class in {glob!r}")
    return i + 1, f"[{'^' if negated else ''}{''.join(members)}]"


def glob_predicate(path: Column, glob: str) -> Column:
    """Whether the whole path matches; plain prefixes, suffixes and names become predicates that scans can use."""
    special = re.compile(r"[*?\[\]{}\\]")
    if not special.search(glob):
        return path == F.lit(glob)
    if glob.startswith("*") and not glob.startswith("**") and not special.search(glob[1:]):
        return path.endswith(glob[1:])
    if glob.endswith("*") and not glob.endswith("**") and not special.search(glob[:-1]):
        return path.startswith(glob[:-1])
    return path.rlike(glob_to_regex(glob))


@dataclass(frozen=True)
class PathFilter:
    """Paths in `include` or `globs` (both empty: all), but none in `exclude`."""

    include: Sequence[str] = ()
    globs: Sequence[str] = ()
    exclude: Sequence[str] = ()

    def __post_init__(self) -> None:
        for glob in (*self.include, *self.globs, *self.exclude):
            glob_to_regex(glob)

    def predicate(self, path: Column) -> Column:
        keep = F.lit(True)
        if wanted := [glob_predicate(path, g) for g in (*self.include, *self.globs)]:
            keep = wanted[0]
            for p in wanted[1:]:
                keep = keep | p
        for g in self.exclude:
            keep = keep & ~glob_predicate(path, g)
        return keep


def not_skipped(path: Column) -> Column:
    """False for anything below a skipped directory, or named like one."""
    names = "|".join(re.escape(d) for d in SKIPPED_DIRS)
    return ~path.rlike(rf"(^|/)({names})(/|$)")


def not_guarded(path: Column) -> Column:
    return ~(path.startswith(GUARDED_ROOTS[0]) | path.startswith(GUARDED_ROOTS[1]))


def relative_path(path: Column, root: str) -> Column:
    """The path below the root with forward slashes; a path outside stays whole."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^file:/+", "/")
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    return F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 20)).otherwise(plain)
