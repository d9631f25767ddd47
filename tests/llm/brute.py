"""Plain versions of the operators, as slow as they are simple."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

SPACES = " \t\n\r\x0b\x0c"


def words(text: str | None) -> list[str]:
    return [w for w in re.split(f"[{SPACES}]+", text or "") if w]


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def fingerprint(text: str | None, n: int) -> int:
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def classes(fps: list[int], reach: int) -> list[int]:
    """For each fingerprint the index of the first one in its component."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= reach) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def repeats(texts: list[bytes], length: int = 200) -> list[tuple[int, int, int, str]]:
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def secrets(text: str | None) -> list[tuple[int, str, int]]:
    text = text or ""
    rank = {"assign": 0, "access": 1, "hex": 2}
    found = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], rank[x[1]]))
