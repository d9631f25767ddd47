"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Three patterns find assignments, access key ids and hex strings. Beside them every long mixed string close to a
sensitive word is a candidate: a zstandard compressor, primed with a dictionary of identifiers and with the
text around the candidate, compresses that text with and without it. The bytes that the candidate adds, for each of its
characters, are its novelty; words, identifiers and repeats of the surroundings add little, random strings add
nearly what they hold. Candidates that reach MIN_NOVELTY and overlap no pattern's span are reported as `novel`.

The dictionary holds the words below and the ones that most documents of the scanned table hold, counted over all of them:
identifiers are put together from such words. It has DICTIONARY_WORDS of them at most.

Offsets count code points; ends are exclusive. Defined results: null and empty texts have no spans, an empty table gives
an empty one. The base spans of a row depend on the row alone, the novel ones also on the table's dictionary; repeated rows each get their
own. The work is linear in a text's length, whatever it repeats. Other columns than the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words in lower case that make what stands near them sensitive.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private", "bearer", "authorization", "access_key", "signature", "akia")
#: Code points on either side of a sensitive word in which candidates lie, and around a candidate that prime the compressor.
NEAR, AROUND = 80, 512
LEVEL = 19
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Added bytes for each character of a candidate. Random ones of this length add 0.9 and more: too few for entropy coding.
MIN_NOVELTY = 0.8
#: Words of code and configuration, and what stands in for a secret in examples.
IDENTIFIERS = (
    "access account add address api app array async auth base batch bool bucket buffer byte cache call channel char class client close code column commit config connect const context copy count create credential "
    "data date debug default delete digest domain enable encode end entry env error event false field file filter find flag for format from function get group handle hash header host http id index info init input instance int "
    "item job json key length limit list load local lock log login max memory message method min mode model module name new node null number object offset open option output page parent parse password path port private public query "
    "queue read record ref remove request reset response result return role root route row save schema search secret section send server service session set size source start state status step store stream string sync system table "
    "target task test text thread time timeout token total true type update url user util valid value version view wait worker write "
    "your-api-key-here changeme placeholder xxxxxxxxxxxxxxxx 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
#: Words of the table's own that the dictionary takes, and their lengths.
DICTIONARY_WORDS = 1000
_OWN_WORD = re.compile(r"[a-z]{3,16}")


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> bytes:
    """The identifiers, and then the words that most documents hold, the commonest last: the nearest to what is compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0):
                seen.update(set(_OWN_WORD.findall((value.as_py() or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counts = map_batches(docs.select(F.col(text_col).alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    own = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]  # `words` rows at most
    return " ".join([*reversed(own), IDENTIFIERS]).encode()


def patterns(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    found = []
    if any(x in lower for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


_JOINT = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])|[_/+=-]+")


def _words(piece: str) -> str:
    """An identifier as words in lower case, as the dictionary has them."""
    return " " + _JOINT.sub(" ", piece).lower() + " "


class Novelty:
    """Added compressed bytes for each character: of the string as it is or of its words, whichever are fewer."""

    def __init__(self, primer: bytes = IDENTIFIERS.encode()) -> None:
        self.primer = primer

    def __call__(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).encode()
        primed = zstandard.ZstdCompressionDict(self.primer + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False)
        without = len(compressor.compress(around))
        piece = text[start:end]
        return min(len(compressor.compress(around + x.encode())) - without for x in (piece, _words(piece))) / (end - start)


def _sensitive(text: str, lower: str) -> list[int]:
    """Where sensitive words start, in order."""
    if len(lower) != len(text):  # places in one aren't places in the other
        return [m.start() for m in re.finditer("(?=" + "|".join(SENSITIVE) + ")", text, re.IGNORECASE | re.ASCII)]
    return sorted(m.start() for word in SENSITIVE if word in lower for m in re.finditer(f"(?={word})" if word == "akia" else word, lower))


def novel(text: str, lower: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates are whole runs; one is near a sensitive word if any part of it is."""
    places = _sensitive(text, lower)
    if not places:
        return []
    taken, out = sorted((s, e) for s, _, e in base), []
    at = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_right(places, a - NEAR - 1)  # the first word that starts NEAR before the candidate or later
        if k == len(places):
            break
        if places[k] >= b + NEAR:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if any(s < b and a < e for s, e in taken[at : at + len(KINDS)]):
            continue
        if _DIGIT.search(text, a, b) and _LETTER.search(text, a, b) and novelty(text, a, b) >= MIN_NOVELTY:
            out.append((a, 3, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primer: bytes | None = None) -> DataFrame:
    """(doc_id, spans): the spans of each row of docs as (kind, start, end), by start and then kind as listed. Without a
    dictionary in `primer`, one is made from docs."""
    primer = dictionary(docs, text_col) if primer is None else primer
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                lower = text.lower()
                base = patterns(text, lower)
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + novel(text, lower, base, novelty))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_batches(own, run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(_joined(patterns(text, text.lower())).encode()).hexdigest()
