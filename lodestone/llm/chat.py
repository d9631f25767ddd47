r"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles a backslash is put between `<` and `|`,
and one more where backslashes stand between them already, so no text can hold a control string and unescaping
restores every byte. Roles also have backslashes and line ends escaped.

Turns of a batch are assembled together: numpy computes the lengths of all segments, their cumulative offsets and the
place of every byte, and headers and contents are copied into one preallocated buffer that Arrow takes over. This runs
before the shuffle, turn by turn, so a long conversation doesn't hold up one task. After it each conversation's
turns, in order, are adjacent bytes of a batch, and come out as parts of about PART_BYTES with the loss mask as byte
ranges.

Defined results: a null text or role is empty; the null conversation id is a conversation; null turns come first. Turns
that tie stand in the byte order of their formatted form. Repeated rows are turns of their own. An empty table gives an empty one. Columns other than the four
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, map_batches, text_bytes

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes after which a part of a conversation ends with its turn.
PART_BYTES = 1 << 20
#: Bytes that are scattered at once.
STEP = 1 << 20

_TO_ESCAPE, _TO_RESTORE = re.compile(rb"<\\*\|"), re.compile(rb"<\\(\\*\|)")


def _role(role: bytes) -> bytes:
    role = role.replace(b"\\", b"\\\\").replace(b"\n", b"\\n")
    return _TO_ESCAPE.sub(lambda m: b"<\\" + m[0][1:], role)


def _unrole(role: bytes) -> bytes:
    role = unescape(role)
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role) if b"\\" in role else role


def unescape(text: bytes) -> bytes:
    return _TO_RESTORE.sub(rb"<\1", text) if b"<\\" in text else text


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All formatted turns in one buffer, their offsets, and where each turn's text starts and ends."""
    n = len(texts)
    flat, source = flat_bytes(texts)
    # One byte more after the `<` of each match that lies within one text.
    found = [m.span() for m in _TO_ESCAPE.finditer(flat.tobytes())]
    spans = np.array(found, np.int64).reshape(-1, 2)
    row = np.searchsorted(source, spans[:, 0], "right") - 1
    inside = spans[:, 1] <= source[row + 1] if len(spans) else np.zeros(0, bool)
    cuts, row = spans[inside, 0], row[inside]
    lengths = np.diff(source) + np.bincount(row, minlength=n)

    heads, head_at = flat_bytes([START + _role(x) + b"\n" for x in roles])
    head_len = np.diff(head_at)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(head_len + lengths + len(END), out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    out[np.arange(len(heads)) + np.repeat(offsets[:-1] - head_at[:-1], head_len)] = heads
    text_at = offsets[:-1] + head_len
    text_end = text_at + lengths
    out[(text_end[:, None] + np.arange(len(END))).ravel()] = np.tile(np.frombuffer(END, np.uint8), n)
    # Where each byte goes: in steps, so that one long text takes no more memory than its bytes and a step's places.
    escaped = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=escaped[1:])
    shift = text_at - source[:-1] - escaped[:-1]
    for a in range(0, len(flat), STEP):
        b = min(len(flat), a + STEP)
        place = np.arange(a, b) + np.repeat(shift, np.diff(np.clip(source, a, b)))
        low, high = np.searchsorted(cuts, (a, b))
        more = np.zeros(b - a + 1, np.int64)
        more[cuts[low:high] + 1 - a] = 1
        place += np.cumsum(more)[:-1] + low
        out[place] = flat[a:b]
        out[place[cuts[low:high] - a] + 1] = ord("\\")
    return out, offsets, text_at, text_end


def _binary(buffer: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): each turn's formatted bytes; the range is empty but for the assistant's."""
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            roles = text_bytes(batch.column(2))
            out, offsets, start, end = assemble(roles, text_bytes(batch.column(3)))
            loss = np.array([x == b"assistant" for x in roles])
            ranges = [np.where(loss, x - offsets[:-1], 0) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(out, offsets).cast(pa.binary()), *map(pa.array, ranges)], ["conv_id", "turn", "segment", "loss_start", "loss_end"])

    return map_batches(own, run, "conv_id long, turn long, segment binary, loss_start long, loss_end long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        if not len(batch):
            continue
        convs, segments = batch.column(0).to_pylist(), text_bytes(batch.column(2))
        starts, ends = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        flat, offsets = flat_bytes(segments)
        first, size, ids, numbers = [], 0, [], []
        for i, conv in enumerate(convs):
            if conv != last or not i or size >= PART_BYTES:
                part = part + 1 if conv == last else 0
                last, size = conv, 0
                first.append(i)
                ids.append(conv)
                numbers.append(part)
            size += len(segments[i])
        bounds = np.array([*first, len(convs)])
        base = np.repeat(offsets[bounds[:-1]], np.diff(bounds))
        loss = ends > starts
        loss_from, loss_to = (offsets[:-1] + x - base for x in (starts, ends))
        at = np.concatenate(([0], np.cumsum(loss)))[bounds].astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(at), pa.array(x[loss])) for x in (loss_from, loss_to)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(np.diff(bounds)), _binary(flat, offsets[bounds]).cast(pa.binary()), *spans], ["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_starts, loss_ends): each conversation's bytes, in parts in order; the
    ranges are byte offsets into the part. Rows of a conversation are adjacent and in order within a partition."""
    segments = format_turns(turns, conv_col, turn_col, role_col, text_col)
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return map_batches(dealt, _parts, "conv_id long, part long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>")


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The roles and texts of a part."""
    out = []
    for segment in formatted.split(START)[1:]:
        role, _, text = segment.partition(b"\n")
        out.append((_unrole(role), unescape(text[: -len(END)])))
    return out


def _code_points(text: bytes) -> int:
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last, state = object(), None

    def made(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        rows = []
        for conv, formatted, starts, ends in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
            if conv != last or state is None:
                if state is not None:
                    rows.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(formatted):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for a, b in zip(starts, ends, strict=True):
                text = unescape(formatted[a:b])
                state[2] += _code_points(text)
                state[3].update(text)
            state[4] += _code_points(formatted)
        if rows:
            yield made(rows)
    if state is not None:
        yield made([(last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])])


def digests(formatted: DataFrame) -> DataFrame:
    """What the bytes of format_chats() say when read back, one row for each conversation. It goes on from where the
    parts are, in the same tasks, with a running digest instead of a conversation's text."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
