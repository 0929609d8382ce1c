"""Chat formatting by columnar byte assembly, with a reversible template and a loss mask.

A turn is written as ``### role\\n`` text ``</turn>\\n``. Inside roles and texts every backslash, ``#`` and ``<`` gets a
backslash after it, so that neither marker can occur there, not even as part of something longer; in roles a line feed
is a backslash and ``n``. Reading back takes the backslash after each of those bytes away.
Lengths, offsets and scatter targets of all segments of a batch are numpy
arrays; headers, contents and footers are copied into one preallocated buffer. The loss mask is the byte span of
each assistant text within its formatted turn.

Scale: one shuffle by conversation. A conversation is sorted within its partition and streamed batch by batch, its
running digests carried along, so that none has to fit into memory.

Nulls: a null text is empty, a null role the empty role, a null conv_id a conversation of its own. Turns are ordered
by (turn, role, text), nulls first, so ties and repeated rows have a defined order. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.kernel import string_buffers

HEAD, SEP, TAIL = b"### ", b"\n", b"</turn>\n"
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, turn long, role string, formatted binary, mask_from int, mask_to int"

_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[list(b"\\#<")] = True


def _escape(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a backslash after each marked byte, and the new offsets."""
    marked = _ESCAPED[raw]
    shift = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(marked, out=shift[1:])
    out = np.full(len(raw) + int(shift[-1]), 0x5C, dtype=np.uint8)
    out[np.arange(len(raw)) + shift[:-1]] = raw
    return out, at + shift[at]


def _escaped_roles(roles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for roles, made once for each distinct one."""
    coded = roles.fill_null("").dictionary_encode()
    done = [re.sub(r"[\\#<]", lambda m: m.group(0) + "\\", r).replace("\n", "\\n").encode() for r in coded.dictionary.to_pylist()]
    return string_buffers(pa.array(done, pa.binary()).take(coded.indices)) if done else string_buffers(roles)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for each i, in a row."""
    total = np.cumsum(length)
    out = np.arange(int(total[-1]) if len(total) else 0, dtype=np.int64)
    return out + np.repeat(start - (total - length), length)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, offsets, mask from, mask to): a formatted turn per row; the spans are those of the texts within their turns."""
    role, role_at = _escaped_roles(roles)
    text, text_at = _escape(*string_buffers(texts))
    n, role_len, text_len = len(role_at) - 1, np.diff(role_at), np.diff(text_at)
    head, tail = np.frombuffer(HEAD, np.uint8), np.frombuffer(TAIL, np.uint8)
    size = len(head) + role_len + len(SEP) + text_len + len(tail)
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(int(at[-1]), dtype=np.uint8)
    start = at[:-1]
    out[(start[:, None] + np.arange(len(head))).ravel()] = np.tile(head, n)
    out[_ranges(start + len(head), role_len)] = role
    out[start + len(head) + role_len] = SEP[0]
    text_from = len(head) + role_len + len(SEP)
    out[_ranges(start + text_from, text_len)] = text
    out[(start[:, None] + (text_from + text_len)[:, None] + np.arange(len(tail))).ravel()] = np.tile(tail, n)
    return out, at, text_from, text_from + text_len


def format_turns(turns: DataFrame) -> DataFrame:
    """A formatted turn per row, in order within each conversation: conv_id, turn, role, formatted, mask_from, mask_to.

    Concatenating ``formatted`` over a conversation gives its training text; the mask is empty for turns without loss.
    """

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            out, at, lo, hi = assemble(b.column("role"), b.column("text"))
            loss = np.array([r == LOSS_ROLE for r in b.column("role").to_pylist()])
            if at[-1] < 1 << 31:
                body = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
            else:
                body = pa.array([out[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), body, pa.array(np.where(loss, lo, 0), pa.int32()), pa.array(np.where(loss, hi, 0), pa.int32())], ["conv_id", "turn", "role", "formatted", "mask_from", "mask_to"])

    x = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return x.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def unescape(data: bytes) -> bytes:
    """Takes the backslash after each backslash, ``#`` and ``<`` away."""
    if b"\\" not in data:
        return data
    raw = np.frombuffer(data, np.uint8)
    slash = raw == 0x5C
    idx = np.arange(len(raw))
    start = np.maximum.accumulate(np.where(~slash, idx + 1, 0))  # where the run of backslashes at a place began
    start = np.concatenate([[0], start[:-1]])
    owed = (start > 0) & np.isin(raw[np.maximum(start - 1, 0)], (0x23, 0x3C))  # its first one belongs to a # or <
    return raw[~(slash & ((idx - start + ~owed) % 2 == 0))].tobytes()


def _role(data: bytes) -> bytes:
    return re.sub(rb"([\\#<])\\|\\n", lambda m: m.group(1) or b"\n", data)


def parse_turn(data: bytes) -> tuple[bytes, bytes]:
    """(role, text) of a formatted turn, read back from its bytes alone."""
    if not data.startswith(HEAD) or not data.endswith(TAIL):
        raise ValueError("not a formatted turn")
    at = data.index(SEP, len(HEAD))
    return _role(data[len(HEAD) : at]), unescape(data[at + 1 : -len(TAIL)])


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, data: bytes, lo: int, hi: int) -> None:
        role, text = parse_turn(data)
        self.n += 1
        self.turns.update(role + b"\n" + text + b"\n")
        self.chars += len(data.decode())
        if hi > lo:
            masked = unescape(data[lo:hi])
            self.loss.update(masked)
            self.loss_chars += len(masked.decode())

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted bytes and the mask: counts and digests. Expects ``format_turns``'s order."""

    def run(it):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_: _Digest | None = None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in it:
            rows = []
            for conv, data, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_from", "mask_to")), strict=True):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        rows.append(open_.row())
                    open_ = _Digest(conv)
                open_.add(data, lo, hi)
            if rows:
                yield out(rows)
        if open_ is not None:
            yield out([open_.row()])

    return formatted.mapInArrow(run, DIGEST)
