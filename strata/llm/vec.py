"""Vectorised text helpers for Arrow batches: splitting and hashing whole batches of texts with numpy.

Everything here works on one bounded batch inside a task; Spark does the
partitioning, shuffling and joining around it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64((np.arange(256, dtype=U64) + U64(1)) * U64(_BASE))


class _Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]), dtype=U64)
            cls.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE_INV, U64)]), dtype=U64)
        return cls.up[:n], cls.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span ``values[start:end]``: equal spans hash equally
    wherever they stand (polynomial prefix sums modulo 2**64, then mixed with the length)."""
    n = len(values)
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=total[1:], dtype=U64)
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(sizes: Sequence[int] | np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive runs of at most ``limit`` units (at least one row each)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def is_gap(byte: int) -> bool:
    return bool(_SPACE[byte])


def byte_words(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts ``raw[off[i]:off[i+1]]``: starts, ends, text number.
    ``gap`` marks the byte values between words."""
    lo, hi = int(off[0]), int(off[-1])
    if hi == lo:
        return (np.zeros(0, np.int64),) * 3
    ink = ~gap[raw[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[off - lo] = True
    before = np.concatenate([[False], ink[:-1]]) & ~edge[:-1]
    after = np.concatenate([ink[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    doc = np.searchsorted(off - lo, starts, side="right") - 1
    return starts, ends, doc


def byte_values(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    return _byte_values()[raw[int(off[0]) : int(off[-1])]]


def lower_byte_values(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``byte_values`` of the texts with A-Z in lower case."""
    table = _byte_values().copy()
    table[65:91] = table[97:123]
    return table[raw[int(off[0]) : int(off[-1])]]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Ordered hash of every ``width`` consecutive entries of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.zeros(n, U64)
    for j in range(width):
        acc = acc * U64(0xA0761D6478BD642F) + h[j : j + n]
    return mix64(acc)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+lens[i]-1`` of all spans, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total)


# ---- pre-token splitting -------------------------------------------------------------------

_X, _L, _N, _S, _O, _U = range(6)
_END = "\U0010ffff"
#: Unicode White_Space (fixed values)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other, or unassigned here."""
    table = np.full(0x110000, _U, np.uint8)
    for lo, hi in ((0, 0x33500), (0xE0000, 0xE0200)):
        for cp in range(lo, hi):
            kind = unicodedata.category(chr(cp))
            table[cp] = _L if kind[0] == "L" else _N if kind[0] == "N" else _U if kind == "Cn" else _O
    table[0xE000:0xF900] = _O
    table[0xF0000:0x10FFFE] = _O
    table[_WHITE] = _S
    table[0x10FFFF] = _X
    return table


def _contractions(cp: np.ndarray, c: np.ndarray, start: np.ndarray) -> None:
    """Move the boundaries around 's 't 're 've 'm 'll 'd (a lone apostrophe before letters)."""
    at = np.flatnonzero((cp == 39) & start)
    at = at[c[at + 1] == _L]
    if not len(at):
        return
    one, two = cp[at + 1], cp[at + 2]
    short = at[np.isin(one, [ord(x) for x in "stmd"])]
    long = at[(np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
    for at, width in ((short, 2), (long, 3)):
        start[at + 1] = False
        start[at[c[at + width] == _L] + width] = True


def _split_byte_level(cp: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token starts for the byte-level pattern; every character belongs to a token."""
    before = np.concatenate([[_X], c[:-1]])
    after = np.concatenate([c[1:], [_X]])
    start = (c != before) | (c == _X)
    last_space = (c == _S) & (after != _S) & (after != _X)
    start |= last_space
    start[1:] &= ~(last_space & (cp == 32))[:-1]
    _contractions(cp, c, start)
    at = np.flatnonzero(start)
    return at, np.append(at[1:], len(cp))


def _split_words(cp: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token starts and ends for the word pattern: white space between tokens is dropped, each number stands alone."""
    before = np.concatenate([[_X], c[:-1]])
    start = (c != before) | (c == _X) | (c == _N)
    _contractions(cp, c, start)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(cp))
    keep = c[at] != _S
    return at[keep], ends[keep]


#: name: (vectorised split, the same split as a regular expression for texts with unassigned characters)
SPLITS = {
    "byte_level": (
        _split_byte_level,
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+",
    ),
    "words": (_split_words, r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"),
}


def pretokens(texts: list[str], split: str) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """Pre-tokens of every text: hash per occurrence (in order), count per text, and a
    function from occurrence numbers to their strings.

    Texts with a character that this Python's Unicode tables don't know take the
    regular-expression path; the result is the same kind of rows."""
    fast, pattern = SPLITS[split]
    joined = _END.join(texts) + _END
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _classes()[cp]
    if bool((c == _U).any()) or int((c == _X).sum()) != len(texts):
        return _pretokens_by_regex(texts, pattern)
    at, ends = fast(cp, c)
    stop = c[at] == _X
    counts = np.diff(np.concatenate([[-1], np.flatnonzero(stop)])) - 1
    at, ends = at[~stop], ends[~stop]
    h = span_hashes((cp.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95), at, ends)
    return h, counts, lambda rows: [joined[s:e] for s, e in zip(at[rows].tolist(), ends[rows].tolist(), strict=True)]


def _pretokens_by_regex(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    find = regex.compile(pattern).findall
    found = [find(t) for t in texts]
    words = [w for f in found for w in f]
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    h = span_hashes((raw.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95), starts, ends)
    return h, np.array([len(f) for f in found], np.int64), lambda rows: [words[i] for i in rows.tolist()]
