"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

Repetitive text compresses far better than prose of its length, noise far worse.
What is normal depends on the length, so each length band has its own limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import vec

#: (bytes from, lowest whole ratio, highest whole ratio, lowest chunk ratio, highest chunk ratio).
#: Ratio: bytes / compressed bytes. Below the first band a frame's fixed cost outweighs the text,
#: so only strong repetition counts there.
BANDS = (
    (0, 0.0, 3.0, 0.0, 3.0),
    (256, 1.1, 4.5, 1.0, 4.5),
    (1024, 1.3, 5.0, 1.15, 6.0),
    (4096, 1.5, 6.0, 1.2, 8.0),
    (32768, 1.6, 8.0, 1.2, 12.0),
)
CHUNK_BYTES = 4096
LEVEL = 3
_PIECE_BYTES = 1 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(x) for x in "#*$%&|<>"]] = True
_REPEAT_WIDTH = 8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, chunk_min double, chunk_max double, reason string"
)


def _counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text of a piece."""
    n = len(off) - 1
    lo, hi = int(off[0]), int(off[-1])
    body = raw[lo:hi]
    starts, ends, doc = vec.byte_words(raw, off)
    values = vec.byte_values(raw, off)
    per_doc = lambda which, weights=None: np.bincount(which, weights, minlength=n).astype(np.int64)

    heads = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[body])])
    at = off - lo

    # words in windows that occur twice or more in their text
    w = vec.windows(vec.span_hashes(values, starts, ends), _REPEAT_WIDTH) if len(starts) else np.zeros(0, np.uint64)
    inside = doc[: len(w)] == doc[_REPEAT_WIDTH - 1 :] if len(w) else np.zeros(0, bool)
    first = np.flatnonzero(inside)
    key = vec.mix64(w[first] ^ vec.mix64(doc[first].astype(np.uint64) + np.uint64(1)))
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    hit = first[size[group] > 1] if len(first) else first
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + _REPEAT_WIDTH, -1)
    repeated = np.cumsum(cover[:-1]) > 0

    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(body == 10)
    line_start = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    line_start = line_start[line_start < hi - lo]
    line_doc = np.searchsorted(at, line_start, side="right") - 1
    next_break = np.append(breaks, hi - lo)[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(next_break, at[line_doc + 1])
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    key = vec.mix64(vec.span_hashes(values, line_start, line_end) ^ vec.mix64(line_doc.astype(np.uint64) + np.uint64(1)))
    _, fresh = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[fresh] = False

    return {
        "n_words": per_doc(doc),
        "word_chars": per_doc(doc, heads[ends] - heads[starts]) if len(doc) else np.zeros(n, np.int64),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": per_doc(line_doc[again]),
        "n_repeat_words": per_doc(doc[repeated]),
    }


def _ratios(body: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Ratio of the whole text, and the lowest and highest of its chunks (of the whole, if it has one only).
    The last chunk ends where the text ends and overlaps the one before, so every byte is in a full chunk."""
    if not body:
        return 0.0, 0.0, 0.0
    whole = len(body) / len(pack.compress(body))
    if len(body) <= CHUNK_BYTES:
        return whole, whole, whole
    last = len(body) - CHUNK_BYTES
    chunks = [CHUNK_BYTES / len(pack.compress(body[i : i + CHUNK_BYTES])) for i in (*range(0, last, CHUNK_BYTES), last)]
    return whole, min(chunks), max(chunks)


def compression_verdict(n_bytes: int, whole: float, low: float, high: float, bands=BANDS) -> str | None:
    """Why the band of this length rejects a text; None keeps it."""
    _, least, most, chunk_least, chunk_most = next(b for b in reversed(bands) if n_bytes >= b[0])
    if whole > most:
        return "repetitive"
    if whole < least:
        return "incompressible"
    if high > chunk_most:
        return "repetitive chunk"
    if low < chunk_least:
        return "incompressible chunk"
    return None


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    """One row per document with its base measures, compression ratios and verdict.

    Map only: one task pass, no shuffle. A null text counts as empty (no words, ratio 0,
    base_failed, not kept); a null id stays null; repeated rows each give a row; other
    columns of ``docs`` are not read. ``reason`` is null exactly for kept documents."""
    bands = tuple(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            raw, off = vec.text_buffer(batch.column(1))
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                part = off[a : b + 1]
                m = _counts(raw, part)
                sizes = np.diff(part)
                r = np.array([_ratios(raw[s:e].tobytes(), pack) for s, e in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]).reshape(-1, 3)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                why = [
                    "base" if f else compression_verdict(n, *x, bands)
                    for f, n, x in zip(failed.tolist(), sizes.tolist(), r.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(v, pa.int64()) for v in m.values()), pa.array(failed),
                     pa.array([w is None for w in why], pa.bool_()), pa.array(sizes, pa.int64()), *(pa.array(r[:, i]) for i in range(3)),
                     pa.array(why, pa.string())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    """The documents that the rules keep, columns and values unchanged, in one map-only pass
    (the verdict is computed next to the row, so nothing is joined back)."""
    bands = tuple(bands)
    names = docs.columns
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            raw, off = vec.text_buffer(batch.column(text_at))
            keep: list[bool] = []
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                part = off[a : b + 1]
                m = _counts(raw, part)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                for f, s, e in zip(failed.tolist(), part[:-1].tolist(), part[1:].tolist(), strict=True):
                    keep.append(not f and compression_verdict(e - s, *_ratios(raw[s:e].tobytes(), pack), bands) is None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
