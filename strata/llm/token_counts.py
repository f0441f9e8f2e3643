"""Token counts by a two-tier lookup: a broadcast hash table of frequent pre-token lengths,
then worker caches in front of the tokenizer. The table is learned from all documents without a shuffle
of pre-tokens: each task keeps a summary of bounded size, and summaries are merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import tokens, vec
from strata.sources.tables import write_shared_table

#: Entries of the frequent table. The table only decides which tier answers, never the count;
#: this bounds what is broadcast (under 3 MB).
TABLE_ENTRIES = 1 << 16
#: Longest length that the table's 16 bits hold; longer ones are left to the second tier.
_MAX_LENGTH = (1 << 16) - 1
LIMIT_TOKENS = 1024
_PIECE_CHARS = 2_000_000
_SLOT_BITS = 18
_PROBES = 8
#: Summaries merged at a time.
_FAN = 16

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _encode_lengths(path: str, words: list[str]) -> list[int]:
    t = tokens.load_tokenizer(path)
    return [len(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class Summary:
    """Counts of the most frequent pre-tokens seen: pruned to ``entries`` whenever it holds four times
    as many, so that its memory is bounded. A pre-token frequent enough for the table is frequent in
    most tasks; what pruning loses only moves a pre-token to the second tier."""

    def __init__(self, entries: int) -> None:
        self.entries = entries
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.word: dict[int, str] = {}

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([self.h, h]), return_inverse=True)
        self.h, self.n = keys, np.bincount(at, weights=np.concatenate([self.n, n])).astype(np.int64)

    def prune(self, limit: int) -> None:
        if len(self.h) > limit:
            best = np.sort(np.lexsort((self.h, -self.n))[: self.entries])
            self.h, self.n = self.h[best], self.n[best]
            kept = set(self.h.tolist())
            self.word = {h: w for h, w in self.word.items() if h in kept}


_SUMMARY = "part long, h binary, n binary, length binary"


def _summary_row(part: int, h: np.ndarray, n: np.ndarray, length: np.ndarray) -> dict[str, list]:
    return {"part": [part], "h": [h.tobytes()], "n": [n.astype(np.int64).tobytes()], "length": [length.astype(np.int32).tobytes()]}


def task_summaries(docs: DataFrame, path: str, entries: int) -> DataFrame:
    """One row per task: hashes, counts and token lengths of its most frequent pre-tokens (of texts
    without special strings)."""
    special = tokens.special_strings(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Summary(entries)
        for batch in batches:
            texts = [t for t in _texts(batch.column(1)) if not any(x in t for x in special)]
            for a, b in vec.pieces([len(t) for t in texts], _PIECE_CHARS):
                h, _, strings = vec.pretokens(texts[a:b], "byte_level")
                keys, first, n = np.unique(h, return_index=True, return_counts=True)
                new = np.flatnonzero(~np.isin(keys, seen.h, assume_unique=True))
                seen.word.update(zip(keys[new].tolist(), strings(first[new]), strict=True))
                seen.add(keys, n)
                seen.prune(4 * entries)
        seen.prune(entries)
        if len(seen.h):
            length = np.array(_encode_lengths(path, [seen.word[h] for h in seen.h.tolist()]), np.int64)
            yield pa.RecordBatch.from_pydict(_summary_row(TaskContext.get().partitionId(), seen.h, seen.n, length))

    return docs.mapInArrow(run, _SUMMARY)


def merge_summaries(rows: DataFrame, entries: int) -> DataFrame:
    """Every ``_FAN`` neighbouring summaries merged into one of at most ``entries`` pre-tokens."""

    def run(table: pa.Table) -> pa.Table:
        h, n, length = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("h", np.uint64), ("n", np.int64), ("length", np.int32)))
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64)
        best = np.sort(np.lexsort((keys, -n))[:entries])
        return pa.table(_summary_row(min(table.column("part").to_pylist()) // _FAN, keys[best], n[best], length[first[best]]))

    return rows.groupBy(F.floor(F.col("part") / _FAN).alias("group")).applyInArrow(run, _SUMMARY)


def frequent_table(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressing table (keys: pre-token hashes, lengths) of the most frequent pre-tokens
    of all documents. Summaries of the tasks are merged ``_FAN`` at a time until one is left, so no
    task reads more than ``_FAN`` of them and the driver gets one."""
    rows = write_shared_table(task_summaries(docs, path, entries), "token-summaries")
    last = rows.agg(F.max("part")).first()[0]
    while last:
        rows, last = write_shared_table(merge_summaries(rows, entries), "token-summaries"), last // _FAN
    row = rows.first()
    if row is None:
        return build_table(np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    h, length = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["length"], np.int32)
    fits = (length > 0) & (length <= _MAX_LENGTH)
    return build_table(h[fits], length[fits].astype(np.uint16))


def build_table(h: np.ndarray, n: np.ndarray, bits: int = _SLOT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots by the top bits of the hash, linear probing over at most ``_PROBES`` slots
    (an entry that finds none is left to the second tier). Length 0 marks a free slot."""
    keys, lens = np.zeros((1 << bits) + _PROBES, np.uint64), np.zeros((1 << bits) + _PROBES, np.uint16)
    for key, length in zip(h.tolist(), n.tolist(), strict=True):
        at = key >> (64 - bits)
        free = np.flatnonzero(lens[at : at + _PROBES] == 0)
        if len(free):
            keys[at + free[0]], lens[at + free[0]] = key, length
    return keys, lens


def probe(h: np.ndarray, keys: np.ndarray, lens: np.ndarray, bits: int = _SLOT_BITS) -> np.ndarray:
    """Lengths of the hashes found in the table, 0 for the others."""
    out = np.zeros(len(h), np.int64)
    open_ = np.arange(len(h))
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    for step in range(_PROBES):
        at = slot[open_] + step
        hit = (keys[at] == h[open_]) & (lens[at] > 0)
        out[open_[hit]] = lens[at[hit]]
        open_ = open_[~hit & (lens[at] > 0)]
        if not len(open_):
            break
    return out


class _LengthCache:
    """Second tier: pre-token -> length per worker, emptied at its limit (bounded memory)."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.path, self.limit, self.known = path, limit, {}

    def lengths(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, _encode_lengths(self.path, new), strict=True))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))


_WORKER: dict[str, _LengthCache] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit_tokens: int = LIMIT_TOKENS) -> DataFrame:
    """Tokens of every whole text as the byte-level vocabulary file ``path`` gives them.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each
    give a row. Texts that hold one of the vocabulary's special strings go whole to the
    tokenizer, which treats those strings by its default. Pre-tokens are told apart by 64-bit
    hashes within a batch and against the table (chance of any clash below 1e-7)."""
    special = tokens.special_strings(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(rows, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lens = shared.value
        cache = _WORKER.setdefault(path, _LengthCache(path))
        for batch in batches:
            texts = _texts(batch.column(1))
            n_bytes = np.diff(vec.text_buffer(batch.column(1))[1])
            whole = [any(x in t for x in special) for t in texts]
            plain = ["" if w else t for t, w in zip(texts, whole, strict=True)]
            out = np.zeros(len(texts), np.int64)
            for a, b in vec.pieces([len(t) for t in plain], _PIECE_CHARS):
                h, counts, strings = vec.pretokens(plain[a:b], "byte_level")
                n = probe(h, keys, lens)
                miss = np.flatnonzero(n == 0)
                if len(miss):
                    _, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
                    n[miss] = cache.lengths(strings(miss[first]))[which]
                ends = np.concatenate([[0], np.cumsum(n)])
                stops = np.concatenate([[0], np.cumsum(counts)])
                out[a:b] = ends[stops[1:]] - ends[stops[:-1]]
            for i in np.flatnonzero(whole).tolist():
                out[i] = len(tokens.load_tokenizer(path).encode(texts[i], add_special_tokens=False).ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(out), pa.array(out > limit_tokens)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, SCHEMA)
