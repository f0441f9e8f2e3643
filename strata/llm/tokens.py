"""Public tokenizers inside tasks: loaders, whole-text fallbacks and a bounded pre-token cache."""

from __future__ import annotations

import base64
import functools
import itertools
import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import vec


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows of a (doc_id, ...) table, taken by a hash of the id (all, if it has fewer):
    a filter in the scan, so no task gathers the sample."""
    share = int(min(1.0, n / max(rows.count(), 1)) * (1 << 30))
    return rows.where(F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)), F.lit(0)) < share)


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizers-library tokenizer without threads of its own (Spark runs one task per core)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", []))


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (fixed size: one entry per vocabulary id)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def normalise_words(text: str) -> str:
    """NFC and lower case per character, as the word vocabulary's normaliser does (white space is dropped by the split)."""
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


#: Pre-tokens that the library gets as one text.
_JOINED = 256


def id_arrays(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and the number of ids of each row."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(counts.sum())), counts


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every pre-token as the library gives them for it alone, and the number of ids of each.

    A text of one pre-token costs the library more than twice its merges, so it gets runs of
    pre-tokens joined by a space (which its word split drops) and tells the pre-token of each id. A
    run in which it sees more or fewer pre-tokens than the given ones is encoded one by one."""
    tokenizer = load_tokenizer(path)
    flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), _JOINED):
        run = words[at : at + _JOINED]
        found = tokenizer.encode(" ".join(run), add_special_tokens=False)
        ids, n = np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64))
        if len(n) != len(run) or not n.all():
            ids, n = id_arrays([e.ids for e in tokenizer.encode_batch_fast(run, add_special_tokens=False)])
        flat.append(ids)
        counts.append(n)
    return np.concatenate(flat), np.concatenate(counts)


class IdTable:
    """Ragged table of token ids: entry k holds the ids of one pre-token."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.flat = np.zeros(1 << 12, np.uint32)
        self.start = np.zeros(1 << 10, np.int64)
        self.count = np.zeros(1 << 10, np.int64)
        self.uses = np.zeros(1 << 10, np.int64)
        self.n = self.used = 0

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        while self.n + len(counts) > len(self.count):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.count[self.n : self.n + len(counts)] = counts
        self.start[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(counts), self.used + len(flat)

    def take(self, entries: np.ndarray) -> np.ndarray:
        return self.flat[vec.ragged(self.start[entries], self.count[entries])]


class PretokenCache:
    """Worker-side cache pre-token -> ids, thinned out when it would hold more than ``limit`` entries,
    so that its memory stays bounded whatever the corpus; that costs re-encoding, never results.
    ``encode`` gives the ids of all words one after the other and the number of ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000) -> None:
        self.encode, self.limit = encode, limit
        self.entry: dict[str, int] = {}
        self.table = IdTable()

    def clear(self) -> None:
        self.entry.clear()
        self.table.clear()

    def thin_out(self, more: int) -> None:
        """Make room for ``more`` entries: those that were asked for twice stay, half the limit at most
        (the most used ones), and none if that leaves too little room. Earlier uses count half from now on."""
        table = self.table
        kept = np.flatnonzero(table.uses[: table.n] > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-table.uses[kept], kind="stable")[: self.limit // 2]])
        if len(kept) + more > self.limit:
            return self.clear()
        number = np.full(table.n, -1, np.int64)
        number[kept] = np.arange(len(kept))
        now = number[np.fromiter(self.entry.values(), np.int64, len(self.entry))].tolist()
        self.entry = {w: k for w, k in zip(self.entry, now, strict=True) if k >= 0}
        flat, counts, uses = table.take(kept), table.count[kept], table.uses[kept] // 2
        table.clear()
        table.extend(flat, counts)
        table.uses[: table.n] = uses

    def entries(self, words: list[str]) -> np.ndarray:
        """Entry numbers of distinct ``words``; unknown ones are encoded first."""
        if self.table.n + len(words) > self.limit:
            self.thin_out(len(words))
        entry = np.fromiter(map(self.entry.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            entry[missing] = np.arange(self.table.n, self.table.n + len(new))
            self.entry.update(zip(new, entry[missing].tolist(), strict=True))
            self.table.extend(*self.encode(new))
        self.table.uses[entry] += 1
        return entry

    def ids(self, texts: list[str], split: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        h, counts, strings = vec.pretokens(texts, split)
        distinct, occurrence = np.unique(h, return_inverse=True)
        one = np.empty(len(distinct), np.int64)
        one[occurrence] = np.arange(len(h))  # an occurrence of each
        entry = self.entries(strings(one))[occurrence]
        lens = self.table.count[entry]
        ends = np.cumsum(lens)
        per_text = np.diff(np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]))
        return self.table.take(entry), per_text
