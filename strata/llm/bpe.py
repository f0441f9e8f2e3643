"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

1. split: documents are gathered into batches of bounded size; each batch keeps its distinct
   pre-tokens once, and each document the positions of its pre-tokens as numbers into them.
2. encode: the distinct pre-tokens of all batches are shuffled by pre-token hash (the shard), so
   that each distinct pre-token of the corpus is merged into token ids once, in one task.
3. join back: the ids return to their batch and every document is reassembled by position.

Only distinct pre-tokens of a batch travel in steps 2 and 3, never one row per occurrence, so
a pre-token that makes up a third of the corpus costs one entry per batch.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import tokens, vec

BATCH_CHARS = 8_000_000
_PIECE_BYTES = 1 << 20
_ROWS_OUT_BYTES = 8 << 20
_WORDS, _SHARDS, _DOCUMENT = 0, 1, 2
_STORE = "kind int, batch long, shard int, doc_id long, payload binary"


def shard_count(shuffle_partitions: int) -> int:
    """Shards of the distinct-word shuffle: two per shuffle partition, within fixed bounds."""
    return min(max(2 * shuffle_partitions, 16), 4096)


def pack_lists(counts: np.ndarray, body: bytes, pack: zstandard.ZstdCompressor) -> bytes:
    return pack.compress(struct.pack("<I", len(counts)) + counts.astype("<u4").tobytes() + body)


def unpack_lists(payload: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, bytes]:
    raw = unpack.decompress(payload)
    n = struct.unpack_from("<I", raw)[0]
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n :]


def pack_numbers(numbers: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Numbers as byte planes (low bytes first), which compress better than whole words."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]
    return pack.compress(bytes([width]) + planes.tobytes())


def unpack_numbers(payload: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = unpack.decompress(payload)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


class _Batch:
    """Distinct pre-tokens of one batch of documents, numbered by first occurrence."""

    def __init__(self, number: int, n_shards: int) -> None:
        self.number, self.n_shards, self.chars = number, n_shards, 0
        self.known: dict[str, int] = {}
        self.shards: list[np.ndarray] = []

    def add(self, texts: list[str]) -> list[np.ndarray]:
        """Positions of each text's pre-tokens, as numbers of the batch's distinct pre-tokens."""
        h, counts, strings = vec.pretokens(texts, "byte_level")
        self.chars += sum(map(len, texts))
        unique, first, occurrence = np.unique(h, return_index=True, return_inverse=True)
        order = np.argsort(first)
        words, before = strings(first[order]), len(self.known)
        entry = np.fromiter((self.known.setdefault(w, len(self.known)) for w in words), np.int64, len(words))
        self.shards.append((unique[order][entry >= before] % np.uint64(self.n_shards)).astype(np.int64))
        number = np.empty(len(order), np.int64)
        number[order] = entry
        return np.split(number[occurrence], np.cumsum(counts)[:-1])

    def rows(self, pack: zstandard.ZstdCompressor) -> Iterator[tuple]:
        """One row of words per shard, and one that tells each word's shard."""
        shard = np.concatenate(self.shards) if self.shards else np.zeros(0, np.int64)
        words = [w.encode("utf-8", "surrogatepass") for w in self.known]
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            own = [words[i] for i in part.tolist()]
            lens = np.fromiter(map(len, own), np.int64, len(own))
            yield _WORDS, self.number, int(shard[part[0]]), None, pack_lists(lens, b"".join(own), pack)
        yield _SHARDS, self.number, -1, None, pack_numbers(shard, pack)


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in _STORE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def split_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """Step 1 for (doc_id, text) rows: the rows of ``_STORE``; map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        base = TaskContext.get().partitionId() << 24
        batch, is_open, out, held = _Batch(base, n_shards), False, [], 0
        for record in batches:
            for a, b in vec.pieces(np.diff(vec.text_buffer(record.column(1))[1]), _PIECE_BYTES):
                ids, texts = record.column(0).slice(a, b - a).to_pylist(), [x or "" for x in record.column(1).slice(a, b - a).to_pylist()]
                for doc_id, positions in zip(ids, batch.add(texts), strict=True):
                    out.append((_DOCUMENT, batch.number, -1, doc_id, pack_numbers(positions, pack)))
                    held += len(out[-1][4])
                is_open = True
                if batch.chars >= BATCH_CHARS:
                    out += batch.rows(pack)
                    batch, is_open = _Batch(batch.number + 1, n_shards), False
                if held > _ROWS_OUT_BYTES:
                    yield _flush(out)
                    out, held = [], 0
        if is_open:
            out += batch.rows(pack)
        if out:
            yield _flush(out)

    return docs.mapInArrow(run, _STORE)


def encode_words(store: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Step 2: word rows, shuffled by shard, become id rows of the same batch and shard."""

    def words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a filter in the plan would be pushed below the shuffle that both steps share
        for record in batches:
            yield record.filter(pc.equal(record.column(0), _WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        encoding = tokens.load_encoding(ranks_path, pattern)
        cache = tokens.PretokenCache(lambda words: tokens.id_arrays([encoding.encode_ordinary(w) for w in words]), limit=1_000_000)
        current = None
        for record in batches:
            rows, held = [], 0
            for batch, shard, payload in zip(*(record.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                if shard != current:  # rows come sorted by shard: memory holds one shard's distinct words
                    cache.clear()
                    current = shard
                lens, body = unpack_lists(payload, unpack)
                ends = np.cumsum(lens).tolist()
                words = [body[e - n : e].decode("utf-8", "surrogatepass") for e, n in zip(ends, lens.tolist(), strict=True)]
                entry = cache.entries(words)
                rows.append((_WORDS, batch, shard, None, pack_lists(cache.table.count[entry], cache.table.take(entry).astype("<u4").tobytes(), pack)))
                held += len(rows[-1][4])
                if held > _ROWS_OUT_BYTES:
                    yield _flush(rows)
                    rows, held = [], 0
            if rows:
                yield _flush(rows)

    return store.mapInArrow(words_only, _STORE).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _STORE)


def as_ids(ids: list[np.ndarray]) -> dict[str, pa.Array]:
    """What ``encode`` gives per document: its ids as little-endian unsigned 32-bit numbers."""
    return {"ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}


def join_back(store: DataFrame, encoded: DataFrame, finish: Callable[[list[np.ndarray]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Step 3: ids meet their batch again and documents are reassembled by position; ``finish``
    turns the id lists of a batch into its output columns."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        parts = sorted(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True))
        lists = [unpack_lists(x, unpack) for _, x in parts]
        kind = left.column("kind").to_numpy()
        shard_of = unpack_numbers(left.filter(pa.array(kind == _SHARDS)).column("payload")[0].as_py(), unpack)
        counts = np.concatenate([c for c, _ in lists]) if lists else np.zeros(0, np.int64)
        if len(counts) != len(shard_of):
            raise RuntimeError("a batch came back with other pre-tokens than it sent")
        table, order = tokens.IdTable(), np.argsort(shard_of, kind="stable")
        table.flat = np.concatenate([np.frombuffer(i, "<u4") for _, i in lists]) if lists else np.zeros(0, np.uint32)
        table.count, table.start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        table.count[order], table.start[order] = counts, np.cumsum(counts) - counts
        docs = left.filter(pa.array(kind == _DOCUMENT))
        return pa.table({"doc_id": docs.column("doc_id")} | finish([table.take(unpack_numbers(x, unpack)) for x in docs.column("payload").to_pylist()]))

    return store.groupBy("batch").cogroup(encoded.groupBy("batch")).applyInArrow(run, "doc_id long, " + schema)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    finish: Callable[[list[np.ndarray]], dict[str, pa.Array]] = as_ids, schema: str = "ids binary",
) -> DataFrame:
    """Token ids of every whole text: (doc_id, ids), or what ``finish`` makes of a batch's id lists.

    A null text counts as empty (no ids), a null id stays null, repeated rows each give a row,
    other columns are not read. Steps 2 and 3 read the same shuffle of the split rows (by batch),
    so documents travel once, as compressed positions. Raises RuntimeError if a batch's
    pre-tokens don't come back whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = shard_count(int(spark.conf.get("spark.sql.shuffle.partitions")))
    store = split_documents(rows, shards).repartition("batch")
    return join_back(store, encode_words(store, ranks_path, pattern), finish, schema)


class ByteTable:
    """Byte strings by id, gathered for whole id arrays at once."""

    def __init__(self, entries: dict[int, bytes]) -> None:
        size = max(entries, default=-1) + 1
        self.known, self.count = np.zeros(size, bool), np.zeros(size, np.int64)
        for k, v in entries.items():
            self.known[k], self.count[k] = True, len(v)
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(entries[k] for k in sorted(entries)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the token-byte table")
        return self.flat[vec.ragged(self.start[ids], self.count[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def _worker_tables(ranks_path: str) -> tuple[ByteTable, ByteTable]:
    """Token bytes by id, and the decimal form of each id with a space behind it."""
    table = ByteTable({i: b for b, i in tokens.load_ranks(ranks_path).items()})
    return table, ByteTable({i: b"%d " % i for i in range(len(table.known))})


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Bytes of every id list: the ids meet the token-byte table (one entry per vocabulary id,
    loaded once per task). An id outside the table raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _worker_tables(ranks_path)
        for record in batches:
            data = [table.join(np.frombuffer(x, "<u4")) for x in record.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``encode`` and ``decode`` of every text in one pass over the batches: per document the number
    of ids, the digest of the decimal ids joined by spaces, the digest of the decoded bytes, and
    with ``keep_ids`` the ids themselves."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def finish(ids: list[np.ndarray]) -> dict[str, pa.Array]:
        table, decimal = _worker_tables(ranks_path)
        out = {
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(decimal.join(x)[:-1]).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(table.join(x)).hexdigest() for x in ids], pa.string()),
        }
        return out | (as_ids(ids) if keep_ids else {})

    return encode(docs, ranks_path, pattern, id_col, text_col, finish, schema)
