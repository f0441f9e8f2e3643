"""Token-id files: each document's ids compressed on their own with a shared zstandard dictionary.

A folder holds three Parquet tables written by Spark (committed or absent as a whole, so a
lost executor leaves no half file):

* ``dictionary``: one row (hash, bytes) - trained on serialized id arrays of a bounded sample;
* ``blocks``: one row per run of documents in ascending id order - the compressed documents one
  after the other (``data``), the offset index (``doc_ids``, ``offsets``, ``n_tokens``), the
  dictionary hash, and the number of ids before the block in its part;
* ``parts``: ids before each part (one row per write task).

One document is read by pruning blocks on their id range and decompressing its slice alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import tokens, vec

#: Bounds of the training sample: documents, and ids taken of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1_000, 4_096, 64 << 10
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1_024
LEVEL = 3
_PIECE_BYTES = 2 << 20
_CACHE_ENTRIES = 400_000
_BLOCK = (
    "part int, block int, ids_before long, n_ids long, first_id long, last_id long, dictionary_hash string, "
    "doc_ids array<long>, offsets array<long>, n_tokens array<long>, data binary"
)
_WORKER: dict[str, tokens.PretokenCache] = {}


def word_encoder(path: str, end_id: int) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Function texts -> (ids one after the other with the end id of each, ids per text),
    equal to the library's encode(text, add_special_tokens=False) + [end_id]."""

    cache = _WORKER.setdefault(path, tokens.PretokenCache(functools.partial(tokens.encode_words, path), _CACHE_ENTRIES))
    special = tokens.special_strings(path)

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [any(x in t for x in special) for t in texts]
        plain = ["" if w else tokens.normalise_words(t) for t, w in zip(texts, whole, strict=True)]
        ids, counts = cache.ids(plain, "words")
        rows = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
        for i in np.flatnonzero(whole).tolist():  # texts with special strings: the library's default
            rows[i] = np.array(tokens.load_tokenizer(path).encode(texts[i], add_special_tokens=False).ids, np.uint32)
        end = np.array([end_id], np.uint32)
        flat = [x for r in rows for x in (r, end)]
        return np.concatenate(flat).astype("<u4") if flat else ids, np.array([len(r) + 1 for r in rows], np.int64)

    return run


def _pieces(record: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, a bounded number of bytes at a time; a null text is ''."""
    for a, b in vec.pieces(np.diff(vec.text_buffer(record.column(1))[1]), _PIECE_BYTES):
        yield record.column(0).slice(a, b - a).to_pylist(), [x or "" for x in record.column(1).slice(a, b - a).to_pylist()]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained dictionary; with too few samples to train on, their raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or bytes(64))[-size:].rjust(64, b"\0")


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def sample_arrays(rows: DataFrame, path: str, end_id: int) -> list[bytes]:
    """Serialized id arrays of a sample of about SAMPLE_DOCS documents (at most twice as many, and
    SAMPLE_IDS ids of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path, end_id)
        for record in batches:
            for _, texts in _pieces(record):
                ids, counts = encode(texts)
                parts = np.split(ids, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_IDS].tobytes() for x in parts], pa.binary())], names=["ids"])

    picked = tokens.hash_sample(rows, SAMPLE_DOCS).mapInArrow(run, "ids binary")
    return [bytes(r.ids) for r in picked.limit(2 * SAMPLE_DOCS).collect()]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to ``folder`` in ascending id order.

    A null text counts as empty (the end id alone); null ids sort first; rows with the same id
    stay separate entries, ordered by a hash of their text. Other columns are not read.
    The rows are range-partitioned by id once; all else is map only."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dictionary = train_dictionary(sample_arrays(rows, path, end_id))
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = as_dictionary(shared.value)
        own.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        encode = word_encoder(path, end_id)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids_held: list[int | None] = []
        data: list[bytes] = []
        counts_held: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal block, before, ids_held, data, counts_held
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).tolist()
            known = [i for i in ids_held if i is not None]
            row = (part, block, before, sum(counts_held), min(known, default=None), max(known, default=None), digest, ids_held, offsets, counts_held, b"".join(data))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])
            block, before, ids_held, data, counts_held = block + 1, before + sum(counts_held), [], [], []
            return out

        for record in batches:
            for ids, texts in _pieces(record):
                flat, counts = encode(texts)
                for doc_id, tokens_of in zip(ids, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    ids_held.append(doc_id)
                    data.append(pack.compress(tokens_of.tobytes()))
                    counts_held.append(len(tokens_of))
                    if len(data) >= BLOCK_DOCS:
                        yield close()
                if sum(counts_held) >= BLOCK_IDS:
                    yield close()
        if data:
            yield close()

    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, _BLOCK).write.parquet(f"{folder}/blocks")
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row per write task, whatever the number of documents
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("part_start")).coalesce(1).write.parquet(f"{folder}/parts")


def _dictionary(spark: SparkSession, folder: str):
    return spark.read.parquet(f"{folder}/dictionary").first()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the folder: doc_id, start (ids before it), n_tokens, ids (little-endian
    unsigned 32-bit). Raises ValueError where a block names another dictionary."""
    row = _dictionary(spark, folder)
    shared = spark.sparkContext.broadcast((row["hash"], bytes(row["bytes"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, raw = shared.value
        unpack = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw))
        for record in batches:
            for x in record.to_pylist():
                if x["dictionary_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, data = x["offsets"], memoryview(x["data"])
                ids = [unpack.decompress(data[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
                counts = np.array(x["n_tokens"], np.int64)
                starts = x["first_start"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part")
    rows = blocks.select("dictionary_hash", "doc_ids", "offsets", "n_tokens", "data", (F.col("part_start") + F.col("ids_before")).alias("first_start"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[int] | None:
    """Ids of one document: blocks are pruned by their id range and only its slice leaves the
    file's row; None if the folder has no such document."""
    blocks = spark.read.parquet(f"{folder}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    found = blocks.withColumn("at", at).where("at > 0").select(
        "dictionary_hash", F.expr("substring(data, cast(offsets[at - 1] as int) + 1, cast(offsets[at] - offsets[at - 1] as int))").alias("data")
    ).first()
    if found is None:
        return None
    row = _dictionary(spark, folder)
    if row["hash"] != found["dictionary_hash"]:
        raise ValueError("the block was written with another dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=as_dictionary(bytes(row["bytes"])))
    return np.frombuffer(unpack.decompress(bytes(found["data"])), "<u4").tolist()
