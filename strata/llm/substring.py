"""Repeated word windows by super-k-mer partitioning, and texts without them.

* The minimiser of a window of ``WINDOW`` words is its least run of ``GRAM`` words, under a hashed
  order in which runs that are frequent in the corpus come last. Consecutive windows of a text with
  the same minimiser travel as one string of words to the minimiser's bucket: equal windows meet
  in one bucket, and a word travels about three times instead of 35.
* A task first merges equal strings of its batch, so that copies and passages that fill many
  documents reach a bucket once a batch. Edges of frequent passages differ from text to text;
  as their runs come last in the order, such windows go by a word run of their own context.
* A bucket numbers its words exactly, sorts its windows, and counts each, comparing word by word.
  What leaves it are the spans of words that repeated windows cover, per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import vec
from strata.sources.tables import write_shared_table

WINDOW, GRAM = 35, 5
#: Text per bucket and per piece of a batch, bytes that a packing holds; most windows in one string, and
#: windows hashed at a time. They bound a task's memory and change no result.
BUCKET_BYTES, PIECE_BYTES, PACK_BYTES, RUN_WINDOWS, HASHED_WINDOWS = 4 << 20, 2 << 20, 24 << 20, 4096, 1 << 16
#: A run is frequent from this share of all runs on (of a corpus of this many bytes: fewer are no burden).
FREQUENT_SHARE, FREQUENT_BYTES = 2.0**-20, 1 << 16


def text_pieces(raw: np.ndarray, off: np.ndarray, overlap: int, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, int, int]]:
    """Cut texts into bounded pieces (offsets, number of the first text, words of it before the piece).
    A text beyond ``limit`` is cut between words; each of its pieces repeats the last ``overlap`` words
    of the one before."""
    for a, b in vec.pieces(np.diff(off), limit):
        lo, hi = int(off[a]), int(off[b])
        if b - a > 1 or hi - lo <= limit:
            yield off[a : b + 1], a, 0
            continue
        before, size = 0, limit
        while True:
            end = min(lo + size, hi)
            while end < hi and not vec.is_gap(raw[end]):
                end += 1
            starts = vec.byte_words(raw, np.array([lo, end]))[0]
            if end < hi and len(starts) <= 2 * overlap:
                size *= 2  # words so long that the piece would not move on
                continue
            yield np.array([lo, end]), a, before
            if end == hi:
                break
            before, lo, size = before + len(starts) - overlap, lo + int(starts[len(starts) - overlap]) if overlap else end, limit


def joined_words(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each begins (with the end of the last)."""
    lens = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(lens)])
    part = raw[int(off[0]) : int(off[-1])]
    out = part[np.minimum(vec.ragged(starts, lens), max(len(part) - 1, 0))]
    out[at[1:] - 1] = 32
    return out, at


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs_of_words(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``GRAM`` consecutive words, and whether they are of one text."""
    if len(h) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return vec.windows(h, GRAM), doc[: len(doc) - GRAM + 1] == doc[GRAM - 1 :]


def super_kmers(h: np.ndarray, doc: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, windows) of each maximal run of windows with one minimiser in one text."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = vec.windows(h, GRAM)
    order = vec.mix64(runs ^ np.uint64(0x9AE16A3B2F90404F)) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        order |= (frequent[at] == runs).astype(np.uint64) << np.uint64(63)
    least = _sliding_least(order, WINDOW - GRAM + 1)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = least[inside]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(inside) != 1) | (doc[inside][1:] != doc[inside][:-1])])
    first = np.flatnonzero(new)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
    first = np.flatnonzero(place % RUN_WINDOWS == 0)
    return value[first], inside[first], np.diff(np.append(first, len(inside)))


def frequent_runs(rows: DataFrame, total_bytes: int) -> np.ndarray:
    """Sorted hashes of the word runs that make up a large share of all: at most 2 / share of them, as
    their counts add up to no more than all. A run with that share has half of it in batches that hold
    most of it, so batches may leave out what is rare in them; the set orders minimisers and
    changes no result."""
    share = max(FREQUENT_SHARE, FREQUENT_BYTES / max(total_bytes, 1)) / 2
    if share >= 1:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            raw, off = vec.text_buffer(record.column(0))
            found, total = [np.zeros(0, np.uint64)], 0
            for piece, _, before in text_pieces(raw, off, GRAM - 1):
                starts, ends, doc = vec.byte_words(raw, piece)
                runs, inside = runs_of_words(vec.span_hashes(vec.byte_values(raw, piece), starts, ends), doc)
                found.append(runs[inside])
                total += int(inside.sum())
            runs = np.concatenate(found)
            del found
            runs.sort()  # in place: the runs of a batch are many
            first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(runs)))
            kept = n >= max(2, share * total)
            runs, n = runs[first[kept]].view(np.int64), n[kept]
            yield pa.RecordBatch.from_arrays([pa.array([*runs.tolist(), None], pa.int64()), pa.array([*n.tolist(), total], pa.int64())], names=["run", "n"])

    counts = rows.select("text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    counts = write_shared_table(counts, "substring-runs")
    total = counts.where("run is null").first()
    if total is None:
        return np.zeros(0, np.uint64)
    often = counts.where(F.col("run").isNotNull() & (F.col("n") >= share * total["n"])).select("run").toPandas()["run"]
    return np.sort(often.to_numpy(np.int64).view(np.uint64))


_PACK_SCHEMA = "bucket long, words binary, sizes binary, times binary, owners binary, places binary"


class _Packer:
    """Super-k-mers of one task, equal ones merged, packed by bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bucket: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.used = 0

    def add(self, least: np.ndarray, strings: list[bytes], a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        number = self.number
        old = len(number)
        ids = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
        fresh = ids >= old
        where, first = np.unique(ids[fresh], return_index=True)
        self.bucket.append((least[fresh][first] % np.uint64(self.buckets)).astype(np.int64))
        self.found.append((ids, a, b, place))
        self.used += 40 * len(ids) + sum(100 + len(strings[i]) for i in np.flatnonzero(fresh)[first].tolist())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.number:
            return
        bucket = np.concatenate(self.bucket)
        ids, a, b, place = (np.concatenate(x) for x in zip(*self.found, strict=True))
        strings = list(self.number)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[ids], kind="stable")
        owners = np.stack([a[by], b[by]], axis=1)
        place = place[by]
        times = np.bincount(rank[ids], minlength=len(order))
        upto = np.concatenate([[0], np.cumsum(times)])
        cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        pack = zstandard.ZstdCompressor(level=1)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part = [strings[i] for i in order[lo:hi].tolist()]
            s, e = int(upto[lo]), int(upto[hi])
            sizes = np.fromiter(map(len, part), np.int32, len(part))
            yield pa.RecordBatch.from_arrays([
                pa.array([int(bucket[order[lo]])], pa.int64()), pa.array([pack.compress(b"".join(part))], pa.binary()),
                pa.array([sizes.tobytes()], pa.binary()), pa.array([times[lo:hi].astype(np.int32).tobytes()], pa.binary()),
                pa.array([owners[s:e].tobytes()], pa.binary()), pa.array([place[s:e].astype(np.int32).tobytes()], pa.binary()),
            ], names=[x.split()[0] for x in _PACK_SCHEMA.split(", ")])
        self.clear()


def packed(rows: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Super-k-mers of (text, a, b) rows, packed by batch and bucket; map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(buckets)
        for record in batches:
            raw, off = vec.text_buffer(record.column(0))
            key_a, key_b = (record.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for piece, first_text, before in text_pieces(raw, off, WINDOW - 1):
                starts, ends, doc = vec.byte_words(raw, piece)
                least, word, windows = super_kmers(vec.span_hashes(vec.byte_values(raw, piece), starts, ends), doc, frequent)
                if len(word):
                    text, at = joined_words(raw, piece, starts, ends)
                    text = text.tobytes()
                    lo, hi = at[word], at[word + windows + WINDOW - 1]
                    strings = [text[s:e] for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]
                    owner = doc[word]
                    number = word - np.searchsorted(doc, owner) + before
                    out.add(least, strings, key_a[first_text + owner], key_b[first_text + owner], number)
                if out.used >= PACK_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return rows.select("text", "a", "b").mapInArrow(run, _PACK_SCHEMA)


def repeated_windows(ids: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Whether the ``WINDOW`` word numbers from each of ``first`` on occur twice or more; a window counts
    ``times``. Windows are sorted by hash, and those of one hash are compared word by word."""
    h = np.empty(len(first), np.uint64)
    for i in range(0, len(first), HASHED_WINDOWS):
        some = first[i : i + HASHED_WINDOWS]
        lo, hi = int(some.min()), int(some.max()) + WINDOW
        h[i : i + HASHED_WINDOWS] = vec.span_hashes(vec.mix64(ids[lo:hi].astype(np.uint64) + np.uint64(1)), some - lo, some - lo + WINDOW)
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    size = np.diff(np.append(head, len(order)))
    lead = np.repeat(order[head], size)
    several = np.repeat(size > 1, size)
    x, y = first[order[several]], first[lead[several]]
    other = np.zeros(len(x), bool)
    for j in range(WINDOW):
        other |= ids[x + j] != ids[y + j]
    out = np.empty(len(first), bool)
    out[order] = np.repeat(np.add.reduceat(times[order], head) > 1, size)
    if other.any():  # different windows of one hash: count each by its words
        for value in np.unique(h[order[several][other]]).tolist():
            rows = np.flatnonzero(h == np.uint64(value))
            words = [ids[first[r] : first[r] + WINDOW].tobytes() for r in rows]
            n: dict[bytes, int] = {}
            for r, w in zip(rows, words, strict=True):
                n[w] = n.get(w, 0) + int(times[r])
            out[rows] = [n[w] > 1 for w in words]
    return out


def _count_bucket(table: pa.Table) -> pa.Table:
    """Spans (a, b, lo, hi) of words that repeated windows of a bucket cover."""
    read = zstandard.ZstdDecompressor()
    text = bytearray()
    for x in table.column("words"):
        text += read.decompress(x.as_py())
    text = np.frombuffer(text, np.uint8)
    part = {c: b"".join(table.column(c).to_pylist()) for c in ("sizes", "times", "owners", "places")}
    sizes, times, places = (np.frombuffer(part[c], np.int32).astype(np.int64) for c in ("sizes", "times", "places"))
    owners = np.frombuffer(part["owners"], np.int64).reshape(-1, 2)
    at, kind = (np.int32, pa.binary()) if len(text) < 1 << 31 else (np.int64, pa.large_binary())
    offsets = np.concatenate([np.zeros(1, at), (np.flatnonzero(text == 32) + 1).astype(at)])
    ends = offsets[1:]
    words = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    ids = words.dictionary_encode().indices.to_numpy()
    upto = np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes), side="right")])
    windows = np.diff(upto) - WINDOW + 1
    first = vec.ragged(upto[:-1], windows)
    string = np.repeat(np.arange(len(sizes)), windows)
    again = repeated_windows(ids, first, times[string])
    first, string = first[again], string[again]
    start = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(string) != 0)]) if len(first) else np.zeros(0, bool)
    lo = np.flatnonzero(start)
    hi = np.append(lo[1:], len(first)) - 1 if len(lo) else lo
    of = string[lo]
    lo, hi = first[lo] - upto[of], first[hi] + WINDOW - upto[of]
    owner = vec.ragged((np.cumsum(times) - times)[of], times[of])
    lo, hi = np.repeat(lo, times[of]) + places[owner], np.repeat(hi, times[of]) + places[owner]
    return pa.table({"a": owners[owner, 0], "b": owners[owner, 1], "lo": lo, "hi": hi})


_OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<lo:bigint,hi:bigint>>"


def _remove(joined: DataFrame) -> DataFrame:
    """(doc_id, text, spans) rows to the operator's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            raw, off = vec.text_buffer(record.column(1))
            spans = record.column(2)
            span_at = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            flat = spans.flatten()
            lo, hi = (flat.field(i).to_numpy() for i in (0, 1))
            for i, j in vec.pieces(np.diff(off), PIECE_BYTES):
                starts, ends, doc = vec.byte_words(raw, off[i : j + 1])
                words = np.searchsorted(doc, np.arange(j - i + 1))
                text, at = joined_words(raw, off[i : j + 1], starts, ends)
                mine = slice(int(span_at[i]), int(span_at[j]))
                base = np.repeat(words[:-1], np.diff(span_at[i : j + 1]))
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, lo[mine] + base, 1)
                np.add.at(depth, hi[mine] + base, -1)
                kept = np.cumsum(depth)[:-1] == 0
                text = text[np.repeat(kept, np.diff(at))].tobytes()
                left = np.concatenate([[0], np.cumsum(np.where(kept, np.diff(at), 0))])[words]
                n_kept = np.concatenate([[0], np.cumsum(kept)])[words]
                out = [text[s : max(s, e - 1)].decode() for s, e in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    record.column(0).slice(i, j - i), pa.array(np.diff(words)), pa.array(np.diff(words) - np.diff(n_kept)),
                    pa.array(out, pa.string()), spans.slice(i, j - i),
                ], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(run, _OUT_SCHEMA)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, ``kept`` (the remaining words, joined by
    one space) and ``spans`` (word ranges [lo, hi) covered by repeated windows; they may overlap, null
    if there are none).

    Words are runs of anything but ASCII white space, compared byte by byte. A window is 35
    consecutive words of one text; every word of a window that starts anywhere else too, be it in
    the same text, goes. A null text has no words; a repeated row is a text of its own, so all
    its windows are repeated; a null id stays null. Other columns are not read.

    Shuffles: the packed super-k-mers (about three times the text, compressed), the spans, and the texts once."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("a", F.xxhash64(F.lit(1), "doc_id", "text")).withColumn("b", F.xxhash64(F.lit(2), "doc_id", "text"))
    rows = base.where("text is not null")
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, -(-total // BUCKET_BYTES))
    strings = packed(rows, frequent_runs(rows, total), buckets)
    spans = strings.groupBy("bucket").applyInArrow(_count_bucket, "a long, b long, lo long, hi long")
    spans = spans.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    spans = write_shared_table(spans, "substring-spans")  # a plain shuffle on either side: a row repeated often can be split
    return _remove(base.join(spans, ["a", "b"], "left").select("doc_id", "text", "spans"))


#: The same rows in SQL, by grouping all windows.
SQL = f"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS key FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM doc)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS j FROM win JOIN (SELECT key FROM win GROUP BY key HAVING count(*) > 1) USING (key)
), left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM doc)
  ANTI JOIN gone USING (r, j) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (r)
"""
