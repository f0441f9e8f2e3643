"""Ranked lexical search over K2-treaps of the term-document grid.

* Index: documents are cut into ranges of bounded text. Each range is one grid, terms by documents,
  whose cells hold a term's impact on a document; the grid is stored as a compressed quadtree, and
  every quadtree cell holds the largest impact inside it. Cells with a single child are left out.
  One range is one row of a Parquet table: building it is map only.
* Search: the rows of an item's terms start at the root of a range's tree and descend together:
  a document range of the item is one cell per row, bounded by the weighted sum of the cells'
  maxima. The most promising ranges of every item are halved first; a range goes once its bound
  can't enter the item's best k. A range of one document carries its exact score.
* Tasks keep the best k of each item over all their ranges; what Spark gathers is k rows of an item
  and task, ranked in two steps.

All scores are exact integers; nothing is left out but what can't be among the best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import vec
from strata.sources.tables import shared_folder

TOP = 20
#: Bounds of one document range, of the items searched together and of the text of one round of items.
RANGE_BYTES, RANGE_DOCS, ITEMS_AT_ONCE, ROUND_BYTES = 2 << 20, 4096, 256, 4 << 20
#: Bytes of one row group of the index.
GROUP_BYTES = 8 << 20
_PIECE_BYTES = 1 << 20
#: Document ranges of an item that are halved first; four times as many whenever a level is taken up again.
_FIRST = 8
_NO_ID = np.iinfo(np.int64).min
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term occurrence: runs of letters, digits and non-ASCII
    characters, A-Z in lower case."""
    starts, ends, doc = vec.byte_words(raw, off, _GAP)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return vec.span_hashes(vec.lower_byte_values(raw, off), starts, ends), doc


def collection_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, term occurrences) of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            raw, off = vec.text_buffer(record.column(1))
            n = length = 0
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                doc = vec.byte_words(raw, off[a : b + 1], _GAP)[2]
                n, length = n + len(np.unique(doc)), length + len(doc)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], names=["n", "length"])

    row = docs.mapInArrow(run, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return int(row[0] or 0), int(row[1] or 0)


@dataclass
class Grid:
    """One compressed quadtree. Nodes 0.. are the filled cells in Z order, the inner nodes follow; the
    last one is the root. ``code`` interleaves row and column bits, ``children`` (inner nodes) has -1
    for an empty quarter."""

    docs: np.ndarray  # document of each column, ascending
    terms: np.ndarray  # term hash of each row
    df: np.ndarray  # documents of each row
    height: int
    level: np.ndarray
    code: np.ndarray
    most: np.ndarray
    children: np.ndarray

    FIELDS = {"docs": np.int64, "terms": np.uint64, "df": np.int32, "level": np.uint8, "code": np.int64, "most": np.int32, "children": np.int32}

    def row(self) -> dict[str, object]:
        """The parts as bytes; cell codes as differences, which compress better."""
        parts = {f: getattr(self, f) for f in self.FIELDS}
        parts["code"] = np.diff(self.code, prepend=0)
        return {"height": self.height} | {f: np.ascontiguousarray(parts[f], t).tobytes() for f, t in self.FIELDS.items()}

    @classmethod
    def of(cls, row: dict[str, object]) -> Grid:
        parts = {f: np.frombuffer(row[f], t) for f, t in cls.FIELDS.items()}
        parts["code"] = np.cumsum(parts["code"])
        parts["children"] = parts["children"].reshape(-1, 4)
        return cls(height=row["height"], **parts)


_INDEX_SCHEMA = "height int, " + ", ".join(f"{f} binary" for f in Grid.FIELDS)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 31-bit numbers moved to the even places."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def build_grid(docs: np.ndarray, term: np.ndarray, column: np.ndarray, n_documents: int, length: int) -> Grid | None:
    """Grid of the occurrences (term hash, document number) of a range; ``docs`` are its ascending ids."""
    if not len(term):
        return None
    width = len(docs)
    terms, number = np.unique(term, return_inverse=True)
    cells, tf = np.unique(number * width + column, return_counts=True)
    number, column = cells // width, cells % width
    df = np.bincount(number, minlength=len(terms))
    order = np.argsort(-df, kind="stable")  # common terms side by side
    row = np.empty(len(terms), np.int64)
    row[order] = np.arange(len(terms))
    sizes = np.bincount(column, weights=tf, minlength=width).astype(np.int64)
    m = np.array([75 + (25 * n * n_documents) // length for n in sizes.tolist()], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[column])

    height = max(1, int(max(len(terms), width) - 1).bit_length())
    code = (_spread(row[number]) << 1) | _spread(column)
    z = np.argsort(code)
    code, impact = code[z], impact[z]
    levels, codes, most, children = [np.full(len(code), height, np.uint8)], [code], [impact], []
    ids, at, top, n = np.arange(len(code)), code, impact, len(code)
    for level in reversed(range(height)):
        up = at >> 2
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        count = np.diff(np.append(first, len(up)))
        several = count > 1
        new = int(several.sum())
        inner = np.where(several, n + np.cumsum(several) - 1, ids[first])
        table = np.full((new, 4), -1, np.int32)
        inside = np.repeat(several, count)
        table[np.repeat(inner, count)[inside] - n, at[inside] & 3] = ids[inside]
        ids, at, top = inner, up[first], np.maximum.reduceat(top, first)
        levels.append(np.full(new, level, np.uint8))
        codes.append(at[several] << (2 * (height - level)))
        most.append(top[several])
        children.append(table)
        n += new
    return Grid(docs, terms[order], df[order], height, np.concatenate(levels), np.concatenate(codes), np.concatenate(most), np.concatenate(children))


def write_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Index every document of ``docs`` in ``folder``: ``grids`` (one row per document range) and
    ``size`` (collection size). Null texts, and texts without a term, are in no grid; rows that repeat
    an id are documents of their own; a null id stays null. Other columns are not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, length = collection_size(rows)
    spark.createDataFrame([(n, length)], "n long, length long").coalesce(1).write.parquet(f"{folder}/size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            ids = record.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            raw, off = vec.text_buffer(record.column(1))
            # a document is counted as so many bytes more that a range has a bounded number of them
            for a, b in vec.pieces(np.diff(off) + RANGE_BYTES // RANGE_DOCS, RANGE_BYTES):
                found = [(h, d + a + i) for i, j in vec.pieces(np.diff(off[a : b + 1]), _PIECE_BYTES) for h, d in [term_hashes(raw, off[a + i : a + j + 1])]]
                order = np.argsort(ids[a:b], kind="stable")
                place = np.empty(b - a, np.int64)
                place[order] = np.arange(b - a)
                term, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                grid = build_grid(ids[a:b][order], term, place[doc - a], n, length)
                if grid is not None:
                    yield pa.RecordBatch.from_pylist([grid.row()], schema=_ARROW_SCHEMA)

    # a row holds megabytes: small row groups, checked at every row, bound what a reader holds at once
    writer = rows.mapInArrow(run, _INDEX_SCHEMA).write.option("compression", "zstd")
    writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(f"{folder}/grids")


_ARROW_SCHEMA = pa.schema([("height", pa.int32()), *((f, pa.binary()) for f in Grid.FIELDS)])


class Best:
    """The best k (score, document) of every item: highest score first, then smallest id."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.n_items = k, n_items
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.limits()

    def limits(self) -> None:
        """Score and id of each item's last place: score 0 while places are free."""
        self.last_score, self.last_doc = np.zeros(self.n_items, np.int64), np.full(self.n_items, _NO_ID)
        first = np.searchsorted(self.item, np.arange(self.n_items + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.last_score[full] = self.score[first[full] + self.k - 1]
        self.last_doc[full] = self.doc[first[full] + self.k - 1]

    def may_enter(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document from id ``doc`` on, scoring up to ``bound``, can be among the best."""
        last = self.last_score[item]
        return (bound > last) | ((bound == last) & (last > 0) & (doc < self.last_doc[item]))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        self.item, self.score, self.doc = item[kept], score[order][kept], doc[order][kept]
        self.limits()


@dataclass
class Ranges:
    """Document ranges of one level, each with the cells of its item's terms (``part`` of each cell
    is its range, ascending)."""

    level: int
    take: int
    item: np.ndarray
    prefix: np.ndarray
    bound: np.ndarray
    part: np.ndarray
    node: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    def pick(self, keep: np.ndarray, take: int) -> Ranges:
        number = np.cumsum(keep) - 1
        cells = keep[self.part]
        return Ranges(
            self.level, take, self.item[keep], self.prefix[keep], self.bound[keep],
            number[self.part[cells]], self.node[cells], self.row[cells], self.weight[cells],
        )


def _bounded(level: int, take: int, grid: Grid, item: np.ndarray, prefix: np.ndarray, part: np.ndarray, node: np.ndarray, row: np.ndarray, weight: np.ndarray) -> Ranges:
    """Ranges that have a cell left, with their bounds."""
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    bound = np.add.reduceat(weight * grid.most[node].astype(np.int64), first) if len(part) else np.zeros(0, np.int64)
    alive = part[first]
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(part))))
    return Ranges(level, take, item[alive], prefix[alive], bound, number, node, row, weight)


def _halve(grid: Grid, r: Ranges) -> Ranges:
    """Both halves of each range: every row's cell is replaced by its child in that half, if there is one."""
    shift, cells = grid.height - r.level - 1, len(grid.level) - len(grid.children)
    row_bit = (r.row >> shift) & 1
    branches = grid.level[r.node] == r.level
    quarter = (grid.code[r.node] >> (2 * shift)) & 3  # of a cell further down: where it lies
    sides = []
    for side in (0, 1):
        child = np.where((quarter == 2 * row_bit + side), r.node, -1)
        child[branches] = grid.children[r.node[branches] - cells, 2 * row_bit[branches] + side]
        alive = child >= 0
        sides.append((r.part[alive] + side * len(r.item), child[alive], r.row[alive], r.weight[alive]))
    part, node, row, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
    item = np.concatenate([r.item, r.item])
    prefix = np.concatenate([2 * r.prefix, 2 * r.prefix + 1])
    return _bounded(r.level + 1, r.take, grid, item, prefix, part, node, row, weight)


def search_grid(grid: Grid, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Enter the documents of a grid into ``best``. (item, term, weight) are the items' distinct terms,
    by item."""
    order = np.argsort(grid.terms)
    at = np.minimum(np.searchsorted(grid.terms, term, sorter=order), len(order) - 1)
    row = order[at]
    known = grid.terms[row] == term
    item, row, weight = item[known], row[known], weight[known]
    if not len(item):
        return
    who, part = np.unique(item, return_inverse=True)
    root = np.full(len(row), len(grid.level) - 1)
    work = [_bounded(0, _FIRST, grid, who, np.zeros(len(who), np.int64), part, root, row, weight)]
    while work:
        r = work.pop()
        start = r.prefix << (grid.height - r.level)
        inside = start < len(grid.docs)
        keep = inside & best.may_enter(r.item, r.bound, grid.docs[np.minimum(start, len(grid.docs) - 1)])
        if not keep.any():
            continue
        r = r.pick(keep, r.take)
        if r.level == grid.height:
            best.add(r.item, r.bound, grid.docs[r.prefix])
            continue
        by = np.lexsort((-r.bound, r.item))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - np.searchsorted(r.item[by], r.item[by])
        now = place < r.take
        if not now.all():
            work.append(r.pick(~now, 4 * r.take))
            r = r.pick(now, r.take)
        work.append(_halve(grid, r))


def _item_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item number, distinct term, occurrences) of the items of one round, by item."""
    raw, off = vec.text_buffer(pa.array(texts, pa.string()))
    term, item = term_hashes(raw, off)
    order = np.lexsort((term, item))
    term, item = term[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (item[1:] != item[:-1])])) if len(term) else np.zeros(0, np.int64)
    return item[first], term[first], np.diff(np.append(first, len(term)))


def document_frequencies(grids: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of a round's ``terms``; reads the two columns of the dictionaries."""
    wanted = np.unique(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for have, df in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), strict=True):
                have, df = np.frombuffer(have, np.uint64), np.frombuffer(df, np.int32)
                hit = np.isin(have, wanted)
                yield pa.RecordBatch.from_arrays([pa.array(have[hit].view(np.int64)), pa.array(df[hit].astype(np.int64))], names=["term", "df"])

    rows = grids.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r["term"] % (1 << 64): r["df"] for r in rows}


def search_index(spark: SparkSession, folder: str, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item over an index of ``write_index``: item_id, rank, doc_id,
    score. An item scores a document by the sum of weight times impact over its term occurrences
    (weights and impacts as documented in the module's SQL); documents that score 0 are left out, equal
    scores rank by ascending id (null first).

    Items go in rounds of bounded text, so that only one round's terms are sent to the tasks; a repeated
    (id, text) row is one item, several texts of one id are ranked apart. A null text has no hits."""
    grids = spark.read.schema(_INDEX_SCHEMA).parquet(f"{folder}/grids")
    size = spark.read.parquet(f"{folder}/size").first()
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    rounds = max(1, -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ROUND_BYTES))
    asked = asked.withColumn("round", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)))
    out = None
    for number in range(rounds):
        hits = _search_round(spark, grids, asked.where(F.col("round") == number).collect(), size["n"], k)
        out = hits if out is None else out.unionByName(hits)
    near = Window.partitionBy("item", "item_id", "shard").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    over = Window.partitionBy("item", "item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    part = out.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
    return part.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_round(spark: SparkSession, grids: DataFrame, rows: list, n_documents: int, k: int) -> DataFrame:
    """Best k of each item in every task: item (round's number and text hash), item_id, shard, doc_id, score."""
    rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    item, term, times = _item_terms([r["text"] for r in rows])
    df = document_frequencies(grids, term)
    w = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df.get(int(t), 0) + 1))) for t in term], np.int64)
    useful = w > 0
    item, term, weight = item[useful], term[useful], (w * times)[useful]
    ids = [r["item_id"] for r in rows]
    number = rows[0]["round"] if rows else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(min(ITEMS_AT_ONCE, len(ids) - a), k) for a in range(0, len(ids), ITEMS_AT_ONCE)]
        for record in batches:
            for i in range(record.num_rows):
                grid = Grid.of({name: record.column(j)[i].as_py() for j, name in enumerate(record.schema.names)})
                for g, b in enumerate(best):
                    lo, hi = np.searchsorted(item, (g * ITEMS_AT_ONCE, (g + 1) * ITEMS_AT_ONCE))
                    search_grid(grid, item[lo:hi] - g * ITEMS_AT_ONCE, term[lo:hi], weight[lo:hi], b)
        for g, b in enumerate(best):
            who = b.item + g * ITEMS_AT_ONCE
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{number}:{x}" for x in who.tolist()], pa.string()), pa.array([ids[x] for x in who.tolist()], pa.int64()),
                pa.array(b.doc, pa.int64(), mask=b.doc == _NO_ID), pa.array(b.score),
            ], names=["item", "item_id", "doc_id", "score"])

    hits = grids.mapInArrow(run, "item string, item_id long, doc_id long, score long")
    return hits.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(64)))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs`` in a new shared folder and search it for ``items``."""
    folder = shared_folder(docs.sparkSession, "lexical-index")
    write_index(docs, folder)
    return search_index(docs.sparkSession, folder, items, k)


_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same rows in SQL, by scoring every document that shares a term with an item.
SQL = f"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("text")}, '{_TERMS}') AS t FROM documents WHERE text IS NOT NULL
), size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM doc WHERE len(t) > 0),
posting AS (
  SELECT r, doc_id, n_terms, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n_terms, unnest(t) AS term FROM doc) GROUP BY 1, 2, 3, 4
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY 1), size
), item AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERMS}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2, 3
), scored AS (
  SELECT i.item_id, i.text, p.r, p.doc_id,
    CAST(sum(i.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * p.n_terms * size.n) // size.l))))) AS BIGINT) AS score
  FROM item i JOIN posting p ON p.term = i.term JOIN weight w ON w.term = i.term, size GROUP BY 1, 2, 3, 4
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
