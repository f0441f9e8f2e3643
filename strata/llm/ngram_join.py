"""N-gram Jaccard self-join by MinHash banding, with exact verification on full n-gram sets.

* Band and row counts follow from the wanted recall at the threshold (``choose_bands``).
* Rows with the same n-gram set collapse into one node before anything is joined.
* In every band bucket, members are compared by small sketches of their MinHashes, and only those
  that agree about as often as the threshold asks are tied (a row per member, however large the
  bucket). Documents that merely share a template thus form no chain; the components of
  the ties hold every candidate pair.
* Each component is verified in blocks: its members are dealt into parts of bounded size, and
  each pair of parts is one task's work, where all pairs are compared on full n-gram sets by a
  matrix product. What leaves a block is one row per member (its links there, and the smallest
  member linked to it), never a row per pair. Classes follow from verified links alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import vec
from strata.llm.components import connected_components
from strata.sources.tables import write_shared_table

WIDTH, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128
#: Bounds of one part of a component: members, and n-grams in all.
PART_MEMBERS, PART_GRAMS = 1024, 1 << 20
#: Standard deviations that the agreement of two sketches may fall short of a pair at the threshold
#: (a miss of about 1e-7, beside the bands' 1e-4), and rows of one task's share of band buckets.
SKETCH_SLACK, SHARE_ROWS = 5.2, 1 << 12
_PIECE_BYTES = 1 << 20
_GRAMS_AT_ONCE = 2048


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows per band (fewest false candidates) for which a pair at the
    threshold shares a band with probability ``recall``, within ``max_hashes`` hash values."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss = math.log1p(-min(threshold**rows, 1 - 1e-12))  # log of the chance that one band misses
        bands = math.ceil(math.log(1 - recall) / miss) if miss else max_hashes + 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches this recall within max_hashes")
    return best


def gram_sets(raw: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a piece. A text with fewer words than the
    width has its whole word sequence as its one n-gram; one without words has none."""
    starts, ends, doc = vec.byte_words(raw, off)
    n = len(off) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    h = vec.span_hashes(vec.byte_values(raw, off), starts, ends)
    grams = vec.windows(h, width)
    at = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= width:
            out.append(np.unique(grams[s : e - width + 1]))
        else:
            out.append(vec.windows(h[s:e], e - s) if e > s else np.zeros(0, np.uint64))
    return out


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = vec.mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signature(grams: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, a bounded slice at a time."""
    out = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), _GRAMS_AT_ONCE):
        part = grams[i : i + _GRAMS_AT_ONCE]
        np.minimum(out, (mult[:, None] * part[None, :] + add[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, rep, n, set_a, set_b, bands, sketch) per row of (doc_id, text, rep); map only.
    ``set_a``/``set_b`` are a 128-bit hash of the n-gram set, ``n`` its size, ``sketch`` four bits of
    each MinHash."""
    schema = "doc_id long, rep long, n int, set_a long, set_b long, bands array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _family(bands * rows)
        band_no = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for record in batches:
            raw, off = vec.text_buffer(record.column(1))
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                sets = gram_sets(raw, off[a : b + 1], width)
                keys, sketches = np.zeros((len(sets), bands), np.uint64), [b""] * len(sets)
                fp = np.zeros((len(sets), 2), np.uint64)
                for i, grams in enumerate(sets):
                    if not len(grams):
                        continue
                    sig = signature(grams, mult, add).reshape(bands, rows)
                    acc = band_no.copy()
                    for r in range(rows):
                        acc = vec.mix64(acc ^ sig[:, r]) * np.uint64(0x9FB21C651E98DF25)
                    keys[i], sketches[i] = acc, pack_sketch(sig.ravel())
                    fp[i] = grams.sum(dtype=np.uint64), vec.mix64(grams).sum(dtype=np.uint64)
                n = np.array([len(g) for g in sets], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [record.column(0).slice(a, b - a), record.column(2).slice(a, b - a), pa.array(n), pa.array(fp[:, 0].view(np.int64)),
                     pa.array(fp[:, 1].view(np.int64)), lists, pa.array(sketches, pa.binary())],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return docs.mapInArrow(run, schema)


def pack_sketch(sig: np.ndarray) -> bytes:
    """Four mixed bits of each MinHash, two to a byte."""
    bits = (vec.mix64(sig) & np.uint64(15)).astype(np.uint8)
    bits = np.append(bits, np.zeros(len(bits) % 2, np.uint8))
    return (bits[::2] | (bits[1::2] << 4)).tobytes()


def sketch_limit(hashes: int, threshold: float) -> int:
    """Least number of equal sketch entries for a pair to be a candidate: what a pair at the threshold
    has on average, less ``SKETCH_SLACK`` standard deviations."""
    p = threshold + (1 - threshold) / 16
    return math.floor(hashes * p - SKETCH_SLACK * math.sqrt(hashes * p * (1 - p)))


def _unpacked(sketches: list[bytes], hashes: int) -> np.ndarray:
    both = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.stack([both & 15, both >> 4], axis=2).reshape(len(sketches), -1)[:, :hashes]


def _ties(buckets: DataFrame, hashes: int, limit: int) -> DataFrame:
    """(a, b) ties of rows (share, i, j, band, side, node, sketch): members of a band bucket whose
    sketches agree are tied to the smallest member that they reach there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("band", "ascending"), ("node", "ascending")])
        band, node, side = (table.column(c).to_numpy() for c in ("band", "node", "side"))
        sketch = _unpacked(table.column("sketch").to_pylist(), hashes)
        cut = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        two = cut[:-1][np.diff(cut) == 2]  # most buckets are pairs: all at once
        alike = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= limit]
        a.append(node[alike + 1])
        b.append(node[alike])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s > 2:
                same = np.zeros((e - s, e - s), np.uint16)
                for k in range(hashes):
                    same += sketch[s:e, k, None] == sketch[None, s:e, k]
                link = same >= limit
                if side[s:e].any() and not side[s:e].all():
                    link &= side[s:e, None] != side[None, s:e]
                root = _roots(link)
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(node[s + moved])
                b.append(node[s + root[moved]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return buckets.groupBy("share", "i", "j").applyInArrow(run, "a long, b long")


def _dealt(members: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """``members`` of groups ``key`` once for every pair (i, j) of parts that their own part is in;
    ``side`` 1 is the part with the larger number. ``parts`` (key, parts) is a written table."""
    dealt = members.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({
        "i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int"),
    }).drop("part", "other", "parts")


def _gram_rows(docs: DataFrame, width: int) -> DataFrame:
    """(node, grams) for (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            raw, off = vec.text_buffer(record.column(1))
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                grams = [g.tobytes() for g in gram_sets(raw, off[a : b + 1], width)]
                yield pa.RecordBatch.from_arrays([record.column(0).slice(a, b - a), pa.array(grams, pa.binary())], names=["node", "grams"])

    return docs.mapInArrow(run, "node long, grams binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|A & B| for every A of ``left`` and B of ``right``: only n-grams found on both sides
    matter; their incidence matrices are multiplied a bounded number of columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat_l, flat_r = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    row_l = np.repeat(np.arange(len(left)), [len(g) for g in left])
    row_r = np.repeat(np.arange(len(right)), [len(g) for g in right])
    common = np.intersect1d(flat_l, flat_r)
    if not len(common):
        return out

    def entries(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the common n-grams, by column."""
        col = np.searchsorted(common, flat)
        found = common[np.minimum(col, len(common) - 1)] == flat
        row, col = row[found], col[found]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    both = [(*entries(flat_l, row_l), len(left)), (*entries(flat_r, row_r), len(right))]
    for c in range(0, len(common), _GRAMS_AT_ONCE):
        sides = []
        for row, col, n in both:
            s, e = np.searchsorted(col, (c, c + _GRAMS_AT_ONCE))
            x = np.zeros((n, min(_GRAMS_AT_ONCE, len(common) - c)), np.float32)
            x[row[s:e], col[s:e] - c] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of pairs whose sets have a Jaccard similarity of ``threshold`` or more."""
    both = shared_counts(left, right).astype(np.float64)
    size_l, size_r = (np.array([len(g) for g in x], np.float64) for x in (left, right))
    union = size_l[:, None] + size_r[None, :] - both
    return both >= threshold * union - 1e-9


def _roots(link: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row of a symmetric link matrix."""
    label, n = np.arange(len(link)), len(link)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify_block(nodes: np.ndarray, copies: np.ndarray, side: np.ndarray, grams: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each member: copies of other members linked to it here, and the smallest
    member it is connected to here. ``side`` 0/1 tells the two parts; one part alone is compared with itself."""
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    link = np.zeros((len(nodes), len(nodes)), bool)
    if len(b) and len(a):
        part = linked([grams[i] for i in a], [grams[i] for i in b], threshold)
        link[np.ix_(rank[a], rank[b])] = part
        link[np.ix_(rank[b], rank[a])] = part.T
    elif len(a):
        part = linked([grams[i] for i in a], [grams[i] for i in a], threshold)
        np.fill_diagonal(part, False)
        link[np.ix_(rank[a], rank[a])] = part
    links = link @ copies[order].astype(np.float64)
    roots = order[_roots(link)]
    return links[rank].astype(np.int64), nodes[roots[rank]]


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """Block rows (component, i, j, side, node, copies, grams) to (component, node, links, root)."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        links, root = verify_block(nodes, table.column("copies").to_numpy(), table.column("side").to_numpy(), grams, threshold)
        return pa.table({"node": nodes, "links": links, "root": root})

    return members.groupBy("component", "i", "j").applyInArrow(run, "node long, links long, root long")


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
    recall: float = RECALL, max_hashes: int = MAX_HASHES,
) -> DataFrame:
    """Near duplicates: one row per row of ``docs`` with doc_id, class_id (smallest id that it is
    connected to by links) and n_links (documents whose n-gram set has a Jaccard similarity of
    ``threshold`` or more with its own, copies included, itself not).

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are written; n-grams are runs of
    ``width`` words. A null text, or one without words, has no links and is a class of its own.
    Repeated rows count as copies of each other. An id that comes with several texts has the links of
    each text on that text's row, and joins their classes; the order of the rows doesn't matter.
    Rows with a null id take part like others but name no class: their class is null if all its
    members' ids are. Other columns are not read.

    Shuffles: set hashes (one row per document), band hashes (``bands`` rows per distinct set),
    sketches of sets that share a band, and the n-gram sets of candidate nodes alone."""
    bands, per_band = choose_bands(threshold, recall, max_hashes)
    hashes = bands * per_band
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("rep", F.xxhash64("doc_id", "text"))
    sig = write_shared_table(signatures(rows, bands, per_band, width), "ngram-signatures")

    key = ["set_a", "set_b", "n"]
    sets = sig.where("n > 0").groupBy(*key).agg(
        F.min("doc_id").alias("smallest"), F.count("*").alias("copies"), F.min("rep").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    sets = write_shared_table(sets.withColumn("node", F.monotonically_increasing_id()), "ngram-sets")
    banded = sets.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = write_shared_table(shared, "ngram-buckets")  # a plain shuffle on either side: a hot band can be split
    found = write_shared_table(banded.join(shared.select("band"), "band"), "ngram-banded")
    shares = max(1, -(-found.count() // SHARE_ROWS))
    parts = shared.select("band", F.ceil(F.col("members") / PART_MEMBERS).cast("int").alias("parts"))
    buckets = _dealt(found, parts, "band").join(sets.select("node", "sketch"), "node")
    # the blocks of a bucket of several parts are dealt apart, small buckets share a task
    buckets = buckets.withColumn("share", F.when(F.col("j") > 0, F.col("band")).otherwise(F.pmod("band", F.lit(shares))))
    ties = _ties(buckets, hashes, sketch_limit(hashes, threshold))

    found = connected_components(ties)
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    members = write_shared_table(found.join(sets.select("node", "copies", "n", "rep"), "node"), "ngram-members")
    parts = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / PART_MEMBERS), F.ceil(F.sum("n") / PART_GRAMS)).cast("int").alias("parts")
    )
    dealt = _dealt(members, write_shared_table(parts, "ngram-parts"), "component")
    texts = rows.join(members.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
    grams = _gram_rows(texts.select("rep", "text"), width).withColumnRenamed("node", "rep")
    blocks = dealt.join(grams, "rep").select("component", "i", "j", "side", "node", "copies", "grams")
    verified = write_shared_table(_verify(blocks, threshold), "ngram-verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))

    # classes: verified links, and the texts of one id
    by_id = sig.where("n > 0 and doc_id is not null").join(sets.select(*key, "node"), key).select("doc_id", "node")
    several = by_id.groupBy("doc_id").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("top > hub")
    several = write_shared_table(several, "ngram-several")
    same_id = by_id.join(several.select("doc_id", "hub"), "doc_id").where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    joined = verified.where("root < node").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same_id)
    components = connected_components(joined)
    components = write_shared_table(components.unionByName(components.select(F.col("component").alias("node"), "component").distinct()), "ngram-classes")
    ids = components.join(sets.select("node", "smallest"), "node").groupBy("component").agg(F.min("smallest").alias("class"))
    classes = components.join(write_shared_table(ids, "ngram-class-ids"), "component").select("node", "class")

    info = (
        sets.join(links, "node", "left").join(classes, "node", "left")
        .where("copies > 1 or links > 0 or class is not null")
        .select(*key, F.coalesce("class", "smallest").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    info = write_shared_table(info, "ngram-info")
    return sig.select("doc_id", *key).join(info, key, "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the near duplicates: of each class the row with the smallest id stays
    (of rows that repeat an id, all or none: drop repeats before). Rows with a null id stay."""
    classes = ngram_jaccard_join(docs, id_col, text_col, **options)
    mark = "gone_" + "_".join(docs.columns)  # a name that no column has
    gone = classes.where("class_id < doc_id").select(F.col("doc_id").alias(mark))
    return docs.join(gone, F.col(id_col) == F.col(mark), "left_anti")


#: The same rows in SQL, by comparing every two documents that share an n-gram (for small tables).
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WIDTH} THEN [array_to_string(w[i:i + {WIDTH - 1}], ' ') for i in range(1, len(w) - {WIDTH - 2})]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common >= {THRESHOLD} * (x.n + y.n - common) - 1e-9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, least(d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id)) AS class_id,
  (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""
