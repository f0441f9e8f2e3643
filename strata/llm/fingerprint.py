"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (lines that are not empty). Each paragraph hashes to a
wide vector; a fingerprint is the sum of its paragraphs' vectors, so the order of paragraphs
doesn't matter, and inserting or deleting one adds or subtracts its vector:

* 2 wide lanes of 60 bits of the whole paragraph's hash, for equality;
* 120 narrow lanes, two to a word, 30 bits apart, to which each sentence of the paragraph adds
  one hash bit - their differences tell how much two texts have in common, also where an edit
  falls inside a paragraph (exact lanes up to 2**30 - 1 sentences, more than a row can hold);
* the numbers of paragraphs and of sentences.

Every word is added modulo 2**60, which no number of paragraphs can overflow. The printed form is
all words in hexadecimal; ``words_of_text`` reads them back, so that stored fingerprints can be
compared, added and subtracted at any length of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MASK = (1 << 60) - 1
_LANE_BITS = 30
_SPREAD = 1 | 1 << _LANE_BITS
_NARROW_SEEDS, _WIDE_SEEDS = (11, 12), (21, 22)
#: Narrow words, and the lanes in them; hexadecimal digits of a printed word.
_NARROW = _LANE_BITS * len(_NARROW_SEEDS)
LANES = 2 * _NARROW
_WORDS, _DIGITS = _NARROW + len(_WIDE_SEEDS) + 2, 15
MIN_BUCKETS = 256


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != "")


def sentences(parts: Column) -> Column:
    """Sentences of an array of paragraphs: cut after . ! or ? and white space."""
    return F.flatten(F.transform(parts, lambda p: F.split(p, r"(?<=[.!?])\s+", -1)))


def _hashes(items: Column, seeds: tuple[int, ...]) -> Column:
    return F.transform(items, lambda p: F.struct(*(F.xxhash64(F.lit(s), p).alias(f"s{s}") for s in seeds)))


def with_words(rows: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds the fingerprint words of a text column: narrow lanes, wide lanes, sentences, paragraphs.
    Paragraphs and sentences are split once and hashed once per seed."""
    whole, fine = f"{out_col}_whole", f"{out_col}_fine"

    def total(hashes: str, seed: int, take) -> Column:
        return F.aggregate(F.col(hashes), F.lit(0).cast("long"), lambda a, h: (a + take(h[f"s{seed}"])).bitwiseAND(F.lit(_MASK)))

    narrow = [total(fine, s, lambda h, j=j: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_SPREAD))) for s in _NARROW_SEEDS for j in range(_LANE_BITS)]
    wide = [total(whole, s, lambda h: h.bitwiseAND(F.lit(_MASK))) for s in _WIDE_SEEDS]
    rows = rows.withColumn(whole, paragraphs(F.col(text_col))).withColumn(fine, _hashes(sentences(F.col(whole)), _NARROW_SEEDS))
    rows = rows.withColumn(whole, _hashes(F.col(whole), _WIDE_SEEDS))
    return rows.withColumn(out_col, F.array(*narrow, *wide, F.size(fine).cast("long"), F.size(whole).cast("long"))).drop(whole, fine)


def add_words(a: Column, b: Column) -> Column:
    """Fingerprint words of the two multisets together (insertion)."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def subtract_words(a: Column, b: Column) -> Column:
    """Fingerprint words of ``a`` without the paragraphs of ``b`` (deletion)."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MASK)))


def as_text(words: Column) -> Column:
    """The printed form: every word as 15 hexadecimal digits, in order."""
    return F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x), _DIGITS, "0")), "")


def words_of_text(text: Column) -> Column:
    """The words of a printed fingerprint; null if ``text`` is null or not as long as one."""
    word = lambda i: F.conv(F.substring(text, i * _DIGITS + 1, F.lit(_DIGITS)), 16, 10).cast("long")
    return F.when(F.length(text) == _WORDS * _DIGITS, F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), word))


def likeness_of_text(a: Column, b: Column) -> Column:
    """``likeness`` of two printed fingerprints; null if either is none."""
    both = F.array(F.struct(words_of_text(a).alias("a"), words_of_text(b).alias("b")))
    return F.get(F.transform(both, lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), likeness(s["a"], s["b"]))), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """How alike the multisets behind two fingerprints are, 0 to 1: with signed lanes
    v = 2 count - n, 2 <va, vb> / (<va, va> + <vb, vb>), which is 1 for equal multisets and about
    the shared part otherwise. Two empty multisets are alike (1)."""
    size_a, size_b = F.element_at(a, -2).cast("double"), F.element_at(b, -2).cast("double")
    lane = lambda w, j: 2.0 * F.shiftrightunsigned(w, _LANE_BITS * j).bitwiseAND(F.lit((1 << _LANE_BITS) - 1)).cast("double")
    pairs = F.zip_with(F.slice(a, 1, _NARROW), F.slice(b, 1, _NARROW), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def step(acc: Column, p: Column) -> Column:
        va, vb = [lane(p["x"], j) - size_a for j in range(2)], [lane(p["y"], j) - size_b for j in range(2)]
        dot = sum((x * y for x, y in zip(va[1:], vb[1:], strict=True)), va[0] * vb[0])
        norm = sum((x * x + y * y for x, y in zip(va[1:], vb[1:], strict=True)), va[0] * va[0] + vb[0] * vb[0])
        return F.struct((acc["dot"] + dot).alias("dot"), (acc["norm"] + norm).alias("norm"))

    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("norm")), step)
    ratio = F.transform(F.array(sums), lambda s: F.when(s["norm"] == 0, F.lit(1.0)).otherwise(2.0 * s["dot"] / s["norm"]))[0]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, words): the fingerprint of every whole text; map only. A null text is
    the empty multiset; null ids and repeated rows each give a row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_words(rows, "text", "words").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "words")


def _with_next(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Each row with ``words`` (its fingerprint) and ``next``: text and words of the row after it in
    descending (doc_id, tie) order, the first one after the last.

    Ids are cut into ranges of about equal row counts; the order is taken inside a range, and a
    range's last row takes the first row of the next range (one row per range) - no task sees
    more than a range."""
    marks = rows.agg(F.percentile_approx("doc_id", [k / n_buckets for k in range(1, n_buckets)], 100 * n_buckets).alias("q")).first()["q"] or []
    cuts = F.array(*[F.lit(x).cast("long") for x in sorted(set(marks))]) if marks else F.array().cast("array<long>")
    ranged = rows.withColumn("bucket", F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
    inside = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    with_lead = with_words(ranged, "text", "words").withColumn("lead", F.lead(F.struct("text", "words")).over(inside))
    heads = ranged.groupBy("bucket").agg(F.max_by("text", F.struct("doc_id", "tie")).alias("text"))
    line = heads.agg(F.array_sort(F.collect_list("bucket")).alias("all"))  # bucket numbers: at most n_buckets
    follow = heads.crossJoin(F.broadcast(line)).withColumn("at", F.array_position("all", F.col("bucket")).cast("int"))
    # a range's first row follows the last row of the range above it; the highest one's follows the lowest
    follow = follow.select(
        F.when(F.col("at") < F.size("all"), F.get("all", F.col("at"))).otherwise(F.get("all", F.lit(0))).alias("bucket"), "text"
    )
    follow = with_words(follow, "text", "words").select("bucket", F.struct("text", "words").alias("head"))
    return with_lead.join(follow, "bucket").withColumn("next", F.coalesce("lead", "head")).drop("lead", "head", "bucket")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside its edited text: the last floor(n / 2) code points replaced by the first
    as many (or all) of the next text in descending id order (after the last: the first).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty; null ids come last; rows with one id follow each
    other by a hash of their text, and each gives a row. One row alone is its own next.
    One shuffle, by id range."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    buckets = max(MIN_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _with_next(rows, buckets).withColumn("n_chars", F.char_length("text"))
    half = F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), half), F.substring(F.col("next.text"), F.lit(1), F.col("n_chars") - half)))
    rows = with_words(rows, "edited", "edited_words")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("words")).alias("fingerprint"),
        as_text(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
        likeness(F.col("words"), F.col("next.words")).alias("near_next"),
    )
