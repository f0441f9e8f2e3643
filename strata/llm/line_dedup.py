"""Line dedup on content-defined line chunks, in DataFrame functions only.

A rolling hash over each line and the one before it picks the boundaries: a chunk ends after a
line whose rolling hash is smaller than its two neighbours' (so boundaries depend on the lines
around them alone and survive insertions above), and a line of ``LONG_WORDS`` words or more is
a chunk of its own. A passage of few lines may hold no whole chunk, so there is a finer level:
from every line with a word the shortest run of lines of ``LONG_WORDS`` words, and the shortest
one that ends there. Every repeated run of whole lines with that many words is covered by them.
Chunks and runs are spans of lines. Of the spans that occur more than once in the corpus the
first occurrence stays; the lines of the others go once their bytes have been compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.sources.tables import write_shared_table

#: A chunk can be removed if it has two lines and MIN_WORDS words at least, or one line of LONG_WORDS.
MIN_WORDS, LONG_WORDS = 10, 50
WORD = r"[^\x20\x09-\x0D]+"
#: A span is one number: first line * SPAN + number of lines.
SPAN = 1 << 32


def _cut_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_lines``, ``_hashes``, ``_words`` (of each line) and ``_cuts`` (last line of each chunk).

    Each step is a column of its own: what a lambda refers to is then computed once per row,
    not once per element."""
    rows = docs.withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    rows = rows.withColumn("_hashes", F.transform("_lines", F.md5))
    rows = rows.withColumn("_rolls", F.transform("_hashes", lambda h, i: F.md5(F.concat(F.when(i > 0, F.get("_hashes", i - 1)).otherwise(""), h))))
    rows = rows.withColumn("_words", F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD))))

    def is_end(roll: Column, i: Column) -> Column:
        low = (roll < F.get("_rolls", i - 1)) & (roll < F.get("_rolls", i + 1))
        long = (F.get("_words", i) >= LONG_WORDS) | (F.get("_words", i + 1) >= LONG_WORDS)
        return F.coalesce(low, F.lit(False)) | F.coalesce(long, F.lit(False)) | (i == F.size("_rolls") - 1)

    ends = F.transform("_rolls", lambda roll, i: F.when(is_end(roll, i), i))
    return rows.withColumn("_cuts", F.filter(ends, lambda i: i.isNotNull())).drop("_rolls")


def _chunk(end: Column, k: Column) -> Column:
    first = F.when(k > 0, F.get("_cuts", k - 1) + 1).otherwise(0)
    size = end - first + 1
    words = F.aggregate(F.slice("_words", first + 1, size), F.lit(0), lambda a, x: a + x)
    return F.struct(first.alias("first"), size.alias("n_lines"), words.alias("words"))


def line_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``chunks``: array of (first, n_lines, words, text), in order;
    their texts joined by line breaks are the document's text."""
    rows = _cut_lines(docs).withColumn("chunks", F.transform("_cuts", _chunk))
    text = lambda x: F.array_join(F.slice("_lines", x["first"] + 1, x["n_lines"]), "\n")
    return rows.withColumn("chunks", F.transform("chunks", lambda x: x.withField("text", text(x)))).drop("_lines", "_hashes", "_words", "_cuts")


def _removable(x: Column) -> Column:
    return ((x["n_lines"] >= 2) & (x["words"] >= MIN_WORDS)) | (x["words"] >= LONG_WORDS)


def _reach(counts: Column) -> Column:
    """How many of ``counts`` (each 1 or more) add up to LONG_WORDS; null if all don't."""
    return F.aggregate(
        counts, F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.when(a["s"] >= LONG_WORDS, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))),
        lambda a: F.when(a["s"] >= LONG_WORDS, a["n"]),
    )


def _run_length(k: Column, back: bool) -> Column:
    """Lines of the shortest run of LONG_WORDS words that starts (``back``: ends) at the k-th line
    with a word: LONG_WORDS such lines always suffice; most runs need a few, which are tried first."""

    def upto(n: int) -> Column:
        if not back:
            return _reach(F.slice("_n", k + 1, F.lit(n)))
        size = F.least(k + 1, F.lit(n))
        return _reach(F.reverse(F.slice("_n", k + 2 - size, size)))

    return F.when(F.get("_n", k) >= LONG_WORDS, 1).otherwise(F.coalesce(upto(6), upto(LONG_WORDS)))


def _pack(first: Column, size: Column) -> Column:
    return first.cast("long") * SPAN + size


def _first(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _size(span: Column) -> Column:
    return (span % SPAN).cast("int")


def _given(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) that computes ``value`` once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def line_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (span, h), every removable chunk and every shortest run of
    LONG_WORDS words from or to a line with a word, each span once; h hashes its lines."""
    rows = _cut_lines(docs)
    rows = rows.withColumn("_at", F.filter(F.transform("_words", lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("_n", F.transform("_at", lambda i: F.get("_words", i)))
    at = lambda k: F.get("_at", k)
    on = F.transform("_at", lambda i, k: _given(_run_length(k, False), lambda n: _pack(i, at(k + n - 1) - i + 1)))
    back = F.transform("_at", lambda i, k: _given(_run_length(k, True), lambda n: _pack(at(k - n + 1), i - at(k - n + 1) + 1)))
    chunks = F.transform(F.filter(F.transform("_cuts", _chunk), _removable), lambda x: _pack(x["first"], x["n_lines"]))
    rows = rows.withColumn("_spans", F.filter(F.array_distinct(F.concat(chunks, on, back)), lambda x: x.isNotNull()))
    h = lambda x: F.xxhash64(F.slice("_hashes", _first(x) + 1, _size(x)))
    rows = rows.withColumn("spans", F.transform("_spans", lambda x: F.struct(x.alias("span"), h(x).alias("h"))))
    return rows.drop("_lines", "_hashes", "_words", "_cuts", "_at", "_n", "_spans")


def _lines_of(span: Column) -> Column:
    """Its lines of ``_lines``: fewer, or none, where a text is shorter than the span's own."""
    return F.slice("_lines", _first(span) + 1, _size(span))


def _has(x: Column) -> Column:
    """Whether the text in ``_lines`` has span ``x`` (span, h): rows of one id may differ in text."""
    return F.xxhash64(F.transform(_lines_of(x["span"]), F.md5)) == x["h"]


def _with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, span, h) of every span of (doc_id, text) rows that repeats an earlier one byte for
    byte: earlier by (doc_id, first line).

    The bytes of all spans with one hash are compared by their least and greatest text. Where the two
    differ, unlike spans share the hash, and its spans are grouped anew by hash and text."""
    # outer explodes: from others the optimizer infers a filter on the array's size, and pushes it, with
    # the whole chunking in place of every mention of a step, down to the scan
    spans = line_spans(rows.where("doc_id is not null")).select("doc_id", F.explode_outer("spans").alias("x")).where("x is not null")
    marks = write_shared_table(spans.select("doc_id", "x.span", "x.h"), "line-spans")
    repeated = marks.groupBy("h").agg(F.min(F.struct("doc_id", "span")).alias("keep"), F.max(F.struct("doc_id", "span")).alias("last")).where("keep != last")
    repeated = write_shared_table(repeated.select("h", "keep"), "line-repeated")  # a plain shuffle on either side: a hot span can be split
    pairs = marks.join(repeated, "h").select("doc_id", "span", "h", (F.struct("doc_id", "span") == F.col("keep")).alias("kept"))
    pairs = write_shared_table(pairs, "line-pairs")
    wanted = pairs.groupBy("doc_id").agg(F.collect_set(F.struct("span", "h")).alias("wanted"))
    # texts are made before the explode: the rows of a document then don't copy all of its lines
    text = lambda x: x.withField("text", F.array_join(_lines_of(x["span"]), "\n"))
    found = _with_lines(rows.join(wanted, "doc_id")).select("doc_id", F.explode_outer(F.transform(F.filter("wanted", _has), text)).alias("x"))
    found = found.where("x is not null").select("doc_id", "x.span", "x.h", "x.text")
    unlike = found.groupBy("h").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least != most")
    unlike = write_shared_table(unlike.select("h"), "line-unlike")
    gone = pairs.where("not kept").select("doc_id", "span", "h")
    if unlike.isEmpty():
        return gone.distinct()
    again = found.join(unlike, "h")
    keeper = write_shared_table(again.groupBy("h", "text").agg(F.min(F.struct("doc_id", "span")).alias("keep")), "line-kept")
    again = again.join(keeper, ["h", "text"]).where(F.struct("doc_id", "span") != F.col("keep"))
    return gone.join(unlike, "h", "left_anti").unionByName(again.select("doc_id", "span", "h")).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text after the removal: columns as they were, then
    ``_n_removed``, the number of lines that went.

    A line goes if it lies in a chunk or run that repeats an earlier one, byte for byte; an equal
    line always stays at an earlier place. So every run of whole lines with LONG_WORDS words or more that
    occurs twice is kept once; spans may overlap, so of a line that fills such a run alone one copy stays.
    A text that repeats nothing comes back byte for byte; a null text stays null and has no
    span to remove; rows with a null id are left alone. Rows with the same id and text are one
    document (they don't remove each other); ties go to the smaller id, then the earlier place.
    Texts of which every line goes become empty.

    Shuffles: span hashes (pre-aggregated), the texts by id twice (bytes to compare, and
    the rewrite). A span that very many documents share is one pre-aggregated row where it is
    counted and compared, and an ordinary equi-join key, which adaptive execution splits, elsewhere."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = repeated_spans(rows).groupBy("doc_id").agg(F.collect_list(F.struct("span", "h")).alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    names = docs.columns
    base = docs.toDF(*(f"in_{k}" for k in range(len(names))))
    where = {c: F.col(f"in_{k}") for k, c in enumerate(names)}
    joined = base.join(gone, where[id_col].cast("long") == F.col("_gone_id"), "left")
    # only texts that may lose a span are cut again
    joined = _with_lines(joined.withColumn("text", F.when(F.col("_gone").isNotNull(), where[text_col].cast("string"))))
    lines = F.flatten(F.transform(F.filter("_gone", _has), lambda x: F.sequence(_first(x["span"]), _first(x["span"]) + _size(x["span"]) - 1)))
    out = joined.withColumn("_out", F.when(where[text_col].isNotNull(), F.array_distinct(lines)))
    out = out.withColumn("_left", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_out")))
    result = F.struct(
        F.when(F.size("_out") > 0, F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n")).otherwise(where[text_col]).alias("_text"),
        F.when(F.size("_out") > 0, F.size("_out")).otherwise(0).alias("_n_removed"),
    )
    # a generator of one row: filters on the results stay above it, or the optimizer would put the
    # whole rewriting in place of every mention of them
    out = out.select(*where.values(), F.inline(F.array(result)))
    return out.select(*((F.col("_text") if c == text_col else where[c]).alias(c) for c in names), "_n_removed")


#: The same rows in SQL (doc_id, n_removed, text); ids and texts without nulls.
SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, md5(line) AS h, len(regexp_extract_all(line, '{WORD}')) AS words
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)
), rolls AS (
  SELECT *, md5(coalesce(lag(h) OVER d, '') || h) AS roll, sum(words) OVER d AS upto FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), ends AS (
  SELECT *, CAST(coalesce(roll < lag(roll) OVER d AND roll < lead(roll) OVER d, false)
      OR words >= {LONG_WORDS} OR coalesce(lead(words) OVER d >= {LONG_WORDS}, true) AS INTEGER) AS is_end
  FROM rolls WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ends
), wordy AS (
  SELECT doc_id, i, upto, upto - words AS prior FROM rolls WHERE words > 0
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) AS b FROM numbered GROUP BY doc_id, pos
  HAVING (count(*) >= 2 AND sum(words) >= {MIN_WORDS}) OR sum(words) >= {LONG_WORDS}
  UNION SELECT x.doc_id, x.i, y.i FROM wordy x ASOF JOIN wordy y ON x.doc_id = y.doc_id AND x.prior + {LONG_WORDS} <= y.upto
  UNION SELECT x.doc_id, y.i, x.i FROM wordy x ASOF JOIN wordy y ON x.doc_id = y.doc_id AND x.upto - {LONG_WORDS} >= y.prior
), gone AS (
  SELECT doc_id, a, b FROM spans JOIN documents USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY array_to_string(string_split(text, chr(10))[a:b], chr(10)) ORDER BY doc_id, a) > 1
), gone_lines AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM gone
)
SELECT l.doc_id, CAST(count(g.i) AS INTEGER) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
FROM lines l LEFT JOIN gone_lines g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
