"""Staged corpus pipeline over ``documents``: each stage calls one operator of ``strata.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.line_dedup import line_dedup
from strata.llm.mixing import in_mix_order, mix_sources
from strata.llm.ngram_join import keep_one
from strata.llm.quality import keep_good
from strata.llm.queries import byte_bpe
from strata.sources.tables import in_stored_order, read_table, write_shared_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks (``n_chars`` follows the text). A document of which
    nothing is left consisted of passages whose first copies stay elsewhere, and goes."""
    names = docs.columns
    rows = line_dedup(docs).toDF(*(f"c{k}" for k in range(len(names))), "removed")
    col = {c: F.col(f"c{k}") for k, c in enumerate(names)}
    changed = F.col("removed") > 0
    n_chars = F.when(changed, F.char_length(col["text"]).cast("long")).otherwise(col["n_chars"])
    out = col | ({"n_chars": n_chars} if "n_chars" in col else {})
    return rows.where(~changed | (col["text"] != "")).select(*(out[c].alias(c) for c in names))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word n-grams, similarity 0.8)."""
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix over the written files."""
    return in_mix_order(mix_sources(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes, as one stream in the order
    in which the mix stored the documents: ``start`` counts the ids of all documents before."""
    placed = in_stored_order(docs.select("doc_id", "text"))
    encoded = byte_bpe(placed, keep_ids=True, id_col="_place").withColumnRenamed("doc_id", "_place")
    encoded = write_shared_table(encoded, "encoded")  # its lengths come before its starts
    lengths = encoded.select("_place", "n_tokens").withColumn("_part", F.shiftright("_place", 40))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = lengths.groupBy("_part").agg(F.sum("n_tokens").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # the rows of a file
    starts = lengths.join(F.broadcast(files), "_part").select(
        "_place", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    )
    return placed.select("_place", F.col("doc_id").cast("long").alias("doc_id")).join(starts, "_place").join(encoded, "_place").drop("_place")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Compression ratios and tokenizer merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and reread by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared_table(docs, f"pipeline-{k}")
    return docs
