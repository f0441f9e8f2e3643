"""Content-addressed text vectors: a text is encoded once, whatever rows and runs it occurs in.

A store is a folder of (digest, embedding) rows for one encoder and width. ``encode_unseen`` encodes
the distinct texts whose digest the store does not hold yet; ``stored_vectors`` joins the vectors to
rows. A run that dies half way leaves some whole files of right rows: the next one encodes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import EMBED_BATCH_SIZE, EMBED_DIM_TEXT
from strata.operators.embed import Encoder, encoder_embed, hashing_embed
from strata.sources.tables import path_exists

STORE_SCHEMA = "digest binary, embedding array<float>"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """(digest, embedding); no rows where nothing was stored."""
    return spark.read.schema(STORE_SCHEMA).parquet(store) if path_exists(spark, store) else spark.createDataFrame([], STORE_SCHEMA)


def encode_unseen(
    df: DataFrame, text_col: str, store: str, encoder: Encoder | str | None = None, dim: int = EMBED_DIM_TEXT, batch_size: int = EMBED_BATCH_SIZE,
) -> None:
    """Encode every distinct text of ``df`` that ``store`` lacks and add it; one writer at a time.

    Equal texts meet in one pre-aggregated row, so a text that a third of all rows hold is one row. The
    texts of a task are ordered by length, so that a batch pads little."""
    spark = df.sparkSession
    texts = df.select(text_digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    new = texts.join(read_store(spark, store).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("text").alias("text"))
    if encoder is None:
        vectors = hashing_embed(new, "text", dim=dim).select("digest", "embedding")
    else:
        vectors = encoder_embed(new.sortWithinPartitions(F.length("text")), "digest", "text", encoder, dim, batch_size)
    vectors.write.mode("append").parquet(store)


def stored_vectors(df: DataFrame, key_col: str, text_col: str, store: str) -> DataFrame:
    """EMB3: (key, embedding) for every row of ``df``; null where the store lacks the text. Only keys and
    digests meet the store: the texts are not shuffled, and a digest that very many rows hold is an
    ordinary join key, which adaptive execution splits."""
    rows = df.select(key_col, text_digest(F.col(text_col)).alias("_strata_digest"))
    held = read_store(df.sparkSession, store).withColumnRenamed("digest", "_strata_digest").withColumnRenamed("embedding", "_strata_vec")
    return rows.join(held, "_strata_digest", "left").select(key_col, F.col("_strata_vec").alias("embedding"))
