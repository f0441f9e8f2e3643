"""Reads CSV files with quoted line breaks by many tasks each, whatever their size.

Spark's multi-line reader gives a file to one task, as only the quotes before a line break tell whether
a record ends there. Here the files are read as lines, in blocks of ``spark.sql.files.maxPartitionBytes``:
the parity of the quotes in all blocks before a block, and in the lines before a line, tells where
records begin; lines of one record are put together again, also across blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, first): the records of the files under ``path`` as they are written, without their final
    line break; ``first`` marks a file's first record. Blank lines between records are no records.

    One row per block is ordered over a file; lines are ordered inside a block alone. The lines are
    shuffled by block and, of records of several lines, once more by record."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),  # ids grow along a block
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    lines = lines.withColumn("odd", quotes % 2)

    over_file = Window.partitionBy("file").orderBy("block")  # one row per block
    before = over_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds"))
    opened = blocks.select("file", "block", (F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2).alias("open"))

    over_block = Window.partitionBy("file", "block").orderBy("at")
    earlier = F.coalesce(F.sum("odd").over(over_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumn("earlier", earlier).join(opened, ["file", "block"])
    marked = marked.withColumn("starts", ((F.col("earlier") + F.col("open")) % 2 == 0).cast("int"))
    marked = marked.withColumn("k", F.sum("starts").over(over_block))  # 0: goes on from an earlier block

    # the block and number of the last record that begins before a block; a file's first line begins one
    ends = marked.groupBy("file", "block").agg(F.max("k").alias("k"))
    last = F.last(F.when(F.col("k") > 0, F.struct(F.col("block").alias("b"), "k")), ignorenulls=True).over(before)
    carried = ends.select("file", "block", last.alias("carried"))
    placed = marked.join(carried, ["file", "block"]).select(
        "file", F.when(F.col("k") > 0, F.col("block")).otherwise(F.col("carried.b")).alias("b"),
        F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("carried.k")).alias("k"), "block", "at", "line",
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"])
    records = placed.groupBy("file", "b", "k").agg(F.array_join(parts, "\n").alias("record"))
    first = (F.col("b") == 0) & (F.col("k") == 1)
    return records.select("file", F.regexp_replace("record", "\r$", "").alias("record"), first.alias("first")).where("record != ''")


def read_large_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """SRC1 for large files: the rows that ``read_dataset_csv`` gives with ``schema`` (columns by position, RFC 4180
    quoting, quotes inside a field doubled), from files of any size by many tasks. A record that doesn't fit the schema fails."""
    records = csv_records(spark, path)
    if header:
        records = records.where(~F.col("first"))
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return records.select(F.from_csv("record", ddl, CSV_OPTIONS).alias("row")).select("row.*")
