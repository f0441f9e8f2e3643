"""Sources and sinks: table loading, dataset CSV, path resolution, split cache, metric log."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder, recorded for ``drop_shared_tables``."""
    from strata.session import ensure_checkpoint_dir

    path = os.path.join(ensure_checkpoint_dir(spark), "strata-tables", f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def write_shared_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as parquet into the shared checkpoint folder
    (``spark.checkpoint.dir``) and return the table read back.

    A lineage cut for data that several jobs of one query reuse: it is computed
    once, later scans get column pruning, pushed filters and (with
    ``partition_by``) partition pruning, and a lost executor costs a re-read of
    the written files instead of a recomputation from the sources."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # an empty table has no file to take a schema from


def in_stored_order(df: DataFrame) -> DataFrame:
    """``df`` with ``_part`` (long) and ``_place`` (long): the number of its row's file, in the order of the names
    that Spark gives, and a number that grows with the row's position over all files. So a table written in an
    order is read in that order, however its files are dealt to tasks. Rows that don't come from files are
    written first."""
    try:
        rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        df = write_shared_table(df, "stored-order")
        rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    by_name = Window.orderBy(F.length("_file"), "_file")  # a row a file
    files = rows.select("_file").distinct().select("_file", (F.row_number().over(by_name) - 1).cast("long").alias("_part"))
    place = F.shiftleft("_part", 40) + F.col("_row")
    return rows.join(F.broadcast(files), "_file").select(*[F.col(c) for c in df.columns], "_part", place.alias("_place"))


_NAMED: list[str] = []


def write_bucketed(df: DataFrame, name: str, key_col: str, n_buckets: int | None = None) -> str:
    """SRC3/SRC7: store ``df`` in buckets of ``key_col`` (one sorted file each) as a table in the shared folder;
    returns the table's name for ``spark.table``. Tables with equal bucket counts join on the key without an
    exchange, however often. ``n_buckets`` defaults to ``spark.sql.shuffle.partitions``; rows of one key stay
    in one bucket, so the key should not be skewed (a unique id is not)."""
    spark = df.sparkSession
    n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"strata_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key_col).write.bucketBy(n, key_col).sortBy(key_col)
    writer.option("path", shared_folder(spark, name)).format("parquet").saveAsTable(table)
    _NAMED.append(table)
    return table


def bucketed_join(left: DataFrame, right: DataFrame, key_col: str, how: str = "inner") -> DataFrame:
    """SRC7: join of two ``write_bucketed`` tables on their key, bucket by bucket."""
    return left.join(right.hint("merge"), key_col, how)


def drop_shared_tables(spark: SparkSession) -> int:
    """Delete the tables ``write_shared_table`` wrote in this process (call it
    once the queries reading them have run); returns how many were removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _NAMED:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop()}")
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def resolve_path(candidates: Sequence[str]) -> str:
    """SRC2: first existing candidate (mounted path, then local copy). Remote
    URIs (``scheme://``) are returned as given and left to the reader."""
    for path in candidates:
        if "://" in path or os.path.exists(path):
            return path
    raise FileNotFoundError(f"none of the dataset paths exist: {list(candidates)}")


def read_dataset_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """SRC1: dataset CSV with header, quoted multi-line text and inferred (or given)
    types. Pass ``schema`` in production: inference costs a full extra scan."""
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_dataset_csv(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 50_000) -> None:
    """SRC1 writer side: files of at most ``rows_per_file`` rows (a multi-line file is read by one
    task), header, RFC 4180 quoting (a quote inside a field is
    doubled, fields with quotes, delimiters or line breaks are quoted) and
    whitespace kept as is, so ``read_dataset_csv`` reads every text back
    unchanged."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("maxRecordsPerFile", rows_per_file)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_split_cache(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """SRC3: persist a prepared table (scaled features, embeddings, labels) as
    parquet partitioned by split, so a later reader prunes to one split."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def read_split_cache(
    spark: SparkSession,
    path: str,
    array_cols: Sequence[str] = ("features", "embedding", "labels"),
    splits: Sequence[str] = ("train", "val", "test"),
    split_col: str = "split",
) -> DataFrame:
    """SRC4: read the split cache back and validate it in one aggregate job:
    all splits present, no null arrays and one constant width per array column
    (the equal-length check of the per-split cache files). Raises ValueError."""
    df = spark.read.parquet(path)
    present = [c for c in array_cols if c in df.columns]
    checks = [F.collect_set(split_col).alias("_splits")]
    for c in present:
        checks += [
            F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"{c}__nulls"),
            F.min(F.size(c)).alias(f"{c}__min"),
            F.max(F.size(c)).alias(f"{c}__max"),
        ]
    row = df.agg(*checks).first()
    missing = sorted(set(splits) - set(row["_splits"] or []))
    if missing:
        raise ValueError(f"split cache at {path} is missing splits: {missing}")
    for c in present:
        if row[f"{c}__nulls"]:
            raise ValueError(f"split cache column {c} has {row[f'{c}__nulls']} null rows")
        if row[f"{c}__min"] != row[f"{c}__max"]:
            raise ValueError(f"split cache column {c} has widths {row[f'{c}__min']}..{row[f'{c}__max']}")
    return df


LOG_SCHEMA = "run long, seed long, epoch long, metric string, value double"
LOG_KEY = ["run", "seed"]


def write_metric_records(df: DataFrame, path: str) -> str:
    """SRC5, first step: the records ``(run, seed, epoch, metric, value)`` of a new attempt, named by the
    returned id. Readers don't see them before ``commit_metric_records``."""
    attempt = uuid.uuid4().hex
    records = df.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(LOG_SCHEMA)])
    records.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/records/attempt={attempt}")
    return attempt


def commit_metric_records(spark: SparkSession, path: str, attempt: str) -> None:
    """SRC5, last step: one commit row per (run, seed) of the attempt, taken from the written records. Commits are
    numbered; of equal numbers (attempts committed at once) the greater attempt id counts."""
    path = path.rstrip("/")
    number = 1 + (_commits(spark, path).agg(F.max("number")).first()[0] or 0)
    keys = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/records/attempt={attempt}").select(*LOG_KEY).distinct()
    keys.select(*LOG_KEY, F.lit(number).cast("long").alias("number"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{path}/commits")


def write_metric_log(df: DataFrame, path: str) -> None:
    """SRC5: write the records of whole runs so that a run repeated, or killed at any point, leaves one set of
    records: each (run, seed) of ``df`` replaces what was committed for it before, once its commit row is written.
    Runs that are not in ``df`` stay. Null runs and seeds are runs of their own."""
    commit_metric_records(df.sparkSession, path, write_metric_records(df, path))


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the records of the last commit of every (run, seed); empty where nothing was committed."""
    path = path.rstrip("/")
    last = _commits(spark, path).groupBy(*LOG_KEY).agg(F.max(F.struct("number", "attempt"))["attempt"].alias("attempt"))
    if not path_exists(spark, f"{path}/records"):
        return spark.createDataFrame([], LOG_SCHEMA)
    records = spark.read.schema(f"{LOG_SCHEMA}, attempt string").option("basePath", f"{path}/records").parquet(f"{path}/records").alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*LOG_KEY, "attempt"]]
    return records.join(last.alias("c"), same[0] & same[1] & same[2], "left_semi").drop("attempt")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join([*LOG_SCHEMA.split(", ")[: len(LOG_KEY)], "number long", "attempt string"])
    return spark.read.schema(schema).parquet(f"{path}/commits") if path_exists(spark, f"{path}/commits") else spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on the file system that its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_metric_log(df: DataFrame, path: str) -> None:
    """SRC5: append metric records ``(run, seed, epoch, metric, value)`` to a parquet log."""
    cols = ["run", "seed", "epoch", "metric", "value"]
    df.select(*cols).write.mode("append").parquet(path)
