"""Session helpers: a tuned local session for tests/bench and lineage cutting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """Session for tests and the bench. On a cluster, build the session with the
    cluster's own settings and only the SQL options below."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. A folder of this machine is made only when the session
    has none and runs in this process (``local`` masters: tests, laptops); elsewhere executors
    couldn't see it, so a missing setting raises RuntimeError."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = local_fallback(sc.master)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_fallback(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\],]+(,\s*\d+)?\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    return tempfile.mkdtemp(prefix="strata-ckpt-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder, so lost executors
    recompute from the checkpoint rather than from the source scan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of ``df`` dealt evenly over as many tasks as a shuffle has (at least one per core):
    work by row on a file with few row groups would otherwise run in as few tasks as those. ``by`` names a
    column of hashes of unique keys, which deals without the sort that dealing in turn needs; it is dropped."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, by).drop(by) if by else df.repartition(n)
