"""Run / experiment analytics over a metric log ``(run, epoch, metric, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import CROSS_TYPES, DEEP_TYPES, PATIENCE
from strata.operators.prefix import Running, running_aggregates


def seed_summary(results: DataFrame, run_col: str = "run", metric_col: str = "metric", value_col: str = "value", min_runs: int = 2) -> DataFrame:
    """RUN1: per metric the mean and population std over runs (seeds) of each
    run's result (mean value of the run), shown when at least ``min_runs`` runs."""
    per_run = results.groupBy(run_col, metric_col).agg(F.avg(value_col).alias("_v"))
    return (
        per_run.groupBy(metric_col)
        .agg(F.count(F.lit(1)).alias("n_runs"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
        .where(F.col("n_runs") >= min_runs)
    )


def early_stopping(
    log: DataFrame,
    run_col: str = "run",
    epoch_col: str = "epoch",
    value_col: str = "value",
    patience: int = PATIENCE,
    epoch_bucket: int = 1024,
) -> DataFrame:
    """RUN2: best epoch and early-stop epoch per run: an epoch improves when its
    value is strictly above the best of all earlier epochs (starting at 0); the
    run stops at the first epoch that is ``patience`` epochs after the last
    improvement. Output ``(run, best_epoch, best_value, stop_epoch, n_epochs)``;
    ``stop_epoch`` is NULL when patience never ran out, ``best_epoch`` NULL when
    nothing improved.

    One running aggregate: the last strict improvement at or before epoch ``e``
    is the FIRST epoch reaching the running maximum (when that maximum is above
    0), so a running ``max(struct(value, -epoch))`` gives both the best value
    and the last-improvement epoch. It uses the two-level prefix (epochs
    bucketed by ``epoch div epoch_bucket``), so a run with a very long log is not
    one task; one grouped aggregate then reads the best epoch at the stop
    epoch (``min_by``) or, without a stop, at the end of the run."""
    bucket = (F.col(epoch_col) / F.lit(epoch_bucket)).cast("long")
    v, e = F.col(value_col), F.col(epoch_col)
    rec = F.when(v.isNotNull(), F.struct(v.alias("v"), (-e).alias("ne")))
    running = running_aggregates(
        log.select(run_col, epoch_col, value_col),
        [run_col],
        [e],
        bucket,
        [Running("_m", "max", rec, inclusive=True)],
    )
    improved_once = F.col("_m.v") > F.lit(0.0)
    last_imp = F.when(improved_once, -F.col("_m.ne"))
    since = e - F.coalesce(last_imp, F.lit(0))
    flagged = running.withColumn("_stop", F.when(since >= F.lit(patience), e))
    per_run = flagged.groupBy(run_col).agg(
        F.min("_stop").alias("stop_epoch"),
        F.count(F.lit(1)).alias("n_epochs"),
        # wrapped, so a stop before any value (NULL running max) stays distinct from no stop
        F.min_by(F.struct(F.col("_m").alias("m")), "_stop").alias("_at_stop"),
        F.max("_m").alias("_at_end"),
    )
    # best epoch = last improvement at or before the stop epoch (or the run's end)
    b = F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop.m")).otherwise(F.col("_at_end"))
    ok = b.getField("v") > F.lit(0.0)
    return per_run.select(
        run_col,
        F.when(ok, -b.getField("ne")).cast(log.schema[epoch_col].dataType).alias("best_epoch"),
        F.when(ok, b.getField("v")).alias("best_value"),
        "stop_epoch",
        "n_epochs",
    )


def config_grid(cross_types: Sequence[str] = CROSS_TYPES, deep_types: Sequence[str] = DEEP_TYPES) -> list[tuple[int, str, str]]:
    """RUN3: the cartesian product of the options, numbered (driver-side, tiny)."""
    return [(i * len(deep_types) + j, c, d) for i, c in enumerate(cross_types) for j, d in enumerate(deep_types)]


def run_name(*cols: str) -> F.Column:
    """RUN5: run name from its parameters."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def experiment_summary(
    results: DataFrame,
    run_col: str = "run",
    value_col: str = "value",
    cross_types: Sequence[str] = CROSS_TYPES,
    deep_types: Sequence[str] = DEEP_TYPES,
) -> DataFrame:
    """RUN3-RUN5 over logged runs: run ``r`` belongs to grid cell ``r mod cells``
    with seed index ``r div cells``; per cell: the run name, number of runs and
    the mean / population std of the runs' results. The option grid (cells rows)
    is broadcast."""
    grid = config_grid(cross_types, deep_types)
    cells = len(grid)
    opts = F.inline(
        F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(c).alias("cross_type"), F.lit(d).alias("deep_type")) for i, c, d in grid])
    )
    spark = results.sparkSession
    options = spark.range(1).select(opts)
    per_run = results.groupBy(run_col).agg(F.avg(value_col).alias("_v")).withColumn(
        "cell", (F.col(run_col) % F.lit(cells)).cast("int")
    )
    per_cell = per_run.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std")
    )
    return F.broadcast(options).join(per_cell, "cell", "left").select(
        "cross_type",
        "deep_type",
        run_name("cross_type", "deep_type").alias("run_name"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        "mean",
        "std",
    )
