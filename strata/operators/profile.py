"""Profiling aggregates: label distribution, feature-matrix statistics, train profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import POS_WEIGHT_EPS
from strata.operators.prep import label_counts


def label_distribution(df: DataFrame, label_cols: list[str], names: list[str] | None = None) -> DataFrame:
    """AGG1: per label positives, negatives and positive ratio (one wide aggregate);
    labels are called by ``names`` (default: their columns)."""
    names = names or label_cols
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label") + 1)
    return label_counts(df, label_cols).select(
        "label",
        name.alias("label_name"),
        "positive",
        "negative",
        (F.col("positive") / (F.col("positive") + F.col("negative"))).alias("ratio"),
    )


def show_label_distribution(df: DataFrame, label_cols: list[str]) -> None:
    """AGG2: formatted listing."""
    label_distribution(df, label_cols).orderBy("label").show(truncate=False)


def _feature_aggs(features: list[str]) -> list:
    aggs = []
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
        aggs += [
            F.sum(x).alias(f"s{i}"),
            F.sum(x * x).alias(f"q{i}"),
            F.max(F.isnan(x)).alias(f"nan{i}"),
            F.max(F.abs(x) == F.lit(float("inf"))).alias(f"inf{i}"),
        ]
    return aggs


def _feature_stat_exprs(n_features: int) -> dict:
    total = F.col("n_rows") * F.lit(n_features)
    s = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(n_features)])
    q = reduce(lambda a, b: a + b, [F.col(f"q{i}") for i in range(n_features)])
    mean = s / total
    var = F.greatest(q / total - mean * mean, F.lit(0.0))
    var = F.when(F.isnan(mean), F.lit(float("nan"))).otherwise(var)
    return {
        "n_rows": F.col("n_rows"),
        "n_features": F.lit(n_features).cast("long"),
        "mean": mean,
        "std": F.sqrt(var),
        "has_nan": F.coalesce(F.greatest(*[F.col(f"nan{i}") for i in range(n_features)]), F.lit(False)),
        "has_inf": F.coalesce(F.greatest(*[F.col(f"inf{i}") for i in range(n_features)]), F.lit(False)),
    }


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """AGG3: statistics of the whole feature matrix as one row: rows, features,
    mean, population std, has_nan, has_inf. One aggregate pass over the wide
    table (pooled from per-feature sums, no unpivot). A null is treated as NaN
    and any NaN makes mean and std NaN, as with a dense float matrix."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *_feature_aggs(features))
    return wide.select(*[c.alias(k) for k, c in _feature_stat_exprs(len(features)).items()])


def train_profile(train_scaled: DataFrame, label_cols: list[str], features: list[str], names: list[str] | None = None) -> DataFrame:
    """AGG5: the training-split profile as one long table ``(section, name, value)``:
    label distribution, pos_weight and feature statistics of the scaled split.
    All of it comes from ONE wide aggregate over the split (one scan); the long
    rows are unpivoted from that single row."""
    label_aggs = [F.sum(F.col(c).cast("long")).alias(f"p{i}") for i, c in enumerate(label_cols)]
    wide = train_scaled.agg(F.count(F.lit(1)).alias("n_rows"), *label_aggs, *_feature_aggs(features))
    stats = _feature_stat_exprs(len(features))
    rows = []
    for i in range(len(label_cols)):
        name = F.lit((names or label_cols)[i])
        pos = F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("double")
        neg = F.col("n_rows").cast("double") - pos
        rows += [
            F.struct(F.lit("positive").alias("section"), name.alias("name"), pos.alias("value")),
            F.struct(F.lit("negative").alias("section"), name.alias("name"), neg.alias("value")),
            F.struct(F.lit("ratio").alias("section"), name.alias("name"), (pos / (pos + neg)).alias("value")),
            F.struct(F.lit("pos_weight").alias("section"), name.alias("name"), F.sqrt(neg / (pos + F.lit(POS_WEIGHT_EPS))).alias("value")),
        ]
    rows += [
        F.struct(F.lit("feature_stats").alias("section"), F.lit(k).alias("name"), c.cast("double").alias("value"))
        for k, c in stats.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def show_feature_stats(df: DataFrame, features: list[str]) -> None:
    """AGG4: formatted listing of AGG3."""
    feature_stats(df, features).show(truncate=False)
