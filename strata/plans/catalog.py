"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the given parquet tables (through the fixture builders) and
runs over the whole tables. Doubles are rounded with ``r6`` so results compare
exactly against the DuckDB oracle in ``strata.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import r6
from strata.operators import prep, profile
from strata.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn

    return deco


def queries() -> dict[str, Query]:
    # import for side effects: each module registers its queries
    from strata.plans import catalog_analytics, catalog_models  # noqa: F401

    return dict(_REGISTRY)


def _f1_features(df: DataFrame) -> list[str]:
    return prep.numeric_columns(df, [fx.F1_KEY, *fx.F1_IDS, *fx.F1_LABELS])


def _round(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ PRJ / LIM / SMP


@register("numeric_projection")
def numeric_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = fx.metric_table(spark, sf_dir)
    return prep.project_features(f1, fx.F1_KEY, [*fx.F1_IDS, *fx.F1_LABELS])


@register("tiny_head")
def tiny_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = fx.metric_table(spark, sf_dir)
    return prep.head(f1.select(fx.F1_KEY, *_f1_features(f1), *fx.F1_LABELS), fx.F1_KEY, 1000)


@register("null_text_fill")
def null_text_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4 on all documents and rows without a text: ``prep.fill_text``, then counters."""
    filled = prep.fill_text(fx.document_texts(spark, sf_dir), "text")
    n = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c)))).cast("long")
    return filled.select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"), n(" ").alias("n_spaces"), n("\n").alias("n_newlines")
    )


@register("features_float32")
def features_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5: features in single precision, returned as the doubles that those values are."""
    f1 = fx.metric_table(spark, sf_dir)
    feats = _f1_features(f1)
    out = prep.to_float32(f1.select(fx.F1_KEY, *feats), feats)
    return out.select(fx.F1_KEY, *[(F.col(c).cast("double") / 3.0).alias(c) for c in feats])


@register("hash_sample")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = fx.metric_table(spark, sf_dir)
    return prep.hash_sample(f1.select(fx.F1_KEY, *_f1_features(f1)), fx.F1_KEY, n=100, min_rows=10)


# ------------------------------------------------------------------ SPL / SRC6


@register("stratified_split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.split_metric_table(spark, sf_dir).select(fx.F1_KEY, "split")


@register("split_label_rates")
def split_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_label_rates(fx.split_metric_table(spark, sf_dir), fx.F1_LABELS)


@register("sparse_split_rates")
def sparse_split_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPL1 on sparse label-sets (``strata='iterative'``): per label its rows in all splits, and whether every
    split holds its share of them within one row; ``all`` counts every row."""
    split = prep.stratified_split(fx.order_months(spark, sf_dir), "l_orderkey", fx.MONTH_LABELS, strata="iterative")
    split = split.withColumn("all", F.lit(1))
    per = prep.split_label_rates(split, [*fx.MONTH_LABELS, "all"]).groupBy("label").pivot("split", ["train", "val", "test"]).agg(F.first("positives"))
    total = F.col("train") + F.col("val") + F.col("test")
    share = {"train": 8, "val": 1, "test": 1}
    near = [F.abs(10 * F.col(c) - n * total) <= 10 for c, n in share.items()]
    names = F.element_at(F.array(*[F.lit(c) for c in [*fx.MONTH_LABELS, "all"]]), F.col("label") + 1)
    return per.na.fill(0).select(names.alias("label"), total.alias("n_rows"), (near[0] & near[1] & near[2]).alias("within_one"))


@register("batch_assignment")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = fx.split_metric_table(spark, sf_dir).select(fx.F1_KEY, "split")
    return prep.assign_batches(split, fx.F1_KEY, batch_size=2048, epoch=0)


@register("split_semi_join")
def split_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = prep.stratified_split(fx.text_table(spark, sf_dir), "doc_id", ["quality", "toxic"])
    train_keys = text.where(F.col("split") == "train").select("doc_id")
    vectors = fx.vector_table(spark, sf_dir).select("vec_id", "label")
    return prep.project_split(vectors, train_keys, "doc_id", other_key="vec_id")


# ------------------------------------------------------------------ SCL / WGT


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.split_metric_table(spark, sf_dir).where(F.col("split") == "train")


@register("scaler_fit")
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    return _round(prep.scaler_stats(train, _f1_features(train)), ["mean", "scale"])


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    f1s = fx.split_metric_table(spark, sf_dir)
    feats = _f1_features(f1s)
    model = prep.fit_scaler(f1s.where(F.col("split") == "train"), feats)
    return model.transform(f1s), feats


@register("scaled_features")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, feats = _scaled(spark, sf_dir)
    return _round(scaled.select(fx.F1_KEY, "split", *feats), feats)


@register("pos_weight")
def pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prep.pos_weight(_train(spark, sf_dir), fx.F1_LABELS), ["pos_weight"])


@register("effective_number_weights")
def effective_number_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prep.effective_number_weights(_train(spark, sf_dir), fx.F1_LABELS), ["w_pos", "w_neg"])


@register("onehot_weights")
def onehot_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prep.onehot_weights(fx.vector_table(spark, sf_dir), "label"), ["w_pos", "w_neg"])


# ------------------------------------------------------------------ AGG


@register("label_distribution")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.label_distribution(fx.metric_table(spark, sf_dir), fx.F1_LABELS), ["ratio"])


@register("feature_stats")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = fx.metric_table(spark, sf_dir)
    return _round(profile.feature_stats(f1, _f1_features(f1)), ["mean", "std"])


@register("train_profile")
def train_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, feats = _scaled(spark, sf_dir)
    prof = profile.train_profile(scaled.where(F.col("split") == "train"), fx.F1_LABELS, feats)
    value = F.when(F.col("section").isin("ratio", "pos_weight") | (F.col("name").isin("mean", "std")), r6("value")).otherwise(
        F.col("value")
    )
    return prof.select("section", "name", value.alias("value"))
