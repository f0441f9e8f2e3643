"""Registered queries: metrics, curves, thresholds, losses, gates and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import r6
from strata.operators import curves, metrics, thresholds
from strata.plans import fixtures as fx
from strata.plans.catalog import _round, register
from strata.sources.tables import write_shared_table


def _scored(spark: SparkSession, sf_dir: str, *splits: str | None) -> DataFrame | list[DataFrame]:
    """F2 rows of the given splits (``None``: all rows), one DataFrame per split. The split is
    a projection of the scan (its cut points are found once per call), so nothing is written."""
    s = fx.scored_table(spark, sf_dir)
    out = [s if sp is None else s.where(F.col("split") == sp) for sp in splits]
    return out[0] if len(out) == 1 else out


# ------------------------------------------------------------------ MET


@register("confusion_matrix")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _scored(spark, sf_dir, "val", "test")
    return metrics.confusion(test, thresholds.tune_grid(val))


@register("f1_micro_macro")
def f1_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.f1_micro_macro(_scored(spark, sf_dir, "val")), ["f1_micro", "f1_macro"])


@register("precision_recall_macro")
def precision_recall_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.precision_recall_macro(_scored(spark, sf_dir, "val")), ["precision_macro", "recall_macro"])


@register("metric_bundle")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.metric_bundle(_scored(spark, sf_dir, "val"))
    return _round(out, out.columns)


@register("per_label_report")
def per_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.per_label_report(_scored(spark, sf_dir, "test"))
    return _round(out, ["auc", "f1", "precision", "recall"])


# ------------------------------------------------------------------ CRV / MET6-7


@register("auc_per_label")
def auc_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curves.auc_per_label(_scored(spark, sf_dir, None)), ["auc"])


@register("auc_micro")
def auc_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curves.auc_pooled(_scored(spark, sf_dir, None)), ["auc"])


@register("roc_curve")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curves.roc_curve(_scored(spark, sf_dir, "test")), ["fpr", "tpr"])


@register("pr_curve")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curves.pr_curve(_scored(spark, sf_dir, "test")), ["precision", "recall"])


@register("average_precision")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curves.average_precision(_scored(spark, sf_dir, "test")), ["ap"])


@register("curve_chart")
def curve_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(curves.curve_chart(_scored(spark, sf_dir, "test")), ["x", "y", "area"])


@register("curve_chart_bounded")
def curve_chart_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRV6 with at most four points in each hundredth of the x axis, and the vertical error there."""
    exact = _round(curves.curve_chart(_scored(spark, sf_dir, "test")), ["x", "y", "area"])
    return _round(curves.bounded_chart(exact), ["y_error"])


# ------------------------------------------------------------------ THR


@register("threshold_grid")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(thresholds.tune_grid(_scored(spark, sf_dir, "val")), ["f1"])


@register("threshold_roc_youden")
def threshold_roc_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.tune_roc(_scored(spark, sf_dir, "val"), "youden")


@register("threshold_roc_topleft")
def threshold_roc_topleft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.tune_roc(_scored(spark, sf_dir, "val"), "closest_topleft")


@register("threshold_eval")
def threshold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _scored(spark, sf_dir, "val", "test")
    out = thresholds.evaluate_thresholds(test, thresholds.tune_grid(val))
    return _round(out, out.columns)


@register("threshold_compare")
def threshold_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _scored(spark, sf_dir, "val", "test")
    out = thresholds.compare_methods(val, test, methods=("grid_search", "roc_youden"))
    return _round(out, [c for c in out.columns if c != "method"])


@register("threshold_compare_all")
def threshold_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three methods, the simplex included (rows-only: the simplex has no SQL form), with
    the thresholds each one chose."""
    val, test = _scored(spark, sf_dir, "val", "test")
    out = thresholds.compare_methods(val, test)
    return _round(out, [c for c in out.columns if c != "method"])


@register("threshold_coarse")
def threshold_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(thresholds.tune_coarse(_scored(spark, sf_dir, "val")), ["f1"])


@register("threshold_simplex")
def threshold_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thresholds.tune_simplex(_scored(spark, sf_dir, "val"), "f1_macro", n_iterations=30)
    return out.select("label", r6("threshold").alias("threshold"))


# ------------------------------------------------------------------ LOS

from strata.operators import gates, losses, prep, runs  # noqa: E402


def _loss_query(name: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = _scored(spark, sf_dir, None)
        # weights: train-split pos_weight (bce/focal/asl), train-split CB weights
        # (cb_focal, stored), CB weights of the whole table (cb, dynamic)
        rows = None if name == "cb" else F.col("split") == "train"
        return _round(losses.one_pass_loss(scored, name, weight_rows=rows), ["loss"])

    return q


for _name in losses.LOSSES:
    register(f"loss_{_name}")(_loss_query(_name))


@register("loss_cb_focal_dynamic")
def loss_cb_focal_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOS5 with the class-balanced weights of the scored table itself."""
    return _round(losses.one_pass_loss(_scored(spark, sf_dir, None), "cb_focal"), ["loss"])


@register("loss_cb_focal_ones")
def loss_cb_focal_ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOS5 where no weights are known: the fallback of ones."""
    return _round(losses.one_pass_loss(_scored(spark, sf_dir, None), "cb_focal", label_weights="ones"), ["loss"])


@register("loss_focal_sum")
def loss_focal_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOS6, sum reduction (in thousands, so that the last digits of two engines agree)."""
    out = losses.one_pass_loss(_scored(spark, sf_dir, "test"), "focal", reduction="sum", label_weights="ones")
    return out.select((F.round(F.col("loss") / 1000, 6) + F.lit(0.0)).alias("loss"), "n")


@register("loss_elements")
def loss_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOS6 without reduction: the ASL element loss of every scored row of the test split."""
    out = losses.reduce_loss(losses.element_loss(_scored(spark, sf_dir, "test"), "asl"), "none")
    return out.select("row_key", "label", r6("loss").alias("loss"))


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 score inputs with their split and epoch-0 batch, computed once and written to the
    shared folder."""
    batched = prep.assign_batches(fx.split_metric_table(spark, sf_dir).select(*fx.SCORE_INPUTS), fx.F1_KEY, batch_size=2048, epoch=0)
    return write_shared_table(batched, "f1-batches", ["split"])


def _loss_by_batch(name: str):
    """MET10: the reported loss of each split under a loss, the mean of its batch means."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = fx.scored_from(_batched(spark, sf_dir), ("batch_id",))
        out = losses.one_pass_loss(scored, name, weight_rows=F.col("split") == "train", batch_cols=["split", "batch_id"])
        return _round(out, ["loss"])

    return q


for _name in losses.LOSSES:
    register("loss_by_batch" if _name == "bce" else f"loss_by_batch_{_name}")(_loss_by_batch(_name))


# ------------------------------------------------------------------ GAT


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.gate_table(spark, sf_dir)


def _gate_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = prep.stratified_split(_gates(spark, sf_dir), "vec_id", ["label"])
    return g.where(F.col("split") == "val")


@register("gate_stats")
def gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.gate_stats(_gates(spark, sf_dir))
    return _round(out, out.columns)


@register("gate_stats_by_batch")
def gate_stats_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.gate_stats_by_batch(_gates(spark, sf_dir), "batch_id")
    return _round(out, [c for c in out.columns if c != "n_batches"])


@register("gate_stats_eval_batches")
def gate_stats_eval_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT2 on the seeded batches (SRC6) of the validation split, with the eval prefix."""
    batched = prep.assign_batches(_gate_val(spark, sf_dir), "vec_id", batch_size=16)
    out = gates.gate_stats_by_batch(batched, "batch_id", prefix="eval")
    return out.select(*[r6(f"`{c}`").alias(c) if "/" in c else F.col(c) for c in out.columns])


@register("gate_report")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT3 over the whole validation split."""
    out = gates.gate_report(_gate_val(spark, sf_dir), "vec_id")
    return _round(out, [c for c in out.columns if c != "n_rows"])


@register("gate_report_head")
def gate_report_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT3 + LIM2: the report of the first 20 validation rows in key order (the limit is the feature)."""
    out = gates.gate_report(_gate_val(spark, sf_dir), "vec_id", first_rows=20)
    return _round(out, [c for c in out.columns if c != "n_rows"])


@register("gate_per_dim")
def gate_per_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(gates.gate_per_dim(_gates(spark, sf_dir)), ["mean", "std"])


@register("gate_decisions")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(gates.gate_decisions(_gates(spark, sf_dir)), ["near_zero", "neutral", "near_one"])


@register("gate_histogram")
def gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(gates.gate_histogram(_gates(spark, sf_dir)), ["lo", "hi"])


@register("gate_heatmap_sample")
def gate_heatmap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_heatmap_sample(_gates(spark, sf_dir), "vec_id")


@register("gate_by_class")
def gate_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(gates.gate_by_class(_gates(spark, sf_dir)), ["mean_pos", "mean_neg"])


@register("gate_by_label")
def gate_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT8 on multi-label rows: the gates of the labelled documents by quality and toxic."""
    g = _gates(spark, sf_dir).select("vec_id", "gate")
    labels = fx.read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "vec_id")
    return _round(gates.gate_by_label(g.join(labels, "vec_id"), ["quality", "toxic"]), ["mean_pos", "mean_neg"])


@register("gate_vs_confidence")
def gate_vs_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(gates.gate_vs_confidence(_gates(spark, sf_dir), "vec_id"), ["mean_gate", "max_prob"])


@register("gate_interpretation")
def gate_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = gates.gate_report(_gate_val(spark, sf_dir), "vec_id")
    return _round(gates.gate_interpretation(rep), ["mean", "std", "near_zero", "near_one", "neutral"])


# ------------------------------------------------------------------ RUN


@register("seed_summary")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(runs.seed_summary(fx.metric_log(spark, sf_dir)), ["mean", "std"])


@register("early_stopping")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.early_stopping(fx.metric_log(spark, sf_dir))


@register("experiment_grid")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(runs.experiment_summary(fx.metric_log(spark, sf_dir)), ["mean", "std"])


@register("loss_cb_per_batch")
def loss_cb_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOS4 with class-balanced weights recomputed inside every batch (dynamic
    weights), reported as the mean of batch means per split: one aggregate per (batch, label),
    whose few rows also give the weights."""
    scored = fx.scored_from(_batched(spark, sf_dir), ("batch_id",))
    out = losses.one_pass_loss(scored, "cb", batch_cols=["split", "batch_id"], label_weights="batch")
    return _round(out, ["loss"])
