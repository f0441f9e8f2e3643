"""Classification metrics over a long scored table ``(label, y, prob)``.

Everything derives from one confusion aggregate per label; micro and macro
variants are small aggregates over that per-label table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import div0
from strata.operators.curves import score_counts
from strata.operators.ranking import Ranked


def binarize(scored: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5, pred_col: str = "pred") -> DataFrame:
    """MET1: ``pred = prob >= threshold`` (inclusive). ``thresholds`` is a
    ``(label, threshold)`` table with one row per label (bounded by the model's
    output width, so it is broadcast); labels without a row use ``default``."""
    if thresholds is None:
        return scored.withColumn(pred_col, (F.col("prob") >= F.lit(default)).cast("int")).withColumn(
            "threshold", F.lit(default)
        )
    t = F.broadcast(thresholds.select("label", F.col("threshold").cast("double").alias("threshold")))
    out = scored.join(t, "label", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    return out.withColumn(pred_col, (F.col("prob") >= F.col("threshold")).cast("int"))


def confusion(scored: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5) -> DataFrame:
    """MET2: per label ``(label, threshold, tp, fp, fn, tn)``; all four cells always present."""
    b = binarize(scored, thresholds, default)
    y, p = F.col("y"), F.col("pred")
    return b.groupBy("label").agg(
        F.first("threshold").alias("threshold"),
        F.sum(y * p).cast("long").alias("tp"),
        F.sum((1 - y) * p).cast("long").alias("fp"),
        F.sum(y * (1 - p)).cast("long").alias("fn"),
        F.sum((1 - y) * (1 - p)).cast("long").alias("tn"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return div0(2 * tp, 2 * tp + fp + fn)


def per_label_scores(conf: DataFrame) -> DataFrame:
    """precision, recall, F1 per label (0 when undefined)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.withColumn("precision", div0(tp, tp + fp)).withColumn("recall", div0(tp, tp + fn)).withColumn(
        "f1", _f1(tp, fp, fn)
    )


def summary_from_confusion(conf: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """MET3-MET5 as one row (per group): f1_micro, f1_macro, precision_macro, recall_macro."""
    s = per_label_scores(conf)
    return s.groupBy(*group_cols).agg(
        _f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def f1_micro_macro(scored: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    return summary_from_confusion(confusion(scored, thresholds)).select("f1_micro", "f1_macro")


def precision_recall_macro(scored: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    return summary_from_confusion(confusion(scored, thresholds)).select("precision_macro", "recall_macro")


def confusion_from_counts(counts: DataFrame, threshold: float | DataFrame = 0.5, default: float = 0.5, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """MET2 from distinct-score counts ``(group..., label, score, pos, neg)``, at one threshold or at
    a ``(label, threshold)`` table (with further columns, e.g. ``method``, to group by: they
    are then ``group_cols``). No second pass over the scored rows."""
    if isinstance(threshold, DataFrame):
        extra = [c for c in group_cols if c in threshold.columns]
        t = threshold.select(*extra, "label", F.col("threshold").cast("double").alias("threshold"))
        # labels (x methods) rows
        counts = counts.join(F.broadcast(t), "label", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    else:
        counts = counts.withColumn("threshold", F.lit(float(threshold)))
    hit = F.col("score") >= F.col("threshold")
    return counts.groupBy(*group_cols, "label").agg(
        F.first("threshold").alias("threshold"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).cast("long").alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).cast("long").alias("tn"),
    )


def confusion_of_ranked(ranked: Ranked, thresholds: dict[str, dict[int, float]]) -> DataFrame:
    """MET2 of a ``Ranked`` table: ``(method, label, threshold, tp, fp, fn, tn)`` at each method's thresholds, in one job."""
    methods = list(thresholds)
    counted = ranked.counts_at({label: [thresholds[m][label] for m in methods] for label in ranked.names()})
    rows = []
    for label, at in counted.items():
        p, n = ranked.totals(label)
        rows += [(m, label, float(thresholds[m][label]), tp, fp, p - tp, n - fp) for m, (tp, fp) in zip(methods, at, strict=True)]
    return ranked.rows.sparkSession.createDataFrame(rows, "method string, label int, threshold double, tp long, fp long, fn long, tn long")


def auc_of_ranked(ranked: Ranked) -> DataFrame:
    """MET6 of a ``Ranked`` table: ``(label, auc)``."""
    rows = [(label, ranked.auc(label // ranked.labels, label)) for label in ranked.names()]
    return ranked.rows.sparkSession.createDataFrame(rows, "label int, auc double")


def metric_bundle(scored: DataFrame | Ranked, threshold: float = 0.5, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """MET8: macro recall (reported as ``acc``), F1 micro/macro and AUC micro/macro
    at a fixed threshold; both AUCs are 0 when any label is single-class.

    Everything is derived from one distinct-score count table of the scored
    rows: the confusion at the threshold, the per-label AUCs and (re-aggregated
    without the label) the pooled AUC. The three one-row results are stacked
    and folded into one row by a single aggregate, so every part is planned
    once (a scalar subquery referenced by several expressions is planned again
    for each reference). ``group_cols`` (e.g. a configuration) give one row per group.

    Of a ``Ranked`` table the groups are its models (one group column, their number), and the three results
    come from its pieces."""
    from strata.operators.curves import auc_from_counts

    none = F.lit(None).cast("double")
    cols = ["acc", "f1_micro", "f1_macro", "macro", "undefined", "micro"]

    def row(**given: Column) -> list[Column]:
        return [*map(F.col, group_cols), *(given.get(c, none).cast("double").alias(c) for c in cols)]

    if isinstance(scored, Ranked):
        (group,) = group_cols
        spark = scored.rows.sparkSession
        conf = confusion_of_ranked(scored, {"": {label: threshold for label in scored.names()}})
        conf = conf.withColumn(group, F.floor(F.col("label") / scored.labels).cast("int"))
        aucs = auc_of_ranked(scored).withColumn(group, F.floor(F.col("label") / scored.labels).cast("int"))
        micro = spark.createDataFrame([(m, scored.auc(m)) for m in scored.models()], f"`{group}` int, auc double")
    else:
        counts = score_counts(scored, [*group_cols, "label"])
        conf = confusion_from_counts(counts, threshold, group_cols=group_cols)
        aucs = auc_from_counts(counts, [*group_cols, "label"])
        pooled = counts.groupBy(*group_cols, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        micro = auc_from_counts(pooled, list(group_cols))
    summ = summary_from_confusion(conf, group_cols)
    per_label = aucs.groupBy(*group_cols).agg(F.avg("auc").alias("macro"), F.max(F.col("auc").isNull().cast("int")).alias("undefined"))
    stacked = (
        summ.select(*row(acc=F.col("recall_macro"), f1_micro=F.col("f1_micro"), f1_macro=F.col("f1_macro")))
        .unionByName(per_label.select(*row(macro=F.col("macro"), undefined=F.col("undefined"))))
        .unionByName(micro.select(*row(micro=F.col("auc"))))
    )
    one = stacked.groupBy(*group_cols).agg(*[F.max(c).alias(c) for c in cols])
    bad = F.col("undefined") == 1
    return one.select(
        *group_cols,
        "acc",
        "f1_micro",
        "f1_macro",
        F.when(bad | F.col("micro").isNull(), F.lit(0.0)).otherwise(F.col("micro")).alias("auc_micro"),
        F.when(bad, F.lit(0.0)).otherwise(F.col("macro")).alias("auc_macro"),
    )


def per_label_report(scored: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """MET9: ``(label, threshold, auc, f1, precision, recall)``."""
    from strata.operators.curves import auc_from_counts

    counts = score_counts(scored)
    s = per_label_scores(confusion_from_counts(counts, 0.5 if thresholds is None else thresholds))
    return s.join(auc_from_counts(counts, ["label"]), "label", "left").select("label", "threshold", "auc", "f1", "precision", "recall")
