"""ROC / precision-recall curves, AUC and average precision.

All of them come from one table of distinct scores per label in descending
order with cumulative true/false positive counts (CRV1). The cumulative counts
use the two-level prefix sum: per-label totals of coarse score buckets give
bucket offsets, and running sums only run inside ``(label, bucket)``; a label
holding most rows is thus spread over its buckets, not put in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import CHART_BUCKETS, SCORE_BUCKETS
from strata.functions.columns import score_bucket


def score_counts(scored: DataFrame, part_cols: list[str] | None = None, score_col: str = "prob", y_col: str = "y") -> DataFrame:
    """``(part..., score, pos, neg)``: positives and negatives per distinct score
    (one partially aggregated pass over the scored rows). Every curve, AUC and
    fixed-threshold confusion can be derived from this table."""
    parts = ["label"] if part_cols is None else list(part_cols)
    y = F.col(y_col).cast("long")
    return scored.groupBy(*parts, F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )


def score_steps(
    scored: DataFrame,
    part_cols: list[str] | None = None,
    score_col: str = "prob",
    y_col: str = "y",
    buckets: int = SCORE_BUCKETS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """CRV1: one row per ``(part, distinct score)``, in descending score order,
    with ``pos``/``neg`` at the score, cumulative ``tp``/``fp`` (inclusive),
    part totals ``P``/``N`` and the next (lower) score's ``next_pos``/``next_neg``
    (null on the last row). ``part_cols=[]`` pools everything (micro average).
    ``counts`` (from ``score_counts``) may be passed instead of recomputing it.
    Scores are assumed in [0, 1] for bucketing (any order-preserving value works,
    out-of-range values land in the edge buckets)."""
    part_cols = ["label"] if part_cols is None else list(part_cols)
    if counts is None:
        counts = score_counts(scored, part_cols, score_col, y_col)
    if not part_cols:
        counts = counts.withColumn("_strata_all", F.lit(0))
        parts = ["_strata_all"]
    else:
        parts = part_cols
    b = "_strata_b"
    counts = counts.withColumn(b, score_bucket("score", buckets, descending=True))
    coarse = counts.groupBy(*parts, b).agg(
        F.sum("pos").alias("_cp"),
        F.sum("neg").alias("_cn"),
        F.max_by(F.struct("pos", "neg"), "score").alias("_first"),
    )
    wc = Window.partitionBy(*parts).orderBy(b)
    offsets = coarse.select(
        *parts,
        b,
        F.coalesce(F.sum("_cp").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_otp"),
        F.coalesce(F.sum("_cn").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ofp"),
        F.lead(F.col("_first.pos")).over(wc).alias("_nb_pos"),
        F.lead(F.col("_first.neg")).over(wc).alias("_nb_neg"),
        F.sum("_cp").over(Window.partitionBy(*parts)).alias("P"),
        F.sum("_cn").over(Window.partitionBy(*parts)).alias("N"),
    )
    wi = Window.partitionBy(*parts, b).orderBy(F.col("score").desc())
    run = wi.rowsBetween(Window.unboundedPreceding, 0)
    inner = counts.select(
        *parts,
        b,
        "score",
        "pos",
        "neg",
        F.sum("pos").over(run).alias("_itp"),
        F.sum("neg").over(run).alias("_ifp"),
        F.lead("pos").over(wi).alias("_lp"),
        F.lead("neg").over(wi).alias("_ln"),
    )
    out = inner.join(offsets, [*parts, b]).select(
        *parts,
        "score",
        "pos",
        "neg",
        (F.col("_otp") + F.col("_itp")).alias("tp"),
        (F.col("_ofp") + F.col("_ifp")).alias("fp"),
        F.coalesce("_lp", "_nb_pos").alias("next_pos"),
        F.coalesce("_ln", "_nb_neg").alias("next_neg"),
        "P",
        "N",
    )
    return out.drop("_strata_all") if not part_cols else out


def auc_from_counts(counts: DataFrame, part_cols: list[str], buckets: int = SCORE_BUCKETS) -> DataFrame:
    """AUC per part from a distinct-score count table ``(part..., score, pos, neg)``
    as ``sum over scores of neg * (positives strictly above + pos/2) / (P*N)``;
    NULL for a single-class part.

    Three exchanges and no join: the positives above a score are split into
    those in the same coarse score bucket (a window inside ``(part, bucket)``,
    so a hot part is spread over its buckets) and those in higher buckets (a
    window over the small per-bucket table); the aggregate per bucket and the
    final one per part reuse the partitioning of the window before them."""
    parts = list(part_cols) or ["_strata_all"]
    c = counts if part_cols else counts.withColumn("_strata_all", F.lit(0))
    out = _auc(c.withColumn("_b", score_bucket("score", buckets, descending=True)), parts)
    return out if part_cols else out.select("auc")


def auc_of_scores(scored: DataFrame, part_cols: list[str], buckets: int = SCORE_BUCKETS) -> DataFrame:
    """``auc_from_counts`` straight from scored rows ``(part..., prob, y)`` with few equal scores: they
    are dealt by (part, bucket) at once, so counting, ranking and the sums per bucket need one exchange."""
    b = score_bucket("prob", buckets, descending=True)
    dealt = scored.select(*part_cols, b.alias("_b"), F.col("prob").alias("score"), F.col("y").cast("long").alias("y")).repartition(*part_cols, "_b")
    counts = dealt.groupBy(*part_cols, "_b", "score").agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    return _auc(counts, list(part_cols))


def _auc(c: DataFrame, parts: list[str]) -> DataFrame:
    """AUC per part from ``(part..., _b, score, pos, neg)``."""
    above = Window.partitionBy(*parts, "_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    within = c.withColumn("_pa", F.coalesce(F.sum(pos).over(above), F.lit(0.0)))
    per_bucket = within.groupBy(*parts, "_b").agg(
        F.sum(neg * (F.col("_pa") + pos / F.lit(2.0))).alias("_w"), F.sum(pos).alias("_p"), F.sum(neg).alias("_n")
    )
    higher = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    crossed = per_bucket.withColumn("_ph", F.coalesce(F.sum("_p").over(higher), F.lit(0.0)))
    P, N = F.sum("_p"), F.sum("_n")
    auc = F.when((P > 0) & (N > 0), F.sum(F.col("_w") + F.col("_n") * F.col("_ph")) / (P * N))
    return crossed.groupBy(*parts).agg(auc.alias("auc"))


def auc_per_label(scored: DataFrame) -> DataFrame:
    """MET6 per label: ``(label, auc)`` (NULL when a label is single-class)."""
    return auc_from_counts(score_counts(scored), ["label"])


def auc_pooled(scored: DataFrame) -> DataFrame:
    """MET7: micro AUC (all labels pooled): one row ``(auc)``."""
    return auc_from_counts(score_counts(scored, part_cols=[]), [])


def auc_macro(scored: DataFrame) -> DataFrame:
    return auc_per_label(scored).agg(F.avg("auc").alias("auc_macro"))


def roc_curve(scored: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """CRV2: ``(label, threshold, fpr, tpr)``; leading ``(+inf, 0, 0)`` anchor;
    with ``drop_intermediate`` an interior point is kept only where the step
    ``(pos, neg)`` changes (non-zero second difference of fp or tp)."""
    return _roc_from_steps(score_steps(scored), drop_intermediate)


def _first_step() -> Column:
    """The label's highest distinct score (its cumulative counts are its own;
    exactly one row per label, since every distinct score has a row)."""
    return (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))


def _roc_from_steps(steps: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    last = F.col("next_pos").isNull()
    first = _first_step()
    keep = first | last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = steps.where(keep) if drop_intermediate else steps
    point = F.struct(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"),
    )
    anchor = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # the (+inf, 0, 0) anchor rides on the first step: no second pass for the label list
    return pts.select("label", F.inline(F.when(first, F.array(anchor, point)).otherwise(F.array(point))))


def pr_curve(scored: DataFrame) -> DataFrame:
    """CRV4: ``(label, threshold, precision, recall)`` for every distinct score
    (also past full recall), plus the ``(NULL, 1, 0)`` end point."""
    return _pr_from_steps(score_steps(scored))


def _pr_from_steps(steps: DataFrame) -> DataFrame:
    recall = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp").cast("double") / F.col("P").cast("double"))
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        recall.alias("recall"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return steps.select("label", F.inline(F.when(_first_step(), F.array(point, end)).otherwise(F.array(point))))


def average_precision(scored: DataFrame) -> DataFrame:
    """CRV5: ``(label, ap)``: sum over distinct scores of ``(pos/P) * precision``
    (step-wise, no interpolation); NULL when a label has no positives."""
    return _ap_from_steps(score_steps(scored))


def _ap_from_steps(steps: DataFrame) -> DataFrame:
    prec = F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    return steps.groupBy("label").agg(
        F.when(F.first("P") > 0, F.sum(F.col("pos").cast("double") * prec) / F.first("P").cast("double")).alias("ap")
    )


def curve_chart(scored: DataFrame) -> DataFrame:
    """CRV6: chart-ready rows ``(label, curve, x, y, threshold, area)``: ROC points
    with the AUC, PR points with the AP, and the random diagonal. The four
    parts derive from ONE distinct-score step table."""
    steps = score_steps(scored)
    aucs = auc_per_label(scored)
    roc = _roc_from_steps(steps).join(aucs, "label", "left").select(
        "label", F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y"), "threshold", F.col("auc").alias("area")
    )
    pr = _pr_from_steps(steps).join(_ap_from_steps(steps), "label", "left").select(
        "label", F.lit("pr").alias("curve"), F.col("recall").alias("x"), F.col("precision").alias("y"), "threshold", F.col("ap").alias("area")
    )
    diag = aucs.select(
        "label",
        F.lit("random").alias("curve"),
        F.inline(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")))),
    ).select("label", "curve", "x", "y", F.lit(None).cast("double").alias("threshold"), F.lit(0.5).alias("area"))
    return roc.unionByName(pr).unionByName(diag)


def bounded_chart(chart: DataFrame, n_buckets: int = CHART_BUCKETS) -> DataFrame:
    """CRV6 of bounded length: at most ``4 * n_buckets`` points of each curve of a ``curve_chart``, as its rows with ``y_error``.

    x is cut into equal buckets; of each one the first, last, lowest and highest points stay (one grouped
    aggregate, ties by all values). Between them a bucket's exact points and the drawn line both keep within its
    range of y, ``y_error``, which is thus the largest vertical error there (null where y is)."""
    bucket = F.least(F.floor(F.nanvl("x", F.lit(0.0)) * n_buckets), F.lit(n_buckets - 1))
    across, up = F.struct("x", "y", "threshold"), F.struct("y", "x", "threshold")
    kept = chart.groupBy("label", "curve", bucket.alias("bucket")).agg(
        F.array(F.min(across), F.max(across)).alias("ends"), F.array(F.min(up), F.max(up)).alias("range"),
        (F.max("y") - F.min("y")).alias("y_error"), F.first("area").alias("area"),  # one area a curve
    )
    same = F.transform("range", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["threshold"].alias("threshold")))
    points = F.array_distinct(F.concat("ends", same))
    return kept.select("label", "curve", "area", "y_error", F.inline(points)).select("label", "curve", "x", "y", "threshold", "area", "y_error")
