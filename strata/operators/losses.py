"""Multi-label losses as column expressions over a scored table ``(label, y, logit)``.

Each loss is an element expression (stable log-sigmoid form) followed by a
reduction. Per-label weights come from small ``(label, ...)`` tables (one row
per label: bounded, broadcast). Class-balanced weights are computed from the
targets of the same table, globally or per batch (``batch_col``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.config import ASL_CLIP, ASL_GAMMA_NEG, ASL_GAMMA_POS, CB_BETA, CB_EPS, FOCAL_GAMMA
from strata.functions.columns import bce_with_logits, log_sigmoid, sigmoid
from strata.operators.prep import effective_number_weights_from_counts

LOSSES = ("bce", "focal", "asl", "cb", "cb_focal")


def _with_label_table(scored: DataFrame, table: DataFrame | None, cols: dict[str, float]) -> DataFrame:
    """Attach per-label columns (left join, missing -> the given default)."""
    if table is None:
        out = scored
        for c, default in cols.items():
            out = out.withColumn(c, F.lit(float(default)))
        return out
    t = F.broadcast(table.select("label", *[F.col(c).cast("double") for c in cols]))
    out = scored.join(t, "label", "left")
    for c, default in cols.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(float(default))))
    return out


def _focal_factor(z: Column, y: Column, gamma: float) -> Column:
    p = sigmoid(z)
    p_t = p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y)
    return F.pow(F.lit(1.0) - p_t, F.lit(float(gamma)))


def cb_weights(scored: DataFrame, beta: float = CB_BETA, eps: float = CB_EPS, batch_col: str | None = None) -> DataFrame:
    """Dynamic class-balanced weights ``(batch?, label, w_pos, w_neg)`` from the
    table's own targets (per batch when ``batch_col`` is given)."""
    keys = [batch_col] if batch_col else []
    counts = scored.groupBy(*keys, "label").agg(
        F.sum(F.col("y").cast("long")).alias("positive"), F.sum(1 - F.col("y").cast("long")).alias("negative")
    )
    return effective_number_weights_from_counts(counts, beta, eps, part_cols=keys)


def element_loss(
    scored: DataFrame,
    loss: str = "bce",
    label_weights: DataFrame | None = None,
    gamma: float = FOCAL_GAMMA,
    gamma_neg: float = ASL_GAMMA_NEG,
    gamma_pos: float = ASL_GAMMA_POS,
    clip: float = ASL_CLIP,
    beta: float = CB_BETA,
    stored_cb_weights: DataFrame | None = None,
    batch_col: str | None = None,
) -> DataFrame:
    """LOS1-LOS5 + LOS7: add the per-element ``loss`` column.

    * ``bce``: ``-(w*y*logσ(z) + (1-y)*logσ(-z))`` with ``w = pos_weight``
      from ``label_weights`` (default 1).
    * ``focal``: ``(α*y + 1-y) * (1-p_t)^γ * bce`` with α = ``pos_weight`` (default 1).
    * ``asl``: ``(1-p)^γ⁺*(-y*logσ(z)) + (1-p_neg)^γ⁻*(-(1-y)*logσ(-z))``,
      ``p_neg = min(1-p+clip, 1)``, times ``(α*y + 1-y)``.
    * ``cb``: ``(w⁺*y + w⁻*(1-y)) * bce`` with dynamic effective-number weights.
    * ``cb_focal``: CB weights times the focal factor; ``stored_cb_weights``
      ``(label, w_pos, w_neg)`` replaces the dynamic ones (missing labels -> 1).
    """
    if loss not in LOSSES:
        raise ValueError(f"Unknown loss: {loss}")
    z, y = F.col("logit"), F.col("y").cast("double")
    if loss in ("bce", "focal", "asl"):
        d = _with_label_table(scored, label_weights, {"pos_weight": 1.0}).withColumnRenamed("pos_weight", "w_pos").withColumn("w_neg", F.lit(1.0))
    elif loss == "cb_focal" and stored_cb_weights is not None:
        d = _with_label_table(scored, stored_cb_weights, {"w_pos": 1.0, "w_neg": 1.0})
    else:
        keys = [batch_col, "label"] if batch_col else ["label"]
        w = cb_weights(scored, beta, batch_col=batch_col).select(*keys, "w_pos", "w_neg")
        # one row per (batch, label): bounded by the label count when global
        d = scored.join(w if batch_col else F.broadcast(w), keys, "left")
    a, b = loss_parts(loss, z, y, gamma, gamma_neg, gamma_pos, clip)
    return d.withColumn("loss", F.col("w_pos") * y * a + F.col("w_neg") * (F.lit(1.0) - y) * b).drop("w_pos", "w_neg")


def reduce_loss(elements: DataFrame, reduction: str = "mean", batch_col: str | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """LOS6: ``mean`` / ``sum`` / ``none``. With ``batch_col`` the mean is the
    mean of per-batch means (the reported epoch loss)."""
    group_cols = group_cols or []
    if reduction == "none":
        return elements
    if reduction == "sum":
        return elements.groupBy(*group_cols).agg(F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("n"))
    if reduction != "mean":
        raise ValueError(f"Unknown reduction: {reduction}")
    if batch_col is None:
        return elements.groupBy(*group_cols).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"))
    per_batch = elements.groupBy(*group_cols, batch_col).agg(F.avg("loss").alias("batch_loss"))
    return per_batch.groupBy(*group_cols).agg(F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def loss(scored: DataFrame, name: str = "bce", reduction: str = "mean", **kwargs) -> DataFrame:
    """Element loss + reduction in one call."""
    return reduce_loss(element_loss(scored, name, **kwargs), reduction)


def loss_parts(
    loss: str, z: Column, y: Column, gamma: float = FOCAL_GAMMA, gamma_neg: float = ASL_GAMMA_NEG, gamma_pos: float = ASL_GAMMA_POS,
    clip: float = ASL_CLIP,
) -> tuple[Column, Column]:
    """Positive-row and negative-row parts of a loss before its per-label weight:
    ``loss = w_pos * y * A + w_neg * (1 - y) * B`` (``w_neg = 1`` except for CB). The one place
    where the losses are written down; the trainer's gradients belong to the same parts."""
    one = F.lit(1.0)
    nls_pos, nls_neg = -log_sigmoid(z), -log_sigmoid(-z)
    if loss in ("bce", "cb"):
        return nls_pos, nls_neg
    if loss in ("focal", "cb_focal"):
        f = _focal_factor(z, y, gamma)
        return f * nls_pos, f * nls_neg
    if loss == "asl":
        p = sigmoid(z)
        p_neg = F.least(one - p + F.lit(float(clip)), one) if clip and clip > 0 else one - p
        return F.pow(one - p, F.lit(float(gamma_pos))) * nls_pos, F.pow(one - p_neg, F.lit(float(gamma_neg))) * nls_neg
    raise ValueError(f"Unknown loss: {loss}")


def one_pass_loss(
    scored: DataFrame,
    loss: str = "bce",
    weight_rows: Column | None = None,
    reduction: str = "mean",
    batch_cols: list[str] | None = None,
    gamma: float = FOCAL_GAMMA,
    gamma_neg: float = ASL_GAMMA_NEG,
    gamma_pos: float = ASL_GAMMA_POS,
    clip: float = ASL_CLIP,
    beta: float = CB_BETA,
    eps_pos_weight: float = 1e-6,
    label_weights: str = "table",
) -> DataFrame:
    """Mean (or sum) loss in ONE aggregate over the scored table.

    Every supported loss is linear in its per-label weights, so the loss equals
    ``sum_l (w_pos_l * A_l + w_neg_l * B_l)`` with ``A_l``/``B_l`` the sums of the
    positive/negative parts. The label counts that define the weights (over the
    rows matching ``weight_rows``, e.g. the train split, or all rows) come from the
    same grouped aggregate: bce/focal/asl use ``alpha = sqrt(neg / (pos + 1e-6))``
    for positives; cb/cb_focal use effective-number weights. No second scan or
    join of the scored table. With ``batch_cols`` the result is the mean of
    per-batch means grouped by all but the last batch column (e.g. ``[split,
    batch_id]`` -> one row per split).

    ``label_weights``: ``table`` (counts of all rows matching ``weight_rows``), ``batch``
    (each batch's own counts, by a window over its few label rows) or ``ones``."""
    if reduction not in ("mean", "sum"):
        raise ValueError(f"Unknown reduction: {reduction}")
    if label_weights not in ("table", "batch", "ones"):
        raise ValueError(f"Unknown label weights: {label_weights}")
    batch_cols = batch_cols or []
    y = F.col("y").cast("double")
    a, b = loss_parts(loss, F.col("logit"), y, gamma, gamma_neg, gamma_pos, clip)
    wr = (weight_rows if weight_rows is not None else F.lit(True)).cast("double")
    part = scored.groupBy(*batch_cols, "label").agg(
        F.sum(y * a).alias("A"),
        F.sum((F.lit(1.0) - y) * b).alias("B"),
        F.count(F.lit(1)).alias("n"),
        F.sum(y * wr).alias("wp"),
        F.sum(wr).alias("wn_all"),
    )
    # per-label weights from the (at most labels x batches rows) partial table
    own = part.withColumn("positive", F.col("wp")).withColumn("negative", F.col("wn_all") - F.col("wp"))

    def weigh(counts: DataFrame, keys: list[str]) -> DataFrame:
        if loss in ("cb", "cb_focal"):
            return effective_number_weights_from_counts(counts, beta, CB_EPS, part_cols=keys)
        w_pos = F.sqrt(F.col("negative") / (F.col("positive") + F.lit(eps_pos_weight)))
        return counts.withColumn("w_pos", w_pos).withColumn("w_neg", F.lit(1.0))

    if label_weights == "ones":
        joined = part.withColumn("w_pos", F.lit(1.0)).withColumn("w_neg", F.lit(1.0))
    elif label_weights == "batch":
        joined = weigh(own, batch_cols)
    else:
        lab = own.groupBy("label").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
        joined = part.join(F.broadcast(weigh(lab, []).select("label", "w_pos", "w_neg")), "label")  # one row per label
    contrib = F.col("w_pos") * F.col("A") + F.col("w_neg") * F.col("B")
    if not batch_cols:
        out = joined.agg(F.sum(contrib).alias("loss_sum"), F.sum("n").alias("n"))
        val = F.col("loss_sum") / F.col("n") if reduction == "mean" else F.col("loss_sum")
        return out.select(val.alias("loss"), "n")
    per_batch = joined.groupBy(*batch_cols).agg((F.sum(contrib) / F.sum("n")).alias("batch_loss"))
    return per_batch.groupBy(*batch_cols[:-1]).agg(F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))
