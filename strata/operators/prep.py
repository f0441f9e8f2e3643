"""Projection, head/sample, stratified split, batching, scaling and class weights."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.config import (
    BALANCE_KICKS,
    CB_BETA,
    CB_EPS,
    CUT_BUCKET_HEX,
    EXCHANGE_TRIES,
    GATE_HEATMAP_MIN_ROWS,
    GATE_HEATMAP_ROWS,
    MAX_CLASSES,
    NUMERIC_TYPES,
    POS_WEIGHT_EPS,
    SEED,
    SPLIT_BUCKET_HEX,
    TEST_SIZE,
    TINY_SIZE,
    TRAIN_BATCH_SIZE,
    VAL_SPLIT,
)
from strata.functions.columns import col, hash_order_key, hex_bucket
from strata.operators.prefix import ordered_rank
from strata.session import cut_lineage

# ---------------------------------------------------------------- projection


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """PRJ1+PRJ2: names of the columns kept as features: not excluded by name and
    of one of the four admitted numeric types (in schema order)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and f.dataType.simpleString() in NUMERIC_TYPES]


def project_features(df: DataFrame, key_col: str, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Key plus the schema-selected numeric features."""
    return df.select(key_col, *numeric_columns(df, [key_col, *exclude]))


def fill_text(df: DataFrame, text_col: str) -> DataFrame:
    """PRJ4: null text becomes the empty string."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))


def to_float32(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ5: cast numeric (or numeric array) columns to float32."""
    out = df
    for c in cols:
        t = df.schema[c].dataType.simpleString()
        out = out.withColumn(c, F.col(c).cast("array<float>" if t.startswith("array") else "float"))
    return out


def features_array(cols: list[str], dtype: str = "double") -> Column:
    """Pack scalar feature columns into one ``array<dtype>`` (matrix-row form)."""
    return F.array(*[F.col(c).cast(dtype) for c in cols])


def head(df: DataFrame, key_col: str, n: int = TINY_SIZE) -> DataFrame:
    """LIM1/LIM2: first ``n`` rows in key order (top-k, no global sort)."""
    return df.orderBy(key_col).limit(n)


def hash_sample(
    df: DataFrame,
    key_col: str,
    n: int = GATE_HEATMAP_ROWS,
    min_rows: int = GATE_HEATMAP_MIN_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """SMP1: reproducible sample of ``min(n, count)`` rows without replacement,
    empty when the input has fewer than ``min_rows`` rows. One scan: the top-n
    is taken per partition and merged; when ``min_rows <= n`` the guard only
    needs the size of the sample itself (it holds ``min(n, count)`` rows), so
    it is a count over at most ``n`` rows instead of a second full scan."""
    ordered = df.withColumn("_strata_h", hash_order_key(seed, key_col))
    if min_rows > n:
        size = df.groupBy().count().scalar()
        return ordered.where(size >= F.lit(min_rows)).orderBy("_strata_h", key_col).limit(n).drop("_strata_h")
    top = ordered.orderBy("_strata_h", key_col).limit(n)
    # at most n rows: a window over the whole (bounded) sample
    sized = top.withColumn("_strata_c", F.count(F.lit(1)).over(Window.partitionBy()))
    return sized.where(F.col("_strata_c") >= F.lit(min_rows)).drop("_strata_h", "_strata_c")


# ---------------------------------------------------------------- labels long form


def labels_long(df: DataFrame, key_cols: list[str], label_cols: list[str], y_name: str = "y") -> DataFrame:
    """PRJ3 long form: one ``(key..., label, y)`` row per label column."""
    pairs = [F.struct(F.lit(i).alias("label"), F.col(c).cast("int").alias(y_name)) for i, c in enumerate(label_cols)]
    return df.select(*key_cols, F.inline(F.array(*pairs)))


# ---------------------------------------------------------------- split


def _cut(n: Column, frac: Fraction) -> Column:
    """round-half-up(n * frac) in integer arithmetic: (2*num*n + den) div (2*den)."""
    return (F.lit(2 * frac.numerator) * n + F.lit(frac.denominator)).cast("long") / F.lit(2 * frac.denominator)


def stratified_split(
    df: DataFrame,
    key_col: str,
    label_cols: list[str],
    seed: int = SEED,
    test_size: float = TEST_SIZE,
    val_split: float = VAL_SPLIT,
    strata: str = "labelset",
    split_col: str = "split",
) -> DataFrame:
    """SPL1: seeded multilabel-stratified train/val/test assignment.

    Stratum = the label-set (``strata='labelset'``, or ``'iterative'`` for sparse label-sets whose
    rounding is balanced over the labels) or the row's rarest positive label (``strata='rarest'``). Inside a stratum rows
    are ordered by ``md5(seed:key)``; the first ``round(n*(1-test_size))`` go to
    train, up to ``round(n*(1-test_size*(1-val_split)))`` to val, the rest to test,
    with integer arithmetic, so a one-row stratum goes to train. Each stratum
    keeps its label shares within one row per split. With ``'iterative'`` the rows of a
    stratum that its shares leave over go where its labels lack rows (``balanced_quotas``).

    No row is ranked but those around the cut points (``_cut_points``): the split
    itself is a projection of the input against one row per stratum (broadcast;
    more than ``MAX_CLASSES`` strata raise ValueError)."""
    train = Fraction(str(1 - Fraction(str(test_size))))
    upto_val = train + Fraction(str(test_size)) * Fraction(str(val_split))
    if strata in ("labelset", "iterative"):
        stratum = {c: F.col(c).cast("int") if strata == "iterative" else F.col(c) for c in label_cols}
    elif strata == "rarest":
        counts = df.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in label_cols]).first()
        order = sorted(label_cols, key=lambda c: (counts[c] or 0, label_cols.index(c)))
        rarest = reduce(
            lambda acc, c: acc.when(F.col(c) == 1, F.lit(label_cols.index(c))),
            order[1:],
            F.when(F.col(order[0]) == 1, F.lit(label_cols.index(order[0]))),
        ).otherwise(F.lit(-1))
        stratum = {"rarest": rarest}
    else:
        raise ValueError(f"unknown strata mode: {strata}")
    quotas = _labelset_quotas(df, label_cols, (train, upto_val)) if strata == "iterative" else None
    cuts = cut_lineage(_cut_points(df, key_col, stratum, seed, (train, upto_val), quotas))
    if cuts.count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} strata; use strata='rarest'")
    place = F.struct(hash_order_key(seed, key_col).alias("h"), F.col(key_col).cast("string").alias("k"))
    same = reduce(lambda x, y: x & y, [c.eqNullSafe(F.col(f"_stratum_{i}")) for i, c in enumerate(stratum.values())])
    split = F.when(place <= F.col("_upto_0"), "train").when(place <= F.col("_upto_1"), "val").otherwise("test")
    return df.join(F.broadcast(cuts), same, "left").select(*[F.col(c) for c in df.columns], split.alias(split_col))


def balanced_quotas(labels: np.ndarray, counts: np.ndarray, fractions: tuple[Fraction, ...]) -> np.ndarray:
    """Rows per (label-set, part): every entry is its exact share ``counts * fraction`` rounded down or up,
    each row sums to its count, and the shares of every label (and of all rows) are met as closely as found.

    Rounding down leaves at most one row per part and label-set over. The rarest label places its
    label-sets' rows first, each into the part that lacks the label most (then all its labels); what is
    left unbalanced is then improved by moving a row to another part, or exchanging rows of two
    label-sets, while the sum of squared label errors falls. If a label is then off by more than one
    row, up to ``BALANCE_KICKS`` further steps take the best change though it doesn't improve, and leave
    the rows just moved alone; the best state met is the result."""
    a = np.column_stack([labels, np.ones(len(counts), dtype=np.int64)]).astype(np.int64)
    den = np.lcm.reduce([f.denominator for f in fractions])
    part = np.array([int(f * den) for f in fractions], dtype=np.int64)
    exact = counts.astype(np.int64)[:, None] * part  # in units of 1 / den
    base, open_ = exact // den, exact % den > 0
    left = counts - base.sum(1)
    extra = np.zeros_like(base)
    lack = (a.T @ (exact - base * den)) / den  # (labels, parts)

    todo = left > 0
    while todo.any():
        need = (a * (left * todo)[:, None]).sum(0)
        rare = int(np.argmin(np.where(need > 0, need, np.iinfo(np.int64).max)))
        for i in np.flatnonzero(todo & (a[:, rare] == 1)):
            has = a[i] == 1
            for _ in range(left[i]):
                room = np.flatnonzero(open_[i] & (extra[i] == 0))
                k = max(room, key=lambda k: (round(lack[rare, k], 9), round(lack[has, k].sum(), 9), -k))
                extra[i, k] = 1
                lack[has, k] -= 1
            todo[i] = False

    pairs = [(k, m) for k in range(len(fractions)) for m in range(len(fractions)) if k != m]
    size = a.sum(1)
    found, kicks, rest_until = (np.inf, np.inf, extra), 0, np.zeros(len(counts), dtype=np.int64)
    for step in range(20 * a.shape[1] * len(fractions) + len(counts)):
        best, free = (np.inf, None), (rest_until <= step)[:, None]
        for k, m in pairs:
            gain = 2 * (a @ (lack[:, k] - lack[:, m]))
            out = np.flatnonzero(((extra[:, [k]] == 1) & (extra[:, [m]] == 0) & open_[:, [m]] & free)[:, 0])
            if not len(out):
                continue
            alone = gain[out] + 2 * size[out]
            if alone.min() < best[0]:
                best = (alone.min(), [(out[alone.argmin()], k, m)])
            if k > m:
                continue
            back = np.flatnonzero(((extra[:, [m]] == 1) & (extra[:, [k]] == 0) & open_[:, [k]] & free)[:, 0])
            for i in out[np.argsort(gain[out], kind="stable")[:EXCHANGE_TRIES]]:
                if len(back):
                    both = gain[i] - gain[back] + 2 * (size[i] + size[back] - 2 * (a[back] @ a[i]))
                    if both.min() < best[0]:
                        best = (both.min(), [(i, k, m), (back[both.argmin()], m, k)])
        if best[0] >= -1e-9:  # no change improves
            worst = max(np.abs(lack).max(), 1.0)
            found = min(found, (round(worst, 9), round((lack**2).sum(), 9), extra.copy()), key=lambda f: f[:2])
            if worst == 1 or kicks == BALANCE_KICKS or best[1] is None:
                break
            kicks += 1
        for i, k, m in best[1]:
            extra[i, k], extra[i, m] = 0, 1
            lack[:, k] += a[i]
            lack[:, m] -= a[i]
            rest_until[i] = step + 10 if kicks else 0
    return base + (found[2] if found[0] < np.inf else extra)


def _labelset_quotas(df: DataFrame, label_cols: list[str], cuts: tuple[Fraction, ...]) -> DataFrame:
    """One row per label-set, ``_quota_<i>`` its labels and ``_rows_<j>`` its rows up to cut j. The count
    table of label-sets (at most ``MAX_CLASSES`` rows, checked) is balanced on the driver. Null labels count as 0."""
    names = [f"_quota_{i}" for i in range(len(label_cols))]
    table = df.groupBy(*[F.col(c).cast("int").alias(n) for n, c in zip(names, label_cols)]).agg(F.count(F.lit(1)).alias("n"))
    rows = table.orderBy(*names).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} strata; use strata='rarest'")
    edges = (Fraction(0), *cuts, Fraction(1))
    labels = np.array([[int(v == 1) for v in r[:-1]] for r in rows], dtype=np.int64).reshape(len(rows), len(names))
    quotas = balanced_quotas(labels, np.array([r["n"] for r in rows], dtype=np.int64), tuple(b - a for a, b in zip(edges, edges[1:])))
    upto = np.cumsum(quotas, axis=1)[:, : len(cuts)].tolist()
    schema = ", ".join([f"{n} int" for n in names] + [f"_rows_{j} long" for j in range(len(cuts))])
    return df.sparkSession.createDataFrame([(*r[:-1], *u) for r, u in zip(rows, upto)], schema)


def _cut_points(
    df: DataFrame, key_col: str, stratum: dict[str, Column], seed: int, fractions: tuple[Fraction, ...], quotas: DataFrame | None = None,
) -> DataFrame:
    """One row per stratum: its columns ``_stratum_<i>`` and, per fraction of its rows, the place
    ``_upto_<j>`` (hash, key) of the last row within it (NULL if none is). ``quotas`` gives the rows
    up to each cut instead (``_labelset_quotas``).

    Totals of hash buckets (map-side combined) tell which bucket each cut falls in; only the
    rows of those buckets - two in ``16**CUT_BUCKET_HEX`` - are then put in order."""
    names = [f"_stratum_{i}" for i in range(len(stratum))]
    rows = df.select(
        *[c.alias(n) for n, c in zip(names, stratum.values())], hash_order_key(seed, key_col).alias("h"), F.col(key_col).cast("string").alias("k")
    ).withColumn("b", hex_bucket("h", CUT_BUCKET_HEX))
    totals = rows.groupBy(*names, "b").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*names)  # at most 16**CUT_BUCKET_HEX rows of a stratum
    before = F.coalesce(F.sum("n").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("before", before).withColumn("all", F.sum("n").over(whole))
    if quotas is None:
        rows_upto = [F.floor(_cut(F.col("all"), f)) for f in fractions]
    else:
        same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_quota_{i}")) for i, n in enumerate(names)])
        totals = totals.join(F.broadcast(quotas), same)
        rows_upto = [F.col(f"_rows_{j}") for j in range(len(fractions))]
    wanted = F.array(*[F.struct(F.lit(j).alias("j"), n.alias("upto")) for j, n in enumerate(rows_upto)])
    picks = totals.select(*names, "b", "n", "before", F.inline(wanted)).where("before < upto and upto <= before + n")
    picks = picks.select(*[F.col(n).alias(f"p{n}") for n in names], F.col("b").alias("pb"), "j", (F.col("upto") - F.col("before")).alias("need"))
    # null-safe also where nothing is null: a plain equality has Spark filter by it first, which computes the hash twice
    meets = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"p{n}")) for n in names], F.col("b").eqNullSafe(F.col("pb")))
    near = rows.join(F.broadcast(picks), meets)  # two rows per stratum
    place = F.row_number().over(Window.partitionBy(*names, "b", "j").orderBy("h", "k"))
    found = near.withColumn("place", place).where("place = need")
    last = [F.max(F.when(F.col("j") == j, F.struct("h", "k"))).alias(f"_upto_{j}") for j in range(len(fractions))]
    return found.groupBy(*names).agg(*last)


def split_label_rates(df: DataFrame, label_cols: list[str], split_col: str = "split") -> DataFrame:
    """SPL3: per split and label, positives, rows and positive rate."""
    long = labels_long(df, [split_col], label_cols)
    return long.groupBy(split_col, "label").agg(
        F.sum("y").cast("long").alias("positives"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"),
    )


def project_split(df: DataFrame, split_keys: DataFrame, key_col: str, other_key: str | None = None) -> DataFrame:
    """SPL2: keep the rows of another table whose key belongs to the given split
    keys (left-semi join; only keys are shuffled, nothing is duplicated)."""
    other_key = other_key or key_col
    keys = split_keys.select(F.col(key_col).alias(other_key))
    return df.join(keys, on=other_key, how="left_semi")


# ---------------------------------------------------------------- batches


def assign_batches(
    df: DataFrame,
    key_col: str,
    split_col: str = "split",
    batch_size: int = TRAIN_BATCH_SIZE,
    seed: int = SEED,
    epoch: int = 0,
) -> DataFrame:
    """SRC6: fixed-size batches per split. Train rows are shuffled per epoch by
    ``md5(seed:epoch:key)``; val/test rows keep one fixed order ``md5(seed:key)``
    for every epoch. ``batch_id = (position - 1) div batch_size``."""
    order = F.when(F.col(split_col) == "train", hash_order_key(seed, F.lit(epoch), key_col)).otherwise(
        hash_order_key(seed, key_col)
    )
    data = df.withColumn("_strata_o", order)
    ranked = ordered_rank(
        data,
        [split_col],
        [F.col("_strata_o"), F.col(key_col)],
        hex_bucket("_strata_o", SPLIT_BUCKET_HEX),
        name="_strata_pos",
    )
    return ranked.withColumn("batch_id", ((F.col("_strata_pos") - 1) / F.lit(batch_size)).cast("long")).drop(
        "_strata_o", "_strata_pos"
    )


# ---------------------------------------------------------------- scaler


_F64_EPS = 2.220446049250313e-16


@dataclass
class ScalerModel:
    """SCL1 result: per-feature mean and scale (population std, constant -> 1)."""

    features: list[str]
    means: list[float]
    scales: list[float]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.features, self.means, self.scales))
        return spark.createDataFrame(rows, "feature string, mean double, scale double")

    def transform(self, df: DataFrame, as_float32: bool = False) -> DataFrame:
        """SCL2: ``(x - mean) / scale`` as a projection with literal stats."""
        out = df
        for f, m, s in zip(self.features, self.means, self.scales):
            v = (F.col(f).cast("double") - F.lit(m)) / F.lit(s)
            out = out.withColumn(f, v.cast("float") if as_float32 else v)
        return out


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """SCL1 as a lazy long table ``(feature, mean, scale)`` from ONE aggregate pass
    (one wide partial aggregate; no per-feature explode)."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"m_{f}"), F.stddev_pop(x).alias(f"s_{f}"), F.count(x).alias(f"n_{f}")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), _scale(f"s_{f}", f"m_{f}", f"n_{f}").alias("scale"))
        for f in features
    ]
    return wide.select(F.inline(F.array(*rows)))


def _scale(std: str, mean: str, n: str) -> Column:
    """Population std with near-constant features mapped to 1 (variance within
    the rounding bound ``n*eps*var + (n*mean*eps)^2``)."""
    s, m, cnt = F.col(std), F.col(mean), F.col(n).cast("double")
    var = s * s
    bound = cnt * F.lit(_F64_EPS) * var + F.pow(cnt * m * F.lit(_F64_EPS), 2)
    return F.when(s.isNull() | (var <= bound), F.lit(1.0)).otherwise(s)


def fit_scaler(df: DataFrame, features: list[str]) -> ScalerModel:
    """SCL1: fit on (typically) the train split; the F-row stats come to the driver."""
    rows = scaler_stats(df, features).collect()
    stats = {r["feature"]: r for r in rows}
    return ScalerModel(features, [stats[f]["mean"] for f in features], [stats[f]["scale"] for f in features])


# ---------------------------------------------------------------- class weights


def label_counts(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """Per label ``(label, positive, negative)`` from one wide aggregate."""
    aggs = [F.sum(F.col(c).cast("long")).alias(f"p{i}") for i, c in enumerate(label_cols)]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [
        F.struct(
            F.lit(i).alias("label"),
            F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("positive"),
            (F.col("n") - F.coalesce(F.col(f"p{i}"), F.lit(0))).alias("negative"),
        )
        for i in range(len(label_cols))
    ]
    return wide.select(F.inline(F.array(*rows)))


def pos_weight(df: DataFrame, label_cols: list[str], eps: float = POS_WEIGHT_EPS) -> DataFrame:
    """WGT1: ``sqrt(neg / (pos + eps))`` per label."""
    c = label_counts(df, label_cols)
    return c.withColumn("pos_weight", F.sqrt(F.col("negative") / (F.col("positive") + F.lit(eps))))


def _effective_number(n: Column, beta: float, eps: float) -> Column:
    return (F.lit(1.0) - F.pow(F.lit(beta), F.greatest(n.cast("double"), F.lit(eps)))) / F.lit(1.0 - beta)


def effective_number_weights_from_counts(counts: DataFrame, beta: float = CB_BETA, eps: float = CB_EPS, part_cols: list[str] | tuple = ()) -> DataFrame:
    """WGT2 on a counts table ``(part..., label, positive, negative)``:
    ``EN(n) = (1 - beta^max(n, eps)) / (1 - beta)`` and
    ``w = max_label(EN) / max(EN, eps)`` for positives and negatives. The max is
    over the labels of a part; the counts table has one row per label, so the
    window is over a bounded table."""
    en = counts.withColumn("en_pos", _effective_number(F.col("positive"), beta, eps)).withColumn(
        "en_neg", _effective_number(F.col("negative"), beta, eps)
    )
    w = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()
    return (
        en.withColumn("w_pos", F.max("en_pos").over(w) / F.greatest(F.col("en_pos"), F.lit(eps)))
        .withColumn("w_neg", F.max("en_neg").over(w) / F.greatest(F.col("en_neg"), F.lit(eps)))
        .drop("en_pos", "en_neg")
    )


def effective_number_weights(df: DataFrame, label_cols: list[str], beta: float = CB_BETA, eps: float = CB_EPS) -> DataFrame:
    """WGT2/WGT3 over a whole (multi-label) dataset."""
    return effective_number_weights_from_counts(label_counts(df, label_cols), beta, eps)


def class_range(top: str) -> Column:
    """Classes 0 .. ``top`` (a column); a class number that isn't a small one (an id, say) raises
    an error instead of a table as long."""
    return F.when(F.col(top) < MAX_CLASSES, F.sequence(F.lit(0), F.col(top))).otherwise(
        F.when(F.col(top).isNotNull(), F.raise_error(F.lit(f"class numbers must be below {MAX_CLASSES}")).cast("array<int>"))
    )


def onehot_weights(df: DataFrame, class_col: str, beta: float = CB_BETA, eps: float = CB_EPS) -> DataFrame:
    """WGT4: single-label integer column as a one-hot of width ``max+1``, then WGT2.
    Counts come from a grouped aggregate (no N x width expansion); classes with
    no rows get zero positives."""
    per_class = df.groupBy(F.col(class_col).alias("label")).agg(F.count(F.lit(1)).alias("positive"))
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.max(class_col).alias("mx"))
    grid = totals.select(F.explode(class_range("mx")).alias("label"), "n")
    counts = grid.join(F.broadcast(per_class), "label", "left").select(
        "label",
        F.coalesce("positive", F.lit(0)).cast("long").alias("positive"),
        (F.col("n") - F.coalesce("positive", F.lit(0))).cast("long").alias("negative"),
    )
    return effective_number_weights_from_counts(counts, beta, eps)
