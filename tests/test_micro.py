"""Hand-made micro tables (edge cases) and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from strata.operators import curves, gates, losses, metrics, prep, profile, runs, thresholds
from strata.operators.prefix import ordered_rank


def _scored(spark, rows):
    """rows: (label, y, prob)."""
    df = spark.createDataFrame(rows, "label int, y int, prob double")
    return df.withColumn("logit", F.log(F.col("prob") / (1 - F.col("prob"))))


def test_tied_scores_auc_half(spark):
    s = _scored(spark, [(0, 1, 0.5), (0, 0, 0.5), (0, 1, 0.5), (0, 0, 0.5)])
    assert curves.auc_per_label(s).first()["auc"] == pytest.approx(0.5)


def test_single_class_label(spark):
    s = _scored(spark, [(0, 1, 0.2), (0, 1, 0.7), (1, 1, 0.6), (1, 0, 0.3)])
    aucs = {r["label"]: r["auc"] for r in curves.auc_per_label(s).collect()}
    assert aucs[0] is None and aucs[1] == pytest.approx(1.0)
    b = metrics.metric_bundle(s).first()
    assert b["auc_macro"] == 0.0 and b["auc_micro"] == 0.0


def test_nothing_predicted(spark):
    s = _scored(spark, [(0, 1, 0.1), (0, 0, 0.2), (0, 1, 0.3)])
    r = metrics.per_label_scores(metrics.confusion(s)).first()
    assert (r["f1"], r["precision"], r["recall"]) == (0.0, 0.0, 0.0)
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (0, 0, 2, 1)


def test_never_positive_label_grid_default(spark):
    s = _scored(spark, [(0, 0, 0.1), (0, 0, 0.7), (1, 1, 0.8), (1, 0, 0.2)])
    t = {r["label"]: r["threshold"] for r in thresholds.tune_grid(s).collect()}
    assert t[0] == 0.5
    assert 0.2 < t[1] <= 0.8


def test_grid_ties_take_lowest_and_float_noise(spark):
    # prob 0.15 is below the np.arange element 0.15000000000000002
    s = _scored(spark, [(0, 1, 0.15), (0, 0, 0.05)])
    t = thresholds.tune_grid(s).first()
    assert t["threshold"] == pytest.approx(0.1) and t["f1"] == 1.0


def test_grid_metric_validation(spark):
    s = _scored(spark, [(0, 1, 0.5)])
    with pytest.raises(ValueError):
        thresholds.tune_grid(s, metric="precision")
    with pytest.raises(ValueError):
        thresholds.tune_roc(s, "nope")
    with pytest.raises(ValueError):
        thresholds.tune_simplex(s, "nope")


def test_zero_variance_feature(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0), (3, 3.0, 6.0)], "k int, c double, x double")
    m = prep.fit_scaler(df, ["c", "x"])
    assert m.scales[0] == 1.0 and m.means[0] == 3.0
    assert m.scales[1] == pytest.approx(np.std([1.0, 2.0, 6.0]))
    out = m.transform(df).collect()
    assert all(r["c"] == 0.0 for r in out)


def test_missing_text(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "k int, Code string")
    assert [r["Code"] for r in prep.fill_text(df, "Code").orderBy("k").collect()] == ["", "a b"]


def test_null_nan_inf_features(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), float("inf"))], "a double, b double")
    r = profile.feature_stats(df, ["a", "b"]).first()
    assert r["has_nan"] and r["has_inf"] and math.isnan(r["mean"])
    clean = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    r = profile.feature_stats(clean, ["a", "b"]).first()
    assert not r["has_nan"] and not r["has_inf"]
    assert r["mean"] == pytest.approx(2.5) and r["std"] == pytest.approx(np.std([1, 2, 3, 4]))


def test_empty_gate_class_keeps_axis(spark):
    df = spark.createDataFrame([(1, [0.2, 0.4], 0), (2, [0.6, 0.8], 2)], "vec_id long, gate array<double>, label int")
    rows = {r["class"]: r for r in gates.gate_by_class(df).collect()}
    assert sorted(rows) == [0, 1, 2]
    assert rows[1]["mean_pos"] is None and rows[1]["mean_neg"] == pytest.approx(0.5)
    assert rows[0]["mean_pos"] == pytest.approx(0.3) and rows[0]["mean_neg"] == pytest.approx(0.7)


def test_gate_histogram_constant(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.5, 0.5],)], "gate array<double>")
    h = {r["bin"]: r["count"] for r in gates.gate_histogram(df).collect()}
    assert len(h) == 50 and sum(h.values()) == 4 and h[25] == 4


def test_gate_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.random((40, 8))
    df = spark.createDataFrame([(list(map(float, v)),) for v in vals], "gate array<double>")
    h = [r["count"] for r in gates.gate_histogram(df).orderBy("bin").collect()]
    ref, _ = np.histogram(vals.ravel(), bins=50)
    assert h == ref.tolist()


def test_effective_number_equal_counts(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (1, 0), (0, 1)], "a int, b int")
    for r in prep.effective_number_weights(df, ["a", "b"]).collect():
        assert r["w_pos"] == pytest.approx(1.0) and r["w_neg"] == pytest.approx(1.0)


def test_focal_gamma0_alpha1_equals_bce(spark):
    s = _scored(spark, [(0, 1, 0.3), (0, 0, 0.8), (1, 1, 0.9), (1, 0, 0.05)])
    f = losses.loss(s, "focal", gamma=0.0).first()["loss"]
    b = losses.loss(s, "bce").first()["loss"]
    assert f == pytest.approx(b)
    p = np.array([0.3, 0.8, 0.9, 0.05])
    y = np.array([1, 0, 1, 0])
    assert b == pytest.approx(float(np.mean(-(y * np.log(p) + (1 - y) * np.log(1 - p)))))


def test_cb_equal_counts_equals_bce(spark):
    s = _scored(spark, [(0, 1, 0.3), (0, 0, 0.8), (1, 1, 0.9), (1, 0, 0.05)])
    assert losses.loss(s, "cb").first()["loss"] == pytest.approx(losses.loss(s, "bce").first()["loss"])


def test_asl_matches_numpy(spark):
    s = _scored(spark, [(0, 1, 0.3), (0, 0, 0.8), (1, 1, 0.9), (1, 0, 0.05)])
    got = losses.loss(s, "asl").first()["loss"]
    p = np.array([0.3, 0.8, 0.9, 0.05])
    y = np.array([1, 0, 1, 0])
    pn = np.minimum(1 - p + 0.01, 1)
    ref = (1 - p) ** 1 * (-y * np.log(p)) + (1 - pn) ** 4 * (-(1 - y) * np.log(1 - p))
    assert got == pytest.approx(float(ref.mean()), rel=1e-9)


def test_unknown_loss(spark):
    with pytest.raises(ValueError):
        losses.loss(_scored(spark, [(0, 1, 0.3)]), "hinge")


def test_tiny_stratum_and_split_properties(spark):
    rows = [(f"k{i}", 1 if i == 0 else 0, i % 3 == 0 and i > 0) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, a int, b boolean").withColumn("b", F.col("b").cast("int"))
    out = prep.stratified_split(df, "key", ["a", "b"]).cache()
    assert out.where("key = 'k0'").first()["split"] == "train"
    assert out.count() == 200 and out.select("key").distinct().count() == 200
    sizes = {(r["a"], r["b"], r["split"]): r["count"] for r in out.groupBy("a", "b", "split").count().collect()}
    for a, b in [(0, 0), (0, 1)]:
        n = sum(v for (x, y, _), v in sizes.items() if (x, y) == (a, b))
        assert abs(sizes[(a, b, "train")] - 0.8 * n) <= 1
        assert abs(sizes.get((a, b, "val"), 0) - 0.1 * n) <= 1


def test_rarest_strata_mode(spark):
    rows = [(f"k{i}", int(i % 2 == 0), int(i % 10 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, a int, b int")
    out = prep.stratified_split(df, "key", ["a", "b"], strata="rarest")
    rates = {(r["split"]): r["rb"] for r in out.groupBy("split").agg(F.avg("b").alias("rb")).collect()}
    assert rates["train"] == pytest.approx(0.1, abs=0.01)


def test_prefix_rank_matches_row_number_on_skew(spark):
    # one hot partition holding most rows, buckets from a hash prefix
    rows = [(0 if i % 10 else i % 7, f"{i:06d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "p int, k string").withColumn("h", F.md5("k"))
    ranked = ordered_rank(df, ["p"], [F.col("h"), F.col("k")], F.conv(F.substring("h", 1, 2), 16, 10).cast("int"), size_name="n")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("h", "k")))
    joined = ranked.join(ref, ["p", "k"])
    assert joined.where(F.col("rk") != F.col("rn")).count() == 0
    assert joined.count() == 3000


def test_auc_invariant_monotone_and_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(7)
    probs = np.round(rng.random(400), 2)
    ys = (rng.random(400) < probs).astype(int)
    s = _scored(spark, [(0, int(y), float(p)) for y, p in zip(ys, probs)])
    a = curves.auc_per_label(s).first()["auc"]
    sq = s.withColumn("prob", F.col("prob") * F.col("prob"))
    assert curves.auc_per_label(sq).first()["auc"] == pytest.approx(a)
    ev = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="yd", numBins=0)
    ref = ev.evaluate(s.withColumn("yd", F.col("y").cast("double")))
    assert a == pytest.approx(ref)


def _np_roc(y, s):
    """Reference ROC with tie grouping and drop of collinear points."""
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    thr = s[idx]
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    tps, fps, thr = tps[keep], fps[keep], thr[keep]
    return np.r_[0, fps / fps[-1]], np.r_[0, tps / tps[-1]], np.r_[np.inf, thr]


def test_roc_curve_matches_reference_algorithm(spark):
    rng = np.random.default_rng(11)
    probs = np.round(rng.random(300), 1)
    ys = (rng.random(300) < probs).astype(int)
    s = _scored(spark, [(0, int(y), float(p)) for y, p in zip(ys, probs)])
    got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in curves.roc_curve(s).collect()), key=lambda t: -t[0])
    fpr, tpr, thr = _np_roc(ys, probs)
    assert len(got) == len(thr)
    for (t, f, p), (t2, f2, p2) in zip(got, zip(thr, fpr, tpr)):
        assert t == t2 and f == pytest.approx(f2) and p == pytest.approx(p2)


def test_average_precision_and_pr(spark):
    s = _scored(spark, [(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.7), (0, 0, 0.1)])
    ap = curves.average_precision(s).first()["ap"]
    assert ap == pytest.approx(0.5 * 1.0 + 0.5 * (2 / 3))
    pr = curves.pr_curve(s).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)
    assert len(pr) == 5


def test_youden_picks_highest_on_ties_and_inf_single_class(spark):
    s = _scored(spark, [(0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.4), (1, 1, 0.6)])
    t = {r["label"]: r["threshold"] for r in thresholds.tune_roc(s).collect()}
    assert t[0] == 0.9
    assert t[1] == float("inf")


def test_simplex_not_worse_than_start(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lab in range(3):
        p = rng.random(300)
        y = (rng.random(300) < p ** (lab + 1)).astype(int)
        rows += [(lab, int(a), float(b)) for a, b in zip(y, p)]
    s = _scored(spark, rows)
    start = thresholds.tune_coarse(s)
    tuned = thresholds.tune_simplex(s, "f1_macro", n_iterations=15)
    f_start = metrics.f1_micro_macro(s, start).first()["f1_macro"]
    f_tuned = metrics.f1_micro_macro(s, tuned).first()["f1_macro"]
    assert f_tuned >= f_start - 1e-12
    assert all(0.05 <= r["threshold"] <= 0.95 for r in tuned.collect())


def test_downhill_simplex_quadratic():
    x = thresholds.downhill_simplex(lambda pts: [float(((p - np.array([1.0, -2.0])) ** 2).sum()) for p in pts], np.array([0.0, 0.0]), 400, 1e-8, 1e-12)
    assert x == pytest.approx([1.0, -2.0], abs=1e-3)


def test_early_stopping_micro(spark):
    vals = [0.5, 0.6, 0.55, 0.58, 0.59, 0.6, 0.61, 0.7, 0.1, 0.1, 0.1, 0.1, 0.1, 0.9]
    log = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vals)], "run long, epoch long, value double")
    r = runs.early_stopping(log).first()
    assert r["best_epoch"] == 8 and r["stop_epoch"] == 13 and r["best_value"] == 0.7
    never = spark.createDataFrame([(2, i + 1, float(i)) for i in range(1, 4)], "run long, epoch long, value double")
    r = runs.early_stopping(never).first()
    assert r["stop_epoch"] is None and r["best_epoch"] == 4


def test_partition_count_invariance(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 4), int(rng.random() < 0.3), float(np.round(rng.random(), 3))) for i in range(2000)]
    s = _scored(spark, rows)
    a = sorted((r["label"], round(r["auc"], 12)) for r in curves.auc_per_label(s).collect())
    b = sorted((r["label"], round(r["auc"], 12)) for r in curves.auc_per_label(s.repartition(13)).collect())
    assert a == b


def test_gate_report_rejects_non_fusion(spark):
    df = spark.createDataFrame([(1, 0.5)], "vec_id long, x double")
    with pytest.raises(ValueError):
        gates.gate_report(df, "vec_id")


def test_interpretation_columns(spark):
    df = spark.createDataFrame([([0.95, 0.99, 0.02],)], "gate array<double>").withColumn("vec_id", F.lit(1))
    rep = gates.gate_interpretation(gates.gate_report(df, "vec_id")).first()
    assert rep["behaviour"] == "selector"
    assert rep["reliance"] == "numeric" and rep["variance"] == "high"


def test_batches_reshuffle_train_only(spark):
    rows = [(f"k{i}", "train" if i % 3 else "val") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, split string")
    a = {r["key"]: r["batch_id"] for r in prep.assign_batches(df, "key", batch_size=16, epoch=0).collect()}
    b = {r["key"]: r["batch_id"] for r in prep.assign_batches(df, "key", batch_size=16, epoch=1).collect()}
    train = [k for k, s in rows if s == "train"]
    val = [k for k, s in rows if s == "val"]
    assert any(a[k] != b[k] for k in train)
    assert all(a[k] == b[k] for k in val)
    sizes = {}
    for k in train:
        sizes[a[k]] = sizes.get(a[k], 0) + 1
    assert max(sizes.values()) == 16 and sorted(sizes) == list(range(len(sizes)))


def test_grid_custom_candidates_tie_order(spark):
    # probs 0.3 / 0.6 positives, 0.1 negative: candidates 0.5 and 0.2 give F1 1/(1+...) ties
    s = _scored(spark, [(0, 1, 0.6), (0, 1, 0.3), (0, 0, 0.1)])
    # both 0.25 and 0.2 reach F1 = 1; the first in the given order wins
    t = thresholds.tune_grid(s, candidates=[0.25, 0.2, 0.7]).first()
    assert t["threshold"] == 0.25 and t["f1"] == 1.0
    t = thresholds.tune_grid(s, candidates=[0.2, 0.25, 0.7]).first()
    assert t["threshold"] == 0.2


def test_gate_stats_by_batch_prefix(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 1.0]), (0, [0.5, 0.5]), (1, [0.2, 0.4])], "batch_id long, gate array<double>"
    )
    r = gates.gate_stats_by_batch(df, prefix="eval").first()
    assert r["n_batches"] == 2
    assert r["eval/gate/mean"] == pytest.approx((0.5 + 0.3) / 2)
    assert r["eval/gate/max"] == pytest.approx((1.0 + 0.4) / 2)


def test_threshold_dispatch(spark):
    s = _scored(spark, [(0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.7), (1, 0, 0.4)])
    assert {r["label"] for r in thresholds.tune(s, "grid").collect()} == {0, 1}
    assert {r["label"] for r in thresholds.tune(s, "roc").collect()} == {0, 1}
    with pytest.raises(ValueError):
        thresholds.tune(s, "magic")


def test_onehot_weights_empty_class(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "label int")
    rows = {r["label"]: r for r in prep.onehot_weights(df, "label").collect()}
    assert sorted(rows) == [0, 1, 2]
    assert rows[1]["positive"] == 0 and rows[1]["negative"] == 3
    assert rows[1]["w_pos"] > rows[2]["w_pos"] > rows[0]["w_pos"]


def _early_stop_brute(values, patience):
    best, last_imp, stop, best_epoch, best_value = 0.0, 0, None, None, None
    for e, v in enumerate(values, 1):
        if v is not None and v > best:
            best, last_imp, best_epoch, best_value = v, e, e, v
        if e - last_imp >= patience:
            stop = e
            break
    return best_epoch, best_value, stop, len(values)


def test_early_stopping_matches_brute_force(spark):
    import random

    from strata.operators import runs

    rng = random.Random(7)
    logs, rows = {}, []
    for run in range(120):
        n = rng.randint(1, 40)
        pool = [None, -0.5, 0.0, 0.1, 0.2, 0.2, 0.3, 0.5, 0.7, 0.9]
        vals = [rng.choice(pool) if rng.random() < 0.5 else round(rng.random(), 2) for _ in range(n)]
        logs[run] = vals
        rows += [(run, e, v) for e, v in enumerate(vals, 1)]
    log = spark.createDataFrame(rows, "run long, epoch long, value double")
    for patience in (1, 3, 5):
        got = {r["run"]: (r["best_epoch"], r["best_value"], r["stop_epoch"], r["n_epochs"])
               for r in runs.early_stopping(log, patience=patience, epoch_bucket=3).collect()}
        want = {run: _early_stop_brute(v, patience) for run, v in logs.items()}
        assert got == want


def test_hash_sample_guard_and_size(spark):
    from strata.operators import prep

    def sample(k, n=100, min_rows=10):
        df = spark.createDataFrame([(f"r{i}", float(i)) for i in range(k)], "key string, x double").repartition(4)
        return prep.hash_sample(df, "key", n=n, min_rows=min_rows).collect()

    assert sample(9) == []
    assert len(sample(10)) == 10 and len(sample(57)) == 57
    rows = sample(250)
    assert len(rows) == 100 and len({r["key"] for r in rows}) == 100
    assert sorted(r["key"] for r in rows) == sorted(r["key"] for r in sample(250))
    assert len(sample(30, n=5, min_rows=20)) == 5 and sample(19, n=5, min_rows=20) == []


def test_crowded_scores_are_spread_over_buckets(spark):
    """95 % of the scores above 0.99999: no bucket holds more than a few percent of them."""
    from strata.config import SCORE_BUCKETS
    from strata.functions.columns import score_bucket

    rng = np.random.default_rng(9)
    p = np.where(rng.random(20000) < 0.95, 1 - 10.0 ** rng.uniform(-14, -5, 20000), rng.random(20000))
    df = spark.createDataFrame([(float(x),) for x in p], "score double").distinct()
    n = df.count()
    top = df.groupBy(score_bucket("score", SCORE_BUCKETS).alias("b")).count().agg(F.max("count")).first()[0]
    assert top < 0.03 * n
    ordered = df.select("score", score_bucket("score", SCORE_BUCKETS, descending=True).alias("b")).orderBy("score").collect()
    assert all(x["b"] >= y["b"] for x, y in zip(ordered, ordered[1:]))
    ends = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,)], "s double").select(score_bucket("s", 100).alias("b")).collect()
    assert [r["b"] for r in ends] == [0, 46 + 50, 0, 46 + 50] or all(0 <= r["b"] < 100 for r in ends)
    y = (rng.random(20000) < 0.5).astype(int)
    s = _scored(spark, [(0, int(a), float(b)) for a, b in zip(y, p)])
    order = np.argsort(p)
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert curves.auc_per_label(s).first()["auc"] == pytest.approx(want, abs=1e-6)


def test_split_without_ranking_equals_the_ranked_split(spark):
    import hashlib

    rows = [(f"k{i}", i % 2, int(i % 7 == 0)) for i in range(400)] + [("n1", None, 1), ("n2", None, 1), ("solo", 5, 5)]
    df = spark.createDataFrame(rows, "key string, a int, b int")
    got = {r["key"]: r["split"] for r in prep.stratified_split(df, "key", ["a", "b"], seed=3).collect()}
    assert len(got) == len(rows)
    groups = {}
    for k, a, b in rows:
        groups.setdefault((a, b), []).append(k)
    for keys in groups.values():
        keys.sort(key=lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k))
        n = len(keys)
        for i, k in enumerate(keys, start=1):
            want = "train" if i <= (8 * n + 5) // 10 else "val" if i <= (9 * n + 5) // 10 else "test"
            assert got[k] == want, (k, n, i)
    plan = prep.stratified_split(df, "key", ["a", "b"], seed=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_hot_refuses_ids(spark):
    df = spark.createDataFrame([(10**9,), (1,)], "label long")
    with pytest.raises(Exception, match="class numbers"):
        prep.onehot_weights(df, "label").collect()


def test_balanced_quotas():
    """Rare label-sets: every label's share (and the rows') within one row in every part; brute force on tiny tables."""
    import itertools
    from fractions import Fraction

    parts = (Fraction(8, 10), Fraction(1, 10), Fraction(1, 10))
    share = np.array([0.8, 0.1, 0.1])
    rng = np.random.default_rng(3)
    for n_labels, n_sets in ((3, 40), (6, 200), (12, 900), (20, 400)):
        labels = (rng.random((n_sets, n_labels)) < rng.random(n_labels) * 0.5).astype(int)
        for counts in (np.ones(n_sets, dtype=int), rng.integers(1, 9, n_sets)):
            got = prep.balanced_quotas(labels, counts, parts)
            assert (got.sum(1) == counts).all() and (np.abs(got - counts[:, None] * share) < 1).all()
            both = np.column_stack([labels, np.ones(n_sets, dtype=int)])
            assert np.abs(both.T @ got - both.T @ counts[:, None] * share).max() <= 1
    halves = (Fraction(1, 2), Fraction(1, 2))
    for _ in range(30):
        labels, counts = rng.integers(0, 2, (6, 3)), np.ones(6, dtype=int)
        both = np.column_stack([labels, np.ones(6, dtype=int)])
        error = lambda first: np.abs(both.T @ (np.array(first) - 0.5)).max()
        assert error(prep.balanced_quotas(labels, counts, halves)[:, 0]) <= max(1, min(map(error, itertools.product((0, 1), repeat=6))))


def test_iterative_split(spark):
    """Every label-set has one row, so the plain split would send all rows to train."""
    rows = [(f"k{i}", *((i >> b) & 1 for b in range(8))) for i in range(256)] + [("n", *[None] * 8)]
    names = [f"l{b}" for b in range(8)]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{n} int" for n in names))
    assert {r["split"] for r in prep.stratified_split(df, "key", names).collect()} == {"train"}
    out = prep.stratified_split(df, "key", names, strata="iterative").collect()
    assert len(out) == 257
    for part, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(r["split"] == part for r in out) - share * 257) <= 1
        for n in names:
            assert abs(sum((r[n] or 0) * (r["split"] == part) for r in out) - share * 128) <= 1
    again = prep.stratified_split(df.repartition(5), "key", names, strata="iterative").collect()
    assert {(r["key"], r["split"]) for r in out} == {(r["key"], r["split"]) for r in again}
    assert prep.stratified_split(df.limit(0), "key", names, strata="iterative").count() == 0


def test_bounded_chart(spark):
    """Few points, and no exact point further from the drawn line than the bucket's stated error."""
    rng = np.random.default_rng(9)
    p = rng.random(5000)
    rows = [(0, int(rng.random() < x), float(x)) for x in p] + [(1, 0, 0.25)] * 3
    scored = spark.createDataFrame(rows, "label int, y int, prob double").withColumn("logit", F.log(F.col("prob") / (1 - F.col("prob"))))
    exact = curves.curve_chart(scored).cache()
    few = [r for r in curves.bounded_chart(exact, 20).collect()]
    whole = {}
    for r in exact.collect():
        whole.setdefault((r["label"], r["curve"]), []).append((r["x"], r["y"], r["threshold"]))
    for key, points in whole.items():
        mine = [r for r in few if (r["label"], r["curve"]) == key]
        assert len(mine) <= 80 and {(r["x"], r["y"], r["threshold"]) for r in mine} <= set(points)
        for x, y, _ in points:
            inside = [r for r in mine if min(int(r["x"] * 20), 19) == min(int(x * 20), 19)]
            if y is None:  # a label without positives has no rate
                assert all(r["y"] is None and r["y_error"] is None for r in inside)
                continue
            low, high = min(r["y"] for r in inside), max(r["y"] for r in inside)
            assert low <= y <= high and abs(high - low - inside[0]["y_error"]) < 1e-12
            assert min(r["x"] for r in inside) <= x <= max(r["x"] for r in inside)
    assert len(whole[(0, "roc")]) > 1000
