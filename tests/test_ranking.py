"""Ranked tables against the row-wise operators, and the trainer's stacked options against single ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import curves, heads, losses, metrics, ranking, thresholds, train


def scored_rows(seed=3):
    """Three models of two labels: ties, scores at 0 and 1, a label with a single class."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(6):
        p = np.append(rng.random(400).round(2 if label % 2 else 9), [0.0, 1.0, 0.5, 0.5])
        y = (rng.random(len(p)) < p).astype(int) * (label != 5)
        rows += [(label, int(a), float(b)) for a, b in zip(y, p)]
    return rows


@pytest.fixture(params=[64, 1 << 17])
def tables(spark, monkeypatch, request):
    monkeypatch.setattr(ranking, "MODEL_PIECE", request.param)
    scored = spark.createDataFrame(scored_rows(), "label int, y int, prob double").repartition(3)
    return scored, ranking.Ranked.of(scored, 2)


def test_ranked_table_gives_what_its_rows_give(spark, tables):
    scored, ranked = tables
    want = {r.label: r.auc for r in curves.auc_per_label(scored).collect()}
    assert want[5] is None and {r.label: r.auc for r in metrics.auc_of_ranked(ranked).collect()} == pytest.approx(want)
    one = scored.withColumn("option", F.floor(F.col("label") / 2).cast("int"))
    for t in (0.5, 0.37):
        want = {r.option: r.asDict() for r in metrics.metric_bundle(one, t, ("option",)).collect()}
        got = {r.option: r.asDict() for r in metrics.metric_bundle(ranked, t, ("option",)).collect()}
        assert got.keys() == want.keys() and all(got[o] == pytest.approx(want[o], abs=1e-12) for o in want)
    for tune in (thresholds.tune_grid, thresholds.tune_coarse, thresholds.tune_roc):
        assert sorted(map(tuple, tune(ranked).collect())) == sorted(map(tuple, tune(scored).collect()))
    asked = {label: [-1.0, 0.0, 0.25, 0.5, 1.0, 2.0] for label in ranked.names()}
    for label, got in ranked.counts_at(asked).items():
        mine = [(y, p) for lab, y, p in scored_rows() if lab == label]
        assert got == [(sum(y and p >= t for y, p in mine), sum(not y and p >= t for y, p in mine)) for t in asked[label]]


def test_methods_compared_on_ranked_tables(spark, tables, monkeypatch):
    scored, ranked = tables
    monkeypatch.setattr(thresholds.CountIndex, "BITS", 4)
    monkeypatch.setattr(thresholds.CountIndex, "SCORES", 8)
    want = {(r.model, r.method): r.asDict() for r in thresholds.compare_methods(scored, scored, labels_per_model=2, simplex_iterations=12).collect()}
    got = {(r.model, r.method): r.asDict() for r in thresholds.compare_methods(ranked, ranked, labels_per_model=2, simplex_iterations=12).collect()}
    assert len(want) == 9 and got.keys() == want.keys()
    for k, r in want.items():
        assert {c: v for c, v in got[k].items() if isinstance(v, float)} == pytest.approx({c: v for c, v in r.items() if isinstance(v, float)}, abs=1e-12)


def test_packed_scores_rank_like_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MODEL_PIECE", 200)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(a.tolist(), [float(k) for k in b]) for a, b in zip(rng.normal(size=(900, 3)), rng.integers(0, 2, (900, 2)))], "x array<double>, y array<double>").repartition(4)
    head = heads.Linear(3, 2)
    theta = {0: head.start(0), 1: 20 * head.start(1)}
    label = (F.col("option") * 2 + F.col("label")).alias("label")
    long = train.score_options(rows, head, theta)
    packed = train.score_options(rows, head, theta, packed=True)
    got, want = (ranking.Ranked.of(d.select(label, "y", "prob"), 2) for d in (packed, long))
    assert got.stats == want.stats and len(got.of_label(0)) > 3
    assert {r.label: r.auc for r in metrics.auc_of_ranked(got).collect()} == pytest.approx({r.label: r.auc for r in curves.auc_per_label(long.select(label, "y", "prob")).collect()})


def test_repeated_scores_are_kept_once_each():
    """A piece of a few scores is as long as those, whatever its rows; so no piece grows with equal scores."""
    rng = np.random.default_rng(1)
    p, y = rng.random(8)[rng.integers(0, 8, 5000)], rng.integers(0, 2, 5000)
    keys = np.sort(ranking.score_keys(p, y))
    parts = [ranking.cut_pieces(np.sort(ranking.score_keys(p[i::3], y[i::3])), np.zeros(0))[0] for i in range(3)]
    assert all(len(k) <= 16 * 8 and c is not None for _, k, c in parts)
    both = ranking.merged([k for _, k, _ in parts], [c for _, _, c in parts])
    assert ranking.pairs_in_order(*both) == ranking.pairs_in_order(keys, None)
    mixed = ranking.merged([keys[:2500].tobytes(), parts[0][1]], [None, parts[0][2]])
    assert mixed[1].sum() == 2500 + len(p[::3])
    want = sum(2 * int((p[y == 0] < s).sum()) + int((p[y == 0] == s).sum()) for s in p[y == 1])
    assert ranking.pairs_in_order(keys, None) == (int(y.sum()), int((1 - y).sum()), want)


@pytest.mark.parametrize("settings", [(2.0, 4.0, 1.0), (0.5, 1.0, 2.0), (1.5, 2.5, 1.0)])
def test_stacked_options_equal_single_ones(settings):
    """All losses at once, far logits too: the sums of each option's own forward and backward pass."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(5000, 3)) * [1, 1, 40], (rng.random((5000, 2)) < 0.3).astype(float)
    head, pos, neg = heads.Linear(3, 2), np.array([1.7, 0.4]), np.array([0.6, 2.0])
    loss = {7 * i: heads.BlockLoss(n, pos, neg if "cb" in n else np.ones(2), *settings, 0.01) for i, n in enumerate([*losses.LOSSES, "bce", "asl"])}
    theta = {o: head.start(i) * (30 if i == 5 else 1) for i, o in enumerate(loss)}
    stacked = heads.LinearOptions(head, theta, loss)
    for val in (False, True):
        for o, got in zip(loss, stacked.sums(x, y, not val), strict=True):
            w = head.parts(theta[o])
            z, _, kept = head.forward(w, x, None)
            el, dz = loss[o](z, y)
            grad = [] if val else head.join(head.backward(w, kept, dz))
            want = np.concatenate([grad, [el.sum(), len(y)], train._counts(z, y, None)[0][:6]])
            assert got == pytest.approx(want, rel=1e-9, abs=1e-9), o
    assert not heads.LinearOptions.takes(np.array([[0.0, 0.5]]))


def test_soft_labels_and_hard_ones_in_one_pass(spark):
    """A pass takes the options together where labels are 0 or 1, and one by one where they are not."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 2)), np.where(rng.random((300, 1)) < 0.5, 1.0, 0.0)
    head = heads.Linear(2, 1)
    loss = {i: heads.BlockLoss(n, np.ones(1), np.ones(1), 2.0, 4.0, 1.0, 0.01) for i, n in enumerate(losses.LOSSES)}
    theta = {i: head.start(i) for i in loss}
    for labels in (y, 0.8 * y):
        rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, labels)], "x array<double>, y array<double>")
        got = train._gathered(train.gradient_partials(rows, head, theta, loss))
        for o in loss:
            z, _, kept = head.forward(head.parts(theta[o]), x, None)
            el, dz = loss[o](z, labels)
            want = [*head.join(head.backward(head.parts(theta[o]), kept, dz)), el.sum(), 300]
            assert got[o][0][: len(want)] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("soft", [False, True])
def test_labels_of_a_byte_are_the_labels(spark, soft):
    """Packed rows with a byte a label, and rows whose labels need doubles beside them."""
    y = F.when(F.col("id") == 7, F.lit(0.25 if soft else 1.0)).otherwise((F.col("id") % 2).cast("double"))
    rows = spark.range(0, 9000, 1, 3).select(F.array(F.col("id").cast("double"), F.lit(2.0)).alias("x"), F.array(y).alias("y"), (F.col("id") > 6500).alias("val"))
    packed = train.packed_rows(rows, small_labels=True)
    assert packed.where("b is not null").count() > 0 and packed.where("(y is null) = (b is null)").count() == 0

    def back(batches):
        import pyarrow as pa

        for val, x, y, _ in train._parts(batches):
            yield pa.table({"val": [val] * len(x), "id": x[:, 0], "y": y[:, 0].astype(float)}).to_batches()[0]

    got = packed.coalesce(1).mapInArrow(back, "val boolean, id double, y double")
    want = rows.select("val", F.col("x")[0].alias("id"), F.col("y")[0].alias("y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_runs_log_sorts_scores_in_pieces(spark, monkeypatch):
    """The tuning and evaluation of many runs read pieces of sorted scores, not a row per score and option."""
    from strata.plans import catalog_models as m
    from tests.conftest import SF_SMALL

    seen, real, fit = [], m.thresholds.compare_methods, m.train.fit_many
    monkeypatch.setattr(m.thresholds, "compare_methods", lambda v, t, **k: seen.append((v, t)) or real(v, t, **k))
    monkeypatch.setattr(m.train, "fit_many", lambda *a, **k: fit(*a, **k | {"epochs": 1}))
    m._runs_log(spark, SF_SMALL, [("bce", 0), ("asl", 1)]).collect()
    ((val, test),) = seen
    assert all(isinstance(t, ranking.Ranked) and len(t.names()) == 8 for t in (val, test))
