"""Trainable heads and the many-option trainer against finite differences, column expressions and plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import heads, losses, prep, train
from strata.plans.fixtures import rational_weights

HEADS = [heads.Linear(3, 2), heads.LowRankCross(3, 2, layers=3, rank=2), heads.GatedFusion(3, 6, 2, embed_dim=4)]


def block_loss(name, labels=2):
    pos, neg = np.linspace(0.7, 1.9, labels), np.linspace(1.1, 0.4, labels)
    return heads.BlockLoss(name, pos, neg if name in ("cb", "cb_focal") else np.ones(labels), 2.0, 4.0, 1.0, 0.01)


def blocks(n=40, text=6, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)), rng.integers(0, 2, (n, 2)).astype(float), rng.normal(size=(n, text))


@pytest.mark.parametrize("head", HEADS, ids=lambda h: type(h).__name__)
@pytest.mark.parametrize("name", losses.LOSSES)
def test_gradients_match_finite_differences(head, name):
    x, y, t = blocks()
    loss = block_loss(name)
    theta = head.start(3)

    def total(v):
        return loss(head.forward(head.parts(v), x, t)[0], y)[0].sum()

    z, _, kept = head.forward(head.parts(theta), x, t)
    got = head.join(head.backward(head.parts(theta), kept, loss(z, y)[1]))
    for k in range(head.size()):
        step = np.zeros(head.size())
        step[k] = 1e-6
        assert got[k] == pytest.approx((total(theta + step) - total(theta - step)) / 2e-6, rel=2e-4, abs=2e-5), k


@pytest.mark.parametrize("name", losses.LOSSES)
def test_block_losses_are_the_column_losses(spark, name):
    z = np.array([-900.0, -40.0, -3.0, -0.2, 0.0, 0.4, 5.0, 40.0, 900.0])
    rows = [(float(v), y) for v in z for y in (0.0, 1.0)]
    kw = dict(w_pos=F.lit(1.7), w_neg=F.lit(0.6), alpha=F.lit(1.7), gamma=2.0, gamma_neg=4.0, gamma_pos=1.0, clip=0.01)
    el, g = train.loss_and_grad(F.col("z"), F.col("y"), name, **kw)
    want = spark.createDataFrame(rows, "z double, y double").select(el.alias("el"), g.alias("g")).collect()
    loss = heads.BlockLoss(name, np.array([1.7]), np.array([0.6 if name in ("cb", "cb_focal") else 1.0]), 2.0, 4.0, 1.0, 0.01)
    el, g = loss(np.array([[r[0]] for r in rows]), np.array([[r[1]] for r in rows]))
    assert el[:, 0] == pytest.approx([r.el for r in want], rel=1e-9, abs=1e-12)
    assert g[:, 0] == pytest.approx([r.g for r in want], rel=1e-9, abs=1e-12)


def table(spark, n=600, seed=2, text=6):
    rng = np.random.default_rng(seed)
    x, t = rng.normal(size=(n, 3)), rng.normal(size=(n, text))
    logit = np.stack([2 * x[:, 0] - x[:, 1] + t[:, 0], x[:, 2] + x[:, 0] * x[:, 1]], axis=1)
    y = (rng.random((n, 2)) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(i, *map(float, x[i]), t[i].tolist(), *map(int, y[i]), "train" if i < 0.75 * n else "val") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, t array<double>, y0 int, y1 int, split string")
    return df.where("split = 'train'"), df.where("split = 'val'")


FEATURES, LABELS = ["a", "b", "c"], ["y0", "y1"]


@pytest.mark.parametrize("head", HEADS, ids=lambda h: type(h).__name__)
def test_partials_over_many_partitions_equal_one_block(spark, head, monkeypatch):
    monkeypatch.setattr(train, "BLOCK", 7)
    tr, _ = table(spark)
    rows = train.block_rows(tr, FEATURES, LABELS, "t" if head.reads_text else None)
    theta = {0: head.start(1), 4: head.start(2)}
    loss = {0: block_loss("bce"), 4: block_loss("asl")}
    got = train._gathered(train.gradient_partials(rows.repartition(23), head, theta, loss))
    pdf = tr.toPandas()
    x, y, t = pdf[FEATURES].to_numpy(), pdf[LABELS].to_numpy(float), np.array(pdf["t"].tolist())
    for option in theta:
        w = head.parts(theta[option])
        z, gate, kept = head.forward(w, x, t)
        el, dz = loss[option](z, y)
        counts, most = train._counts(z, y, gate)
        want = np.concatenate([head.join(head.backward(w, kept, dz)), [el.sum(), len(y)], counts])
        assert got[option][0] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert got[option][1].tolist() == most.tolist()


def test_linear_partials_equal_the_column_aggregate(spark):
    tr, _ = table(spark)
    head = heads.Linear(3, 2)
    w, b = rational_weights((2, 3)), rational_weights((2,))
    alpha, cb = {0: 1.5, 1: 0.5}, {0: (1.2, 0.3), 1: (0.9, 1.1)}
    for name in losses.LOSSES:
        want = train.gradient_sums(tr, train.LinearModel(FEATURES, w, b), LABELS, name, alpha, cb).first()
        loss = train.Option(name).block_loss(np.array([1.5, 0.5]), np.array([cb[0], cb[1]]))
        rows = train.block_rows(tr, FEATURES, LABELS)
        got = train._gathered(train.gradient_partials(rows, head, {0: head.join({"W": w, "b": b})}, {0: loss}))[0][0]
        flat = [want[f"g{l}_{j}"] for l in range(2) for j in range(3)] + [want[f"g{l}_b"] for l in range(2)] + [want["loss_sum"], want["n"]]
        assert got[: len(flat)] == pytest.approx(flat, rel=1e-9)


def test_many_options_equal_single_fits(spark):
    tr, va = table(spark, 400)
    options = [train.Option(loss, seed, lr=0.1) for loss in ("bce", "asl", "cb_focal") for seed in (0, 1)]
    many = train.fit_many(tr, va, FEATURES, LABELS, options, epochs=6, patience=2)
    for option, f in zip(options, many, strict=True):
        one = train.fit_many(tr, va, FEATURES, LABELS, [option], epochs=6, patience=2)[0]
        assert one.theta == pytest.approx(f.theta, abs=1e-9)
        assert one.best_epoch == f.best_epoch and len(one.history) == len(f.history)
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for a, b in zip(one.history, f.history, strict=True) for k in a)


def test_stored_parameters_come_back(spark, tmp_path):
    fitted = [train.Fitted(h, train.Option(), h.start(i)) for i, h in enumerate(HEADS)]
    train.save_fitted(spark, fitted, f"{tmp_path}/m")
    back = train.load_thetas(spark, f"{tmp_path}/m")
    assert all((back[i] == f.theta).all() for i, f in enumerate(fitted)) and len(back) == 3


@pytest.mark.parametrize("head", HEADS[1:], ids=lambda h: type(h).__name__)
def test_deeper_heads_learn(spark, head):
    tr, va = table(spark)
    got = train.fit_many(tr, va, FEATURES, LABELS, [train.Option(lr=0.1)], head=head, text_col="t", epochs=25, patience=25)[0]
    assert got.history[-1]["train_loss"] < 0.9 * got.history[0]["train_loss"]
    assert max(h["val_auc_macro"] for h in got.history) > 0.7
    gate = {f"{p}/gate/{k}" for p in ("train", "eval") for k in ("mean", "std", "min", "max", "near_zero", "near_one")}
    for h in got.history:
        assert gate <= set(h) if head.reads_text else not gate & set(h)
        assert {"train/acc", "train/f1_macro", "eval/acc", "eval/f1_macro", "val_loss"} <= set(h)
        if head.reads_text:
            assert 0 < h["train/gate/min"] <= h["train/gate/mean"] <= h["train/gate/max"] < 1


def test_epoch_log_equals_the_metrics_of_its_scores(spark):
    from strata.operators import metrics

    tr, va = table(spark, 300)
    f = train.fit_many(tr, va, FEATURES, LABELS, [train.Option(lr=0.1)], epochs=1)[0]
    scored = train.score_options(train.block_rows(va, FEATURES, LABELS), f.head, {0: f.theta})
    want, h = metrics.metric_bundle(scored).first(), f.history[0]
    assert (h["eval/acc"], h["eval/f1_micro"], h["eval/f1_macro"]) == pytest.approx((want.acc, want.f1_micro, want.f1_macro))
    assert h["val_auc_macro"] == pytest.approx(want.auc_macro)


def test_mini_batches_of_one_partition_equal_a_plain_loop(spark):
    tr, va = table(spark, 300)
    batched = prep.assign_batches(tr, "k", batch_size=32).coalesce(1)
    option = train.Option("focal", 5, lr=0.05)
    f = train.fit_many(batched, va, FEATURES, LABELS, [option], batch_col="batch_id", epochs=3, patience=9)[0]
    alpha, cb = train._loss_weights(tr, LABELS, 0.9999)
    head, loss = heads.Linear(3, 2), option.block_loss(alpha, cb)
    pdf = batched.toPandas()
    theta = head.start(5)
    m, v, steps, seen = np.zeros_like(theta), np.zeros_like(theta), 0, {}
    for epoch in range(3):
        lr = train.lr_at(epoch, 0.05)
        for b in sorted(set(pdf.batch_id)):
            rows = pdf[pdf.batch_id == b]
            x, y = rows[FEATURES].to_numpy(), rows[LABELS].to_numpy(float)
            z, _, kept = head.forward(head.parts(theta), x, None)
            g = head.join(head.backward(head.parts(theta), kept, loss(z, y)[1])) / len(y)
            g = g * min(1.0, 1.0 / (np.linalg.norm(g) + 1e-6)) if np.linalg.norm(g) > 1 else g
            steps += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - lr * 0.01 * theta - lr * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        seen[epoch + 1] = theta
    assert f.theta == pytest.approx(seen[f.best_epoch], abs=1e-9)


def test_mini_batches_over_partitions_converge_like_full_batches(spark):
    tr, va = table(spark, 1200)
    batched = prep.assign_batches(tr, "k", batch_size=64).repartition(6)
    local = train.fit_many(batched, va, FEATURES, LABELS, [train.Option(lr=0.05)], batch_col="batch_id", epochs=10, patience=10)[0]
    full = train.fit_many(tr, va, FEATURES, LABELS, [train.Option(lr=0.05)], epochs=25, patience=25)[0]
    assert local.history[-1]["train_loss"] <= full.history[-1]["train_loss"] + 0.02
    assert max(h["val_auc_macro"] for h in local.history) > max(h["val_auc_macro"] for h in full.history) - 0.02
    again = train.fit_many(batched, va, FEATURES, LABELS, [train.Option(lr=0.05)], batch_col="batch_id", epochs=2)[0]
    assert [h["train_loss"] for h in again.history] == [h["train_loss"] for h in local.history[:2]]


def test_simplexes_that_share_jobs_equal_single_ones(spark):
    from strata.operators import thresholds

    rng = np.random.default_rng(8)
    rows = [(lab, int(rng.random() < p), float(p)) for lab in range(6) for p in rng.random(150).round(2)]
    scored = spark.createDataFrame(rows, "label int, y int, prob double")
    both = {r.label: r.threshold for r in thresholds.tune_simplex(scored, labels_per_model=2, n_iterations=12).collect()}
    for model in range(3):
        one = thresholds.tune_simplex(scored.where(F.floor(F.col("label") / 2) == model), n_iterations=12).collect()
        assert {r.label: r.threshold for r in one} == {2 * model + k: both[2 * model + k] for k in range(2)}
    both = thresholds.compare_methods(scored, scored, simplex_iterations=5, labels_per_model=2)
    one = thresholds.compare_methods(scored.where("label < 2"), scored.where("label < 2"), simplex_iterations=5)
    assert sorted(map(tuple, both.where("model = 0").drop("model").collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("metric", ["f1_macro", "f1_micro", "balanced_acc"])
def test_simplex_over_the_count_index_is_exact_and_takes_few_jobs(spark, metric, monkeypatch):
    """The search over the index equals one over plain counts, also where buckets hold too many scores."""
    from strata.operators import curves, thresholds

    monkeypatch.setattr(thresholds.CountIndex, "BITS", 4)
    monkeypatch.setattr(thresholds.CountIndex, "SCORES", 8)
    indexes, real = [], thresholds.CountIndex

    def made(steps):
        indexes.append(real(steps))
        return indexes[-1]

    rng = np.random.default_rng(9)
    data = {lab: [(float(p), int(rng.random() < p)) for p in np.append(rng.beta(2, 3, 800), [0.0, 1.0, 0.5])] for lab in range(3)}
    scored = spark.createDataFrame([(lab, y, p) for lab, rows in data.items() for p, y in rows], "label int, y int, prob double")
    monkeypatch.setattr(thresholds, "CountIndex", made)
    got = {r.label: r.threshold for r in thresholds.tune_simplex(scored, metric, 25).collect()}
    start = {r.label: r.threshold for r in thresholds.tune_coarse(scored).collect()}
    P, N = (np.array([sum(y == k for _, y in data[lab]) for lab in range(3)], float) for k in (1, 0))

    def height(point):
        tp, fp = (np.array([sum(y == k and p >= t for p, y in data[lab]) for lab, t in enumerate(point)], float) for k in (1, 0))
        return -thresholds._metric_value(metric, tp, fp, P, N)

    best = thresholds.downhill_simplex(lambda pts: [height(p) for p in pts], np.array([start[lab] for lab in range(3)]), 25)
    assert got == {lab: float(np.clip(best[lab], 0.05, 0.95)) for lab in range(3)}
    assert indexes[0].jobs <= 12
    for t in (-0.1, 0.0, 0.3, 0.5, 1.0, 1.5):
        index = real(curves.score_counts(scored))
        while True:
            tp = index.from_(1, t)
            if not index.missing:
                break
            index.fetch()
        assert tp == (sum(y and p >= t for p, y in data[1]), sum(not y and p >= t for p, y in data[1]))


def test_auc_of_scores_equals_auc_from_counts(spark):
    from strata.operators import curves

    rng = np.random.default_rng(10)
    rows = [(int(g), int(rng.random() < 0.4), float(p)) for g in range(3) for p in rng.random(300).round(2)] + [(7, 1, 0.5)]
    scored = spark.createDataFrame(rows, "label int, y int, prob double")
    want = {r.label: r.auc for r in curves.auc_per_label(scored).collect()}
    assert {r.label: r.auc for r in curves.auc_of_scores(scored, ["label"]).collect()} == pytest.approx(want)


def test_fit_rows_are_dealt_over_the_tasks(spark):
    """The splits of a fit come from a file of one row group, yet many tasks hold their rows."""
    from strata.plans import catalog_models
    from tests.conftest import SF_SMALL

    part, _ = catalog_models._run_data(spark, SF_SMALL)
    files = {r[0]: r[1] for r in part["train"].groupBy(F.input_file_name()).count().collect()}
    assert len(files) >= 8 and max(files.values()) < sum(files.values()) / 4


@pytest.mark.parametrize("piece", [50, 1 << 18])
def test_ranked_pieces_give_the_exact_auc(spark, monkeypatch, piece):
    """Scores cut into many pieces, ties (also at a cut) and a single-class label included."""
    monkeypatch.setattr(train, "PIECE_SCORES", piece)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 2)), 1)
    y = (rng.random((900, 2)) < 0.3).astype(int)
    rows = [(*map(float, a), *map(int, b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, y0 int, y1 int").repartition(5)
    head = heads.Linear(2, 2)
    theta = {0: head.start(1), 3: head.join({"W": np.array([[1.0, 0.0], [0.0, 50.0]]), "b": np.zeros(2)})}
    val = train.Validation.of(train.packed_rows(train.block_rows(df, ["a", "b"], ["y0", "y1"])))
    assert val.pieces == -(-900 // piece)
    got = train._validate(val, head, theta, 2)
    for o, th in theta.items():
        p = heads.sigmoid(head.forward(head.parts(th), x, None)[0])
        want = [np.mean([(u > v) + (u == v) / 2 for u in p[y[:, l] == 1, l] for v in p[y[:, l] == 0, l]]) for l in (0, 1)]
        assert got[o]["val_auc_macro"] == pytest.approx(np.mean(want), abs=1e-12)
    one = train.Validation.of(train.packed_rows(train.block_rows(df.withColumn("y1", F.lit(0)), ["a", "b"], ["y0", "y1"])))
    assert train._validate(one, head, theta, 2)[0] == {"val_auc_macro": 0.0}


def test_packed_rows_hold_the_rows(spark):
    rows = spark.range(2500).select(F.array(F.col("id").cast("double"), F.lit(2.0)).alias("x"), F.array((F.col("id") % 2).cast("double")).alias("y"), (F.col("id") % 3 == 0).alias("val"))
    got = [(r.val, *v) for r in train.packed_rows(rows).collect() for v in np.column_stack([np.frombuffer(r.x).reshape(r.n, 2), np.frombuffer(r.y).reshape(r.n, 1)]).tolist()]
    assert sorted(got) == sorted((i % 3 == 0, float(i), 2.0, float(i % 2)) for i in range(2500))
