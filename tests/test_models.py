"""Scoring, embedding and training: distributed jobs equal plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import embed, scoring, train
from strata.plans.fixtures import rational_weights


def _weights(spec):
    return {k: rational_weights(v) * 0.3 for k, v in scoring.weight_shapes(spec).items()}


@pytest.mark.parametrize("cross,deep,kind", [
    ("standard", "bottleneck", "dcn"), ("gated", "moe", "dcn"), ("standard", "moe", "gated"), ("gated", "bottleneck", "late_mlp"),
])
def test_mapinpandas_scoring_equals_numpy(spark, cross, deep, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 5))
    t = rng.normal(size=(50, 12))
    spec = scoring.ModelSpec(input_dim=5, kind=kind, projection_dim=16, embed_dim=8, cross_type=cross, deep_type=deep,
                             text_dim=12, cross_rank=4, gated_rank=4)
    w = _weights(spec)
    rows = [(i, list(map(float, x[i])), list(map(float, t[i]))) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, features array<double>, emb array<double>").repartition(3)
    out = scoring.score(df, spec, w, text_col=None if kind == "dcn" else "emb", keep_cols=["k"]).orderBy("k").collect()
    ref, gate = scoring.forward(x, w, spec, None if kind == "dcn" else t)
    got = np.array([r["logits"] for r in out])
    assert np.max(np.abs(got - ref)) < 1e-9
    if kind == "gated":
        assert np.max(np.abs(np.array([r["gate"] for r in out]) - gate)) < 1e-9
    contract = scoring.validate_output(scoring.score(df, spec, w, text_col=None if kind == "dcn" else "emb", keep_cols=["k"]), 4).first()
    assert contract["ok"] and contract["n_rows"] == 50


def test_ratio_must_divide_dim():
    with pytest.raises(ValueError):
        scoring.ModelSpec(input_dim=3, projection_dim=6)


def test_parity_detects_mismatch(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.25)], "k long, label int, prob double")
    b = spark.createDataFrame([(1, 0, 0.5), (3, 0, 0.25)], "k long, label int, prob double")
    r = scoring.score_parity(a, b, ["k"]).first()
    assert r["n_unmatched"] == 2 and not r["verified"]
    r = scoring.score_parity(a, a, ["k"]).first()
    assert r["verified"] and r["max_abs_diff"] == 0.0


def test_hashing_embed_missing_text_and_width(spark):
    df = spark.createDataFrame([(1, None), (2, "a b a"), (3, "")], "k long, text string")
    out = {r["k"]: r["embedding"] for r in embed.embed_text(df, "k", "text").collect()}
    assert len(out[2]) == 768 and abs(np.linalg.norm(out[2]) - 1) < 1e-6
    assert out[1] == out[3]


def test_pluggable_encoder(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "k long, text string")
    enc = lambda texts: np.array([[len(t), 1.0] for t in texts])
    out = {r["k"]: r["embedding"] for r in embed.embed_text(df, "k", "text", encoder=enc, dim=2).collect()}
    assert out[7] == [7.0, 1.0]


@pytest.mark.parametrize("loss", ["bce", "focal", "asl", "cb", "cb_focal"])
def test_gradients_match_finite_differences(spark, loss):
    zs = [-2.0, -0.3, 0.4, 1.7]
    rows = [(z, y) for z in zs for y in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "z double, y double")
    kw = dict(w_pos=F.lit(1.7), w_neg=F.lit(0.6), alpha=F.lit(1.3), gamma=2.0, gamma_neg=4.0, gamma_pos=1.0, clip=0.01)
    h = 1e-6
    el, g = train.loss_and_grad(F.col("z"), F.col("y"), loss, **kw)
    lp, _ = train.loss_and_grad(F.col("z") + h, F.col("y"), loss, **kw)
    lm, _ = train.loss_and_grad(F.col("z") - h, F.col("y"), loss, **kw)
    for r in df.select(g.alias("g"), ((lp - lm) / (2 * h)).alias("fd")).collect():
        assert r["g"] == pytest.approx(r["fd"], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("loss", ["bce", "focal", "asl", "cb", "cb_focal"])
def test_badly_scored_rows_stay_in_the_gradient(spark, loss):
    """No NULL or NaN however far off a row is: it must not leave the sums."""
    rows = [(s * z, y) for z in (40.0, 800.0) for s in (1, -1) for y in (0.0, 1.0)]
    kw = dict(w_pos=F.lit(1.7), w_neg=F.lit(0.6), alpha=F.lit(1.3), gamma=2.0, gamma_neg=4.0, gamma_pos=1.0, clip=0.01)
    el, g = train.loss_and_grad(F.col("z"), F.col("y"), loss, **kw)
    got = spark.createDataFrame(rows, "z double, y double").select("z", "y", el.alias("el"), g.alias("g")).collect()
    for r in got:
        assert r["el"] is not None and r["g"] is not None and np.isfinite([r["el"], r["g"]]).all(), r
        wrong = (r["z"] > 0) != (r["y"] > 0.5)
        assert (r["el"] > 10) == wrong, r
        assert not wrong or (r["g"] < 0) == (r["y"] > 0.5) and abs(r["g"]) > 0.5, r


def test_vectorised_erf():
    import math

    x = np.concatenate([np.linspace(-7, 7, 20001), [0.0, -0.0, 1e-300, 30.0, -30.0]])
    assert np.max(np.abs(scoring._erf(x) - np.array([math.erf(v) for v in x]))) < 4e-16


def test_expert_mix_equals_a_row_at_a_time():
    import math

    rng = np.random.default_rng(8)
    spec = scoring.ModelSpec(input_dim=5, projection_dim=16, embed_dim=8, deep_type="moe")
    w = {k: rng.normal(size=v) for k, v in scoring.weight_shapes(spec).items()}
    x = rng.normal(size=(30, 16))
    got = scoring._expert_mix(x, w, "deep0", spec)
    for row, out in zip(x, got):
        z = w["deep0.gate.w"] @ row + w["deep0.gate.b"]
        best = sorted(range(4), key=lambda e: (-z[e], e))[:2]
        e = np.exp(z[best] - z[best].max())
        mixed = row.copy()
        for share, k in zip(e / e.sum(), best):
            h = w[f"deep0.e{k}.l1.w"] @ row + w[f"deep0.e{k}.l1.b"]
            h = np.array([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in h])
            mixed += share * (w[f"deep0.e{k}.l2.w"] @ h + w[f"deep0.e{k}.l2.b"])
        want = (mixed - mixed.mean()) / np.sqrt(mixed.var() + 1e-5) * w["deep0.norm.g"] + w["deep0.norm.beta"]
        assert out == pytest.approx(want, abs=1e-10)


def test_mish_scorer_equals_numpy():
    spec = scoring.ModelSpec(input_dim=5, projection_dim=16, embed_dim=8, activation="mish", cross_rank=4)
    w = _weights(spec)
    x = np.random.default_rng(1).normal(size=(7, 5))
    z = x @ w["proj.w"].T + w["proj.b"]
    n = (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5) * w["proj.ln.g"] + w["proj.ln.beta"]
    assert scoring._act(n, "mish") == pytest.approx(n * np.tanh(np.log1p(np.exp(n))), abs=1e-12)
    logits, _ = scoring.forward(x, w, spec)
    assert logits.shape == (7, 4) and np.isfinite(logits).all()
    assert not np.allclose(logits, scoring.forward(x, w, scoring.ModelSpec(input_dim=5, projection_dim=16, embed_dim=8, cross_rank=4))[0])


def test_parameters_are_stored_and_loaded(spark, tmp_path):
    m = train.LinearModel(["a", "b"], np.array([[1.5, -2.0], [0.25, 3.0]]), np.array([0.5, -0.125]))
    m.save(spark, f"{tmp_path}/m")
    back = train.LinearModel.load(spark, f"{tmp_path}/m", ["a", "b"])
    assert back.W.tolist() == m.W.tolist() and back.b.tolist() == m.b.tolist()
    spec = scoring.ModelSpec(input_dim=3, projection_dim=8, embed_dim=4)
    w = scoring.weights_from_rule(spec)
    scoring.save_weights(spark, w, f"{tmp_path}/w")
    got = scoring.load_weights(spark.read.parquet(f"{tmp_path}/w"))
    assert all((got[k] == v).all() and got[k].shape == v.shape for k, v in w.items()) and set(got) == set(w)


def test_fit_improves_auc(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    logit = np.stack([2 * x[:, 0] - x[:, 1], x[:, 2]], axis=1)
    y = (rng.random((600, 2)) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(i, *map(float, x[i]), *map(int, y[i]), "train" if i < 450 else "val") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y0 int, y1 int, split string")
    m = train.fit(df.where("split = 'train'"), df.where("split = 'val'"), ["a", "b", "c"], ["y0", "y1"], ["k"],
                  loss="bce", epochs=15, lr=0.1)
    aucs = [h["val_auc_macro"] for h in m.history]
    assert max(aucs) > 0.75 and m.best_epoch is not None
    assert m.history[-1]["train_loss"] < m.history[0]["train_loss"]


def test_lr_schedule():
    assert train.lr_at(0, 1.0) == pytest.approx(0.1)
    assert train.lr_at(20, 1.0) == pytest.approx(1.0)
    assert train.lr_at(100, 1.0) == pytest.approx(0.1)


def test_score_configs_equals_one_config_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, features array<double>").repartition(3)
    configs = []
    for cross, deep in [("standard", "bottleneck"), ("gated", "moe")]:
        spec = scoring.ModelSpec(input_dim=5, projection_dim=16, embed_dim=8, cross_type=cross, deep_type=deep, cross_rank=4, gated_rank=4)
        configs.append((spec, {k: rational_weights(v) for k, v in scoring.weight_shapes(spec).items()}))
    both = {r["k"]: r for r in scoring.score_configs(df, configs, keep_cols=["k"]).collect()}
    assert len(both) == 40
    for i, (spec, w) in enumerate(configs):
        one = {r["k"]: r for r in scoring.score(df, spec, w, keep_cols=["k"]).collect()}
        for k, r in one.items():
            assert both[k][f"logits_{i}"] == pytest.approx(r["logits"], abs=1e-12)
            assert both[k][f"probs_{i}"] == pytest.approx(r["probs"], abs=1e-12)


def test_seed_runs_are_whole_runs(spark, monkeypatch):
    """The default epochs, and the test metrics of every tuning method (two losses and one epoch here, for time)."""
    from strata.plans import catalog_models as m
    from tests.conftest import SF_SMALL

    asked, real = [], m.train.fit_many

    def fit_many(*a, **settings):
        asked.append((len(a[4]), settings.get("epochs", 50)))
        return real(*a, **settings | {"epochs": 1})

    monkeypatch.setattr(m.train, "fit_many", fit_many)
    monkeypatch.setattr(m.losses, "LOSSES", m.losses.LOSSES[:2])
    rows = m.run_seeds(spark, SF_SMALL).collect()
    assert asked == [(4, 50)]
    assert {r.n_seeds for r in rows} == {2}
    methods = {r.metric.split("/")[1] for r in rows if r.metric.count("/") == 2}
    assert len(methods) >= 3
    assert {(r.loss, f"test/{x}/f1_macro") for r in rows for x in methods} <= {(r.loss, r.metric) for r in rows}


def _one_task_rows(spark, n=4000):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(n, 5)))], "k long, features array<double>")
    spec = scoring.ModelSpec(input_dim=5, projection_dim=16, embed_dim=8, cross_rank=4, gated_rank=4)
    return rows.coalesce(1), spec, _weights(spec)


def _rows_by_task(df):
    return {r["part"]: r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()}


def test_scoring_deals_rows_of_one_task_over_all(spark):
    """A file of one row group is one task: its rows are scored by as many tasks as a shuffle has."""
    df, spec, w = _one_task_rows(spark)
    n = _rows_by_task(scoring.score(df, spec, w, keep_cols=["k"]))
    assert len(n) >= 8 and max(n.values()) < 4000 / 4 and sum(n.values()) == 4000



def test_ragged_features_raise():
    import pyarrow as pa

    with pytest.raises(ValueError, match="one length"):
        scoring._matrix(pa.array([[1.0] * 4, [1.0] * 6]))


def test_parity_of_arrays_equals_parity_of_rows(spark):
    """Missing keys, null keys and elements, repeated keys; and a key crosses the join once, not once a label."""
    a = [(1, [0.5, 0.25]), (2, [1.0, None]), (4, [0.0, 0.0]), (4, [0.5, 1.0]), (None, [1.0, 2.0])]
    b = [(1, [0.5, 0.75]), (3, [1.0, 1.0]), (4, [0.0, 0.25]), (None, [1.0, 2.0])]
    wide = [spark.createDataFrame(x, "k long, prob array<double>") for x in (a, b)]
    long = [x.select("k", F.posexplode("prob").alias("label", "prob")) for x in wide]
    assert scoring.score_parity(*wide, ["k"]).collect() == scoring.score_parity(*long, ["k"]).collect()
    same = scoring.score_parity(wide[0].where("k = 1"), wide[0].where("k = 1"), ["k"]).first()
    assert same["n_pairs"] == 2 and same["verified"]


def test_parity_query_joins_whole_rows(spark):
    from strata.plans import catalog_models as m
    from tests.conftest import SF_SMALL

    plan = m.score_parity(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "FullOuter" in plan
