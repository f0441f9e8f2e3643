"""Registered queries: embedding, scoring, caching and training jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import r6
from strata.operators import embed, gates, prep, scoring, vector_store
from strata.plans import fixtures as fx
from strata.plans.catalog import _f1_features, _round, _scaled, register
from strata.session import cut_lineage, spread
from strata.sources import large_csv, tables

CROSS_RANK = 2


def cross_weights(dim: int, rank: int = CROSS_RANK) -> dict[str, np.ndarray]:
    """Small rational weights of one low-rank cross layer ``x0*(V(U x0)+b)+x0``."""
    return {
        "U": fx.rational_weights((rank, dim)),
        "V": fx.rational_weights((dim, rank)),
        "b": fx.rational_weights((dim,)),
    }


def cross_numpy(df: DataFrame, key: str, feats: list[str], w: dict[str, np.ndarray]) -> DataFrame:
    """SCO2 on the raw feature columns, numpy per Arrow batch (``mapInPandas``)."""
    bw = df.sparkSession.sparkContext.broadcast(w)
    out_cols = [f"cross_{i}" for i in range(len(feats))]
    schema = f"`{key}` string, " + ", ".join(f"{c} double" for c in out_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ww = bw.value
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=np.float64)
            y = x * ((x @ ww["U"].T) @ ww["V"].T + ww["b"]) + x
            out = pd.DataFrame(y, columns=out_cols)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return df.select(key, *feats).mapInPandas(run, schema)


def cross_columns(df: DataFrame, key: str, feats: list[str], w: dict[str, np.ndarray]) -> DataFrame:
    """The same layer as JVM column expressions (codegen, no Python)."""
    x = [F.col(f).cast("double") for f in feats]
    u = [sum((F.lit(float(w["U"][j, k])) * x[k] for k in range(len(feats))), F.lit(0.0)) for j in range(w["U"].shape[0])]
    cols = []
    for i in range(len(feats)):
        inner = sum((F.lit(float(w["V"][i, j])) * u[j] for j in range(len(u))), F.lit(0.0)) + F.lit(float(w["b"][i]))
        cols.append((x[i] * inner + x[i]).alias(f"cross_{i}"))
    return df.select(key, *cols)


def _cross_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    scaled, feats = _scaled(spark, sf_dir)
    return scaled.select(fx.F1_KEY, *feats), feats


@register("score_cross")
def score_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, feats = _cross_inputs(spark, sf_dir)
    out = cross_columns(df, fx.F1_KEY, feats, cross_weights(len(feats)))
    return _round(out, [c for c in out.columns if c.startswith("cross_")])


@register("score_parity")
def score_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, feats = _cross_inputs(spark, sf_dir)
    w = cross_weights(len(feats))

    def arrays(d: DataFrame) -> DataFrame:
        return d.select(fx.F1_KEY, F.array(*[F.col(f"cross_{i}") for i in range(len(feats))]).alias("prob"))

    res = scoring.score_parity(arrays(cross_numpy(df, fx.F1_KEY, feats, w)), arrays(cross_columns(df, fx.F1_KEY, feats, w)), [fx.F1_KEY])
    return res.select("n_pairs", "n_unmatched", r6("max_abs_diff").alias("max_abs_diff"), "verified")


def _dcn_scored(spark: SparkSession, sf_dir: str, cross_type: str, deep_type: str) -> tuple[DataFrame, scoring.ModelSpec]:
    scaled, feats = _scaled(spark, sf_dir)
    spec = scoring.ModelSpec(input_dim=len(feats), cross_type=cross_type, deep_type=deep_type)
    w = scoring.weights_from_rule(spec)
    data = scaled.select(fx.F1_KEY, *fx.F1_LABELS, prep.features_array(feats).alias("features"))
    return scoring.score(data, spec, w, keep_cols=[fx.F1_KEY, *fx.F1_LABELS]), spec


@register("score_contract")
def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, spec = _dcn_scored(spark, sf_dir, "standard", "bottleneck")
    return scoring.validate_output(scored, spec.num_classes)


def _dcn_long(cross_type: str, deep_type: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored, _ = _dcn_scored(spark, sf_dir, cross_type, deep_type)
        long = scoring.to_long(scored, [fx.F1_KEY], fx.F1_LABELS)
        # 4 decimals: the engines add the layers' long sums in different orders
        return long.select(fx.F1_KEY, "label", "y", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("logit", "prob")])

    return q


register("score_dcn_bottleneck")(_dcn_long("standard", "bottleneck"))
register("score_dcn_moe")(_dcn_long("standard", "moe"))
register("score_dcn_gated")(_dcn_long("gated", "bottleneck"))


FUSION_FEATURES = ["n_chars", "n_spaces", "n_newlines"]


def fusion_spec(kind: str) -> scoring.ModelSpec:
    """The fusion scorers' architecture (numeric side on the three text counters,
    text side on the 64-wide vectors)."""
    return scoring.ModelSpec(
        input_dim=len(FUSION_FEATURES), kind=kind, projection_dim=128, embed_dim=128, cross_layers=4, deep_layers=2,
        num_classes=2, text_dim=64, cross_rank=32,
    )


def _fusion_scored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    fusion = fx.fusion_table(spark, sf_dir)
    fusion = cut_lineage(prep.stratified_split(fusion, "doc_id", ["quality", "toxic"]))
    model = prep.fit_scaler(fusion.where(F.col("split") == "train"), FUSION_FEATURES)
    data = model.transform(fusion).select(
        "doc_id", "split", "quality", "toxic", prep.features_array(FUSION_FEATURES).alias("features"), "embedding"
    )
    spec = fusion_spec(kind)
    w = scoring.weights_from_rule(spec)
    return scoring.score(data, spec, w, text_col="embedding", keep_cols=["doc_id", "split", "quality", "toxic"])


@register("score_gated_fusion")
def score_gated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _fusion_scored(spark, sf_dir, "gated")
    long = scoring.to_long(scored, ["doc_id"], ["quality", "toxic"])
    return _round(long, ["logit", "prob"])


@register("fusion_gate_stats")
def fusion_gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _fusion_scored(spark, sf_dir, "gated")
    out = gates.gate_stats(scored, group_cols=["split"])
    return _round(out, [c for c in out.columns if c != "split"])


@register("score_late_mlp")
def score_late_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _fusion_scored(spark, sf_dir, "late_mlp")
    return _round(scoring.to_long(scored, ["doc_id"], ["quality", "toxic"]), ["logit", "prob"])


@register("fusion_join")
def fusion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.fusion_table(spark, sf_dir)
    return f.select("doc_id", "quality", "toxic", "label", "n_chars", F.size("embedding").alias("emb_width"))


@register("fusion_join_cached")
def fusion_join_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 + SRC7: text features and vectors stored in buckets of the id, then joined without an exchange."""
    text = tables.write_bucketed(fx.text_table(spark, sf_dir).select("doc_id", "quality", "toxic", "n_chars"), "features", "doc_id")
    vectors = tables.write_bucketed(fx.vector_table(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "vectors", "doc_id")
    f = tables.bucketed_join(spark.table(text), spark.table(vectors), "doc_id")
    return f.select("doc_id", "quality", "toxic", "label", "n_chars", F.size("embedding").alias("emb_width"))


def _millionths(x):
    return F.round(x.cast("double") * 1e6).cast("long")


@register("embed_text")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB1 / EMB3 over all documents: the non-zero elements of each vector as
    ``dim:millionths`` pairs in order."""
    return _elements(embed.embed_text(fx.document_texts(spark, sf_dir), "doc_id", "text"))


def _elements(emb: DataFrame) -> DataFrame:
    pairs = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    text = F.transform(pairs, lambda p: F.concat_ws(":", p["i"].cast("string"), _millionths(p["x"]).cast("string")))
    return emb.select("doc_id", F.size("embedding").alias("width"), F.size(pairs).alias("n_nonzero"), F.array_join(text, ",").alias("elements"))


def _store_runs(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    """A store, and its number of texts after each of three runs: English texts, all texts, all texts again."""
    docs, store, stored = fx.document_texts(spark, sf_dir), tables.shared_folder(spark, "vectors"), []
    for part in (docs.where("lang = 'en'"), docs, docs):
        vector_store.encode_unseen(part, "text", store)
        stored.append(vector_store.read_store(spark, store).count())
    return store, stored


@register("embed_store")
def embed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB1 - EMB3 through a content-addressed store: the vectors of ``embed_text``, each distinct text encoded once."""
    store, _ = _store_runs(spark, sf_dir)
    return _elements(vector_store.stored_vectors(fx.document_texts(spark, sf_dir), "doc_id", "text", store))


@register("embed_store_runs")
def embed_store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the store after each of three runs; the third finds nothing unseen."""
    _, stored = _store_runs(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(stored, 1)), "run int, n_stored long")


@register("embedding_cache_roundtrip")
def embedding_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB2 + SRC3 + SRC4: split, scale (train fit), embed every split in one job,
    write the cache partitioned by split into the shared checkpoint folder, read
    it back with validation; sums over the elements read back, per split."""
    text = prep.stratified_split(fx.text_table(spark, sf_dir), "doc_id", ["quality", "toxic"])
    model = prep.fit_scaler(text.where(F.col("split") == "train"), FUSION_FEATURES)
    emb = embed.hashing_embed(model.transform(text), "text")
    cache = emb.select(
        "doc_id",
        "split",
        prep.features_array(FUSION_FEATURES, "float").alias("features"),
        "embedding",
        F.array(F.col("quality").cast("float"), F.col("toxic").cast("float")).alias("labels"),
    )
    path = tables.shared_folder(spark, "split-cache")
    tables.write_split_cache(cache, path)
    back = tables.read_split_cache(spark, path)
    total = lambda c: F.sum(F.aggregate(F.transform(c, _millionths), F.lit(0).cast("long"), lambda a, x: a + x))
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("embedding")).alias("emb_width"),
        F.max(F.size("features")).alias("feat_width"),
        total("embedding").alias("emb_sum"),
        F.sum(F.size(F.filter("embedding", lambda x: x != 0))).cast("long").alias("emb_nonzero"),
        (F.round(total("features") / 1e9, 3) + F.lit(0.0)).alias("feat_sum"),
        total("labels").alias("label_sum"),
    )


@register("dataset_csv_roundtrip")
def dataset_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 + PRJ4 end to end: all documents (multi-line text with quotes, some null) written as
    a dataset CSV to the shared folder, read back with header, multi-line quoting and inferred
    types, null text filled; per row the text length and md5 show the text came back byte for
    byte."""
    path = tables.shared_folder(spark, "dataset-csv")
    tables.write_dataset_csv(fx.document_texts(spark, sf_dir), path)
    back = prep.fill_text(tables.read_dataset_csv(spark, path), "text")
    return back.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@register("dataset_csv_blocks")
def dataset_csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 by many tasks a file: the documents written as large dataset CSV files are read back in
    blocks, quoted line breaks included; per row the text's length and md5."""
    texts, path = fx.document_texts(spark, sf_dir), tables.shared_folder(spark, "dataset-csv")
    tables.write_dataset_csv(texts, path, rows_per_file=5_000_000)
    back = prep.fill_text(large_csv.read_large_csv(spark, path, texts.schema), "text")
    return back.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ TRN / MET10 / RUN4

from strata.operators import heads, losses, metrics, ranking, runs, thresholds, train  # noqa: E402


@register("fit_multilabel")
def fit_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN1 + TRN2: fit the multi-label head on the scaled train split with the
    focal loss, early-stopped on validation macro-AUC; returns the metric log."""
    part, feats = _run_data(spark, sf_dir)
    return train.history_table(spark, train.fit(part["train"], part["val"], feats, fx.F1_LABELS, loss="focal", lr=0.05, seed=0))


def _run_data(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The scaled splits for the jobs of a fit to read: the split rows are written once by many tasks, the scaler is
    fitted on what was written, and its projection is part of each read."""
    f1s = fx.split_metric_table(spark, sf_dir)
    feats = _f1_features(f1s)
    rows = f1s.select(F.xxhash64(fx.F1_KEY).alias("_deal"), "split", *feats, *fx.F1_LABELS)
    data = tables.write_shared_table(spread(rows, "_deal"), "run-data", ["split"])
    scaled = prep.fit_scaler(data.where(F.col("split") == "train"), feats).transform(data)
    return {x: scaled.where(F.col("split") == x) for x in ("train", "val", "test")}, feats


def gradient_weights(n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Rule weights of the gradient query (4 labels)."""
    return fx.rational_weights((4, n_features)), fx.rational_weights((4,))


def _gradient(loss: str):
    """TRN1, one step: mean gradient of the head under a loss over the scaled train split."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        scaled, feats = _scaled(spark, sf_dir)
        tr = scaled.where(F.col("split") == "train").select(*feats, *[F.col(c).cast("double").alias(c) for c in fx.F1_LABELS])
        model = train.LinearModel(feats, *gradient_weights(len(feats)))
        weights = {l: 1.0 + l for l in range(4)}
        out = train.gradient_sums(tr, model, fx.F1_LABELS, loss, weights, {l: (1.0 + l, 0.5) for l in weights})
        rows = [
            F.struct(F.lit(l).alias("label"), F.lit(f).alias("feature"), r6(F.col(f"g{l}_{j}") / F.col("n")).alias("gradient"))
            for l in range(4) for j, f in [*enumerate(feats), ("b", "")]
        ]
        return out.select(F.inline(F.array(*rows)))

    return q


for _name in losses.LOSSES:
    register(f"gradient_{_name}")(_gradient(_name))


def _option_gradients(rows: DataFrame, head: heads.Head, n_labels: int) -> DataFrame:
    """Mean gradients (loss, parameter, position, gradient) of a head under every loss, from one pass over
    the rows: rule parameters, label weights 1, 2, .. (class-balanced ones with 0.5 for negatives)."""
    alpha = np.arange(1.0, n_labels + 1)
    cb = np.stack([alpha, np.full(n_labels, 0.5)], axis=1)
    theta = head.join({k: fx.rational_weights(s) for k, s in head.shapes().items()})
    options = {i: train.Option(loss).block_loss(alpha, cb) for i, loss in enumerate(losses.LOSSES)}
    sums = train.gradient_partials(rows, head, dict.fromkeys(options, theta), options)
    # partial sums of all partitions, block by block; then one row per parameter element
    flat = sums.select("option", F.posexplode("sums").alias("k", "value"), "block").groupBy(
        "option", (F.col("block") * train.BLOCK + F.col("k")).alias("k")
    ).agg(F.sum("value").alias("value"))
    n = flat.where(F.col("k") == head.size() + 1).select("option", F.col("value").alias("n"))
    names, at = [], 0
    for name, shape in head.shapes().items():
        size = int(np.prod(shape))
        names.append(F.when((F.col("k") >= at) & (F.col("k") < at + size), F.struct(F.lit(name).alias("parameter"), (F.col("k") - at).cast("int").alias("position"))))
        at += size
    loss = F.element_at(F.array(*map(F.lit, losses.LOSSES)), F.col("option") + 1)
    return flat.where(F.col("k") < head.size()).join(n, "option").select(
        loss.alias("loss"), F.inline(F.array(F.coalesce(*names))), (F.col("value") / F.col("n")).alias("gradient")
    ).select("loss", "parameter", "position", r6("gradient").alias("gradient"))


def cross_head(n_features: int) -> heads.LowRankCross:
    return heads.LowRankCross(n_features, 4, layers=3, rank=2)


@register("gradient_cross")
def gradient_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN1, one step of the low-rank cross head: three layers, all losses in one pass over the scaled
    train split."""
    scaled, feats = _scaled(spark, sf_dir)
    rows = train.block_rows(scaled.where(F.col("split") == "train"), feats, fx.F1_LABELS)
    return _option_gradients(rows, cross_head(len(feats)), 4)


def fusion_head() -> heads.GatedFusion:
    return heads.GatedFusion(len(FUSION_FEATURES), 64, 2, embed_dim=8)


@register("gradient_fusion")
def gradient_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN1, one step of the gated-fusion head (numeric and text projection, gate, classifier): all
    losses in one pass over the train split of the joined text and vector tables."""
    fusion = tables.write_shared_table(prep.stratified_split(fx.fusion_table(spark, sf_dir), "doc_id", ["quality", "toxic"]), "fusion-split", ["split"])
    tr = fusion.where(F.col("split") == "train")
    scaled = prep.fit_scaler(tr, FUSION_FEATURES).transform(tr)
    return _option_gradients(train.block_rows(scaled, FUSION_FEATURES, ["quality", "toxic"], "embedding"), fusion_head(), 2)


@register("evaluate_split")
def evaluate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET10: score the test split with the gated-fusion scorer once and derive
    loss, metric bundle and gate statistics from the same persisted scored table."""
    # the scorer output feeds three aggregates: materialise it once (one Python pass)
    scored_wide = cut_lineage(_fusion_scored(spark, sf_dir, "gated").where(F.col("split") == "test"))
    long = scoring.to_long(scored_wide, ["doc_id"], ["quality", "toxic"])
    loss = losses.loss(long, "bce").select(F.lit("loss").alias("metric"), F.col("loss").alias("value"))
    bundle = metrics.metric_bundle(long)
    b = bundle.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in bundle.columns])))
    g = gates.gate_stats(scored_wide)
    gs = g.select(F.inline(F.array(*[F.struct(F.lit(f"eval/gate/{c}").alias("metric"), F.col(c).alias("value")) for c in g.columns])))
    out = loss.unionByName(b).unionByName(gs)
    return out.select("metric", r6("value").alias("value"))


@register("run_grid")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN3 + RUN4 + RUN5: score the test split with every (cross, deep)
    configuration and gather the metric bundles into one table. All
    configurations are scored in one pass, written once, and each bundle reads
    its own two array columns."""
    scaled, feats = _scaled(spark, sf_dir)
    test = scaled.where(F.col("split") == "test").select(
        fx.F1_KEY, *fx.F1_LABELS, prep.features_array(feats).alias("features")
    )
    grid = runs.config_grid()
    configs = []
    for _, cross_type, deep_type in grid:
        spec = scoring.ModelSpec(input_dim=len(feats), cross_type=cross_type, deep_type=deep_type)
        configs.append((spec, scoring.weights_from_rule(spec)))
    wide = cut_lineage(scoring.score_configs(test, configs, keep_cols=[fx.F1_KEY, *fx.F1_LABELS]))
    # one long table with the configuration as a group, one bundle for all of them
    config = F.array(*[F.struct(F.lit(c).alias("cross_type"), F.lit(d).alias("deep_type"), F.col(f"logits_{i}").alias("logits"), F.col(f"probs_{i}").alias("probs")) for i, (_, c, d) in enumerate(grid)])
    long = scoring.to_long(wide.select(fx.F1_KEY, *fx.F1_LABELS, F.inline(config)), [fx.F1_KEY, "cross_type", "deep_type"], fx.F1_LABELS)
    out = metrics.metric_bundle(long, group_cols=("cross_type", "deep_type"))
    out = out.withColumn("run_name", runs.run_name("cross_type", "deep_type"))
    return _round(out, ["acc", "f1_micro", "f1_macro", "auc_micro", "auc_macro"])


@register("run_pipeline")
def run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end-to-end run: fit on train (early stop on val), store and reload the best parameters,
    tune thresholds on val with all three methods, evaluate each on test, append the epochs and
    the test record to the metric log, and return the log as it reads back."""
    return _runs_log(spark, sf_dir, [("focal", 0)])


@register("run_seeds")
def run_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN1 + RUN4 on real fits: every loss with two seeds, each fitted, tuned and evaluated like
    ``run_pipeline``; mean and std of the test metrics."""
    log = _runs_log(spark, sf_dir, [(loss, seed) for loss in losses.LOSSES for seed in (0, 1)])
    test = log.where(F.col("metric").startswith("test/")).withColumn("loss", F.element_at(F.array(*map(F.lit, losses.LOSSES)), (F.col("run") + 1).cast("int")))
    return _round(test.groupBy("loss", "metric").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), ["mean", "std"])


def _runs_log(spark: SparkSession, sf_dir: str, options: list[tuple[str, int]]) -> DataFrame:
    """Metric log of one fit per (loss, seed); ``run`` is the loss's number. All fits share the jobs
    of their epochs, of the threshold search and of the evaluation."""
    part, feats = _run_data(spark, sf_dir)
    fitted = train.fit_many(part["train"], part["val"], feats, fx.F1_LABELS, [train.Option(loss, seed, lr=0.05) for loss, seed in options])
    folder, labels = tables.shared_folder(spark, "run-models"), len(fx.F1_LABELS)
    train.save_fitted(spark, fitted, folder)
    best = train.load_thetas(spark, folder)

    def ranked(split: str) -> ranking.Ranked:
        scored = train.score_options(train.block_rows(part[split], feats, fx.F1_LABELS), fitted[0].head, best, packed=True)
        return ranking.Ranked.of(scored.select((F.col("option") * labels + F.col("label")).alias("label"), "y", "prob"), labels)

    val, test = ranked("val"), ranked("test")  # an option is a model
    tuned = thresholds.compare_methods(val, test, labels_per_model=labels).collect()  # a row per option and method
    bundles = metrics.metric_bundle(test, group_cols=("option",)).collect()  # a row per option
    rows = []
    for i, (loss, seed) in enumerate(options):
        run = losses.LOSSES.index(loss)
        rows += train.history_rows(fitted[i].history, run, seed)
        record = [(f"test/{k}", b[k]) for b in bundles if b["option"] == i for k in b.asDict() if k != "option"]
        record += [(f"test/{r['method']}/{k}", r[k]) for r in tuned if r["model"] == i for k in ("f1_micro", "f1_macro", "precision_macro", "recall_macro")]
        rows += [(run, seed, fitted[i].best_epoch or 0, k, float(v)) for k, v in record]
    log = tables.shared_folder(spark, "run-log")
    tables.write_metric_log(spark.createDataFrame(rows, tables.LOG_SCHEMA).coalesce(1), log)
    return tables.read_metric_log(spark, log)


# ------------------------------------------------------------------ streaming


@register("stream_confusion")
def stream_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test split of the scored table, written as parquet to the shared
    folder and consumed as a stream (several files per trigger); running
    per-label confusion counts at 0.5, equal to the batch confusion."""
    from strata.streaming import scored_stream

    base = tables.shared_folder(spark, "stream")
    scored = fx.scored_table(spark, sf_dir).where(F.col("split") == "test").select("row_key", "label", "y", "prob", "logit")
    scored.write.parquet(f"{base}/in")
    stream = scored_stream.read_scored_stream(spark, f"{base}/in", scored.schema, max_files_per_trigger=2)
    out = scored_stream.run_to_table(scored_stream.running_confusion(stream), f"{base}/out")
    return spark.read.parquet(out)


@register("metric_log_repeat")
def metric_log_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: all runs logged with values one too high, the odd runs repeated with the right values, and an attempt
    of the even runs that ends before its commit; readers find one set of records per run."""
    log = fx.metric_log(spark, sf_dir).select("run", (F.col("run") % 3).alias("seed"), "epoch", "metric", "value")
    odd, high = F.col("run") % 2 == 1, log.withColumn("value", F.col("value") + 1)
    path = tables.shared_folder(spark, "metric-runs")
    tables.write_metric_log(high, path)
    tables.write_metric_log(log.where(odd), path)
    tables.write_metric_records(log.where(~odd), path)
    return tables.read_metric_log(spark, path).groupBy("metric", odd.alias("repeated")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("n_runs"), r6(F.sum("value")).alias("value_sum")
    )


@register("metric_log_sink")
def metric_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: append the metric log (one record per run, epoch and metric) to a
    parquet log in the shared folder in two appends, read it back and count
    records per metric."""
    log = fx.metric_log(spark, sf_dir).select(
        "run", (F.col("run") % 3).alias("seed"), "epoch", "metric", "value"
    )
    path = tables.shared_folder(spark, "metric-log")
    tables.append_metric_log(log.where(F.col("epoch") % 2 == 0), path)
    tables.append_metric_log(log.where(F.col("epoch") % 2 == 1), path)
    back = spark.read.parquet(path)
    return back.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("n_runs"), r6(F.sum("value")).alias("value_sum")
    )
