"""Model-shaped tables derived by Spark from the given parquet tables.

F1 metric table (dataset shape), F2 scored table (prediction shape), F3 text /
vector / fusion tables, F4 gate table and F5 metric log. Every builder reads
the source tables and scales with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import SEED
from strata.operators.prefix import ordered_rank
from strata.operators.prep import stratified_split
from strata.sources.tables import read_table

F1_IDS = ["l_orderkey", "l_partkey", "l_suppkey"]
F1_LABELS = ["y0", "y1", "y2", "y3"]
F1_KEY = "row_key"


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a code-metric dataset with four 0/1 labels."""
    li = read_table(spark, sf_dir, "lineitem")
    key = F.concat_ws(
        ":",
        *[F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]],
        F.col("l_quantity").cast("int").cast("string"),
    )
    return li.select(
        key.alias(F1_KEY),
        *F1_IDS,
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
        (F.col("l_returnflag") == "R").cast("int").alias("y0"),
        (F.col("l_linestatus") == "O").cast("int").alias("y1"),
        (F.col("l_discount") >= F.lit(0.085)).cast("int").alias("y2"),
        (F.col("l_quantity") >= F.lit(49.0)).cast("int").alias("y3"),
    )


def split_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with its stratified split column."""
    return stratified_split(metric_table(spark, sf_dir), F1_KEY, F1_LABELS, seed=SEED)


MONTH_LABELS = [f"m{m}" for m in range(1, 13)]


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with many sparse label-sets: one row per order, ``m1..m12`` tell the months its lines ship in."""
    month = F.month("l_shipdate")
    labels = [F.max((month == m).cast("int")).alias(c) for m, c in enumerate(MONTH_LABELS, 1)]
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*labels)


# F1 columns the F2 scores are computed from
SCORE_INPUTS = [F1_KEY, "split", "l_partkey", "l_quantity", "l_discount", "l_tax", *F1_LABELS]


def _prob(numerator: Column) -> Column:
    return numerator.cast("double") / F.lit(1000.0)


def scored_table(spark: SparkSession, sf_dir: str, with_split: bool = True) -> DataFrame:
    """F2: long scored table ``(row_key, split, label, y, prob, logit)``, four rows
    per F1 row; scores are integer numerators over 1000 (no transcendental
    functions, so both engines agree on ties)."""
    base = split_metric_table(spark, sf_dir) if with_split else metric_table(spark, sf_dir).withColumn("split", F.lit("all"))
    return scored_from(base)


def scored_from(base: DataFrame, extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """F2 rows for an F1-shaped table carrying ``split`` (and ``extra_cols``)."""
    q = F.col("l_quantity").cast("int")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    h = (F.col("l_partkey") % 97).cast("int")
    per_label = [
        (0, "y0", _prob(F.lit(100) + 8 * q + 250 * F.col("y0") + h)),
        (1, "y1", _prob(F.lit(200) + 60 * t + 40 * F.col("y1") + h)),
        (2, "y2", _prob(F.lit(20) + 70 * d + 2 * h)),
        (3, "y3", _prob(F.lit(5) + 15 * q + h)),
    ]
    rows = [F.struct(F.lit(i).alias("label"), F.col(y).alias("y"), p.alias("prob")) for i, y, p in per_label]
    long = base.select(F1_KEY, "split", *extra_cols, F.inline(F.array(*rows)))
    return long.withColumn("logit", F.log(F.col("prob") / (F.lit(1.0) - F.col("prob"))))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, labelled or not, as ``(doc_id, text, lang)``, and beside every seventh one a row
    without a text (its id is -1 minus the document's), so that null handling is really exercised."""
    docs = read_table(spark, sf_dir, "documents")
    row = F.struct("doc_id", "text", "lang")
    empty = F.struct((F.lit(-1) - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang")
    return docs.select(F.inline(F.when(F.col("doc_id") % 7 == 3, F.array(row, empty)).otherwise(F.array(row))))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3a: labelled documents with text counters."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.join(labels, "doc_id").select(
        "doc_id",
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, " ", ""))).cast("long").alias("n_spaces"),
        (F.length(text) - F.length(F.regexp_replace(text, "\n", ""))).cast("long").alias("n_newlines"),
        "quality",
        "toxic",
    )


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3b: ``(vec_id, embedding array<float>, label)``."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def fusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3c / SRC7: text rows joined to their vectors by key (inner equi-join)."""
    return text_table(spark, sf_dir).join(
        vector_table(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id"
    )


def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, batch_id, gate array<double>, label, probs array<double>)``.
    ``gate = sigmoid(8x)`` per element (double first, rounded to 6 decimals);
    ``probs`` are four rational scores per row."""
    v = vector_table(spark, sf_dir)
    gate = F.transform(
        "embedding", lambda x: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * x.cast("double"))), 6)
    )
    probs = F.array(
        *[
            (((F.col("label") * 10 + F.lit(17 * k) + F.col("vec_id")) % 100).cast("double") / F.lit(100.0))
            for k in range(4)
        ]
    )
    return v.select(
        "vec_id",
        (F.col("vec_id") / 64).cast("long").alias("batch_id"),
        gate.alias("gate"),
        "label",
        probs.alias("probs"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a training metric log ``(run, epoch, metric, value, ts)``;
    ``epoch`` numbers each run's records by ``(ts, event_id)`` with the two-level
    rank (per-minute buckets), so one very long run is not one task."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("metric"), "value"
    )
    minute = F.date_trunc("minute", "ts")
    ranked = ordered_rank(ev, ["run"], [F.col("ts"), F.col("event_id")], minute, name="epoch")
    return ranked.select("run", "epoch", "metric", "value", "ts", "event_id")


def weights_table(spark: SparkSession, shapes: dict[str, tuple[int, ...]]) -> DataFrame:
    """F3d: deterministic small rational weights ``((7i + 3j) % 11 - 5) / 10``
    for the given tensor shapes (i = row, j = column of the flattened 2-D view);
    model parameters, not data."""
    import numpy as np

    rows = []
    for name, shape in shapes.items():
        arr = rational_weights(shape)
        rows.append((name, list(shape), [float(x) for x in np.asarray(arr, dtype=np.float32).ravel()]))
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<float>")


def rational_weights(shape: tuple[int, ...]):
    import numpy as np

    if len(shape) == 1:
        i = np.zeros(shape[0], dtype=np.int64)
        j = np.arange(shape[0])
    else:
        i, j = np.meshgrid(np.arange(shape[0]), np.arange(int(np.prod(shape[1:]))), indexing="ij")
    return (((7 * i + 3 * j) % 11 - 5) / 10.0).reshape(shape)


__all__ = [
    "F1_IDS",
    "F1_KEY",
    "F1_LABELS",
    "fusion_table",
    "gate_table",
    "document_texts",
    "metric_log",
    "metric_table",
    "MONTH_LABELS",
    "order_months",
    "scored_table",
    "split_metric_table",
    "SCORE_INPUTS",
    "text_table",
    "vector_table",
    "weights_table",
    "rational_weights",
]
