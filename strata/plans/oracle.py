"""DuckDB SQL for every catalog query (the correctness oracle).

The CTEs restate the fixture definitions of ``strata.plans.fixtures`` in plain
SQL over the pre-registered parquet views. Every double result is rounded to 6
decimals (``+ 0e0`` folds -0.0), matching ``r6`` on the Spark side.
"""

from __future__ import annotations

from strata.config import COARSE_CANDIDATES, GRID_CANDIDATES, SEED


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0e0)"


F1 = """
f1 AS (
  SELECT concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS row_key,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
         CAST(l_returnflag = 'R' AS INTEGER) AS y0,
         CAST(l_linestatus = 'O' AS INTEGER) AS y1,
         CAST(l_discount >= 0.085e0 AS INTEGER) AS y2,
         CAST(l_quantity >= 49e0 AS INTEGER) AS y3
  FROM lineitem
)"""

F1S = (
    F1
    + f""",
f1r AS (
  SELECT *,
         row_number() OVER (PARTITION BY y0, y1, y2, y3
                            ORDER BY md5(concat_ws(':', '{SEED}', row_key)), row_key) AS rk,
         count(*) OVER (PARTITION BY y0, y1, y2, y3) AS n
  FROM f1
),
f1s AS (
  SELECT * EXCLUDE (rk, n),
         CASE WHEN rk <= (8 * n + 5) // 10 THEN 'train'
              WHEN rk <= (9 * n + 5) // 10 THEN 'val' ELSE 'test' END AS split
  FROM f1r
)"""
)

FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# population std with near-constant features mapped to 1 (same bound as Spark side)
SCALER = (
    F1S
    + ",\nscaler_wide AS (\n  SELECT "
    + ",\n         ".join(
        f"avg(CAST({f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}, count({f}) AS n_{f}"
        for f in FEATURES
    )
    + "\n  FROM f1s WHERE split = 'train'\n),\nscaler AS (\n"
    + "\n  UNION ALL\n".join(
        f"  SELECT '{f}' AS feature, m_{f} AS mean,"
        f" CASE WHEN s_{f} IS NULL OR s_{f} * s_{f} <= n_{f} * 2.220446049250313e-16 * s_{f} * s_{f}"
        f" + pow(n_{f} * m_{f} * 2.220446049250313e-16, 2) THEN 1e0 ELSE s_{f} END AS scale FROM scaler_wide"
        for f in FEATURES
    )
    + "\n)"
)


def _scaled_select() -> str:
    return ",\n       ".join(f"(CAST({f} AS DOUBLE) - mean_{f}) / scale_{f} AS {f}" for f in FEATURES)


# the scaler as one row, joined once
SCALED = SCALER + f""",
scaler_row AS (
  SELECT {", ".join(f"max(CASE WHEN feature = '{f}' THEN mean END) AS mean_{f}, max(CASE WHEN feature = '{f}' THEN scale END) AS scale_{f}" for f in FEATURES)}
  FROM scaler
),
scaled AS (
  SELECT row_key, split, y0, y1, y2, y3,
       {_scaled_select()}
  FROM f1s CROSS JOIN scaler_row
)"""

TEXTS = "dt AS (SELECT doc_id, text, lang FROM documents UNION ALL SELECT -1 - doc_id, NULL, lang FROM documents WHERE doc_id % 7 = 3)"

F3A = """
f3a AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text,
         CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_chars,
         CAST(length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), ' ', '')) AS BIGINT) AS n_spaces,
         CAST(length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) AS BIGINT) AS n_newlines,
         l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

F3AS = (
    F3A
    + f""",
f3r AS (
  SELECT *,
         row_number() OVER (PARTITION BY quality, toxic
                            ORDER BY md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR))), CAST(doc_id AS VARCHAR)) AS rk,
         count(*) OVER (PARTITION BY quality, toxic) AS n
  FROM f3a
),
f3s AS (
  SELECT * EXCLUDE (rk, n),
         CASE WHEN rk <= (8 * n + 5) // 10 THEN 'train'
              WHEN rk <= (9 * n + 5) // 10 THEN 'val' ELSE 'test' END AS split
  FROM f3r
)"""
)


def _wcte(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def _label_counts(source: str, where: str = "") -> str:
    union = "\n  UNION ALL\n".join(
        f"  SELECT {i} AS label, CAST(sum(y{i}) AS BIGINT) AS positive,"
        f" CAST(count(*) - sum(y{i}) AS BIGINT) AS negative FROM {source} {where}"
        for i in range(4)
    )
    return union


LABEL_NAMES_SQL = "['y0', 'y1', 'y2', 'y3']"


def _effective(counts_cte: str, beta: float = 0.9999, eps: float = 1e-4) -> str:
    en = lambda c: f"(1e0 - pow({beta!r}e0, greatest(CAST({c} AS DOUBLE), {eps!r}e0))) / (1e0 - {beta!r}e0)"
    return f"""
en AS (
  SELECT label, positive, negative, {en('positive')} AS en_pos, {en('negative')} AS en_neg FROM {counts_cte}
)
SELECT label, positive, negative,
       {r6(f"max(en_pos) OVER () / greatest(en_pos, {eps!r}e0)")} AS w_pos,
       {r6(f"max(en_neg) OVER () / greatest(en_neg, {eps!r}e0)")} AS w_neg
FROM en"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    feats = ", ".join(FEATURES)

    q["numeric_projection"] = _wcte(F1) + f"SELECT row_key, {feats} FROM f1"
    q["tiny_head"] = _wcte(F1) + f"SELECT row_key, {feats}, y0, y1, y2, y3 FROM f1 ORDER BY row_key LIMIT 1000"
    q["null_text_fill"] = _wcte(TEXTS, "ft AS (SELECT doc_id, coalesce(text, '') AS text FROM dt)") + (
        "SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_spaces,"
        " CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_newlines FROM ft"
    )
    q["features_float32"] = _wcte(F1) + "SELECT row_key, " + ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE) / 3e0 AS {f}" for f in FEATURES) + " FROM f1"
    q["hash_sample"] = (
        _wcte(F1)
        + f"SELECT row_key, {feats} FROM f1 WHERE (SELECT count(*) FROM f1) >= 10"
        + f" ORDER BY md5(concat_ws(':', '{SEED}', row_key)), row_key LIMIT 100"
    )
    q["stratified_split"] = _wcte(F1S) + "SELECT row_key, split FROM f1s"
    q["split_label_rates"] = _wcte(F1S) + "\n  UNION ALL\n".join(
        f"SELECT split, {i} AS label, CAST(sum(y{i}) AS BIGINT) AS positives, count(*) AS n,"
        f" round(avg(CAST(y{i} AS DOUBLE)), 6) AS rate FROM f1s GROUP BY split"
        for i in range(4)
    )
    months = "\n  UNION ALL\n".join(
        f"SELECT 'm{m}' AS label, count(DISTINCT l_orderkey) FILTER (WHERE month(l_shipdate) = {m}) AS n_rows, true AS within_one FROM lineitem"
        for m in range(1, 13)
    )
    q["sparse_split_rates"] = months + "\n  UNION ALL\nSELECT 'all', count(DISTINCT l_orderkey), true FROM lineitem"
    q["batch_assignment"] = _wcte(F1S) + f"""
SELECT row_key, split,
       CAST((row_number() OVER (PARTITION BY split ORDER BY
              CASE WHEN split = 'train' THEN md5(concat_ws(':', '{SEED}', '0', row_key))
                   ELSE md5(concat_ws(':', '{SEED}', row_key)) END, row_key) - 1) // 2048 AS BIGINT) AS batch_id
FROM f1s"""
    q["split_semi_join"] = _wcte(F3AS) + (
        "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM f3s WHERE split = 'train')"
    )
    q["scaler_fit"] = _wcte(SCALER) + f"SELECT feature, {r6('mean')} AS mean, {r6('scale')} AS scale FROM scaler"
    q["scaled_features"] = _wcte(SCALED) + "SELECT row_key, split, " + ", ".join(
        f"{r6(f)} AS {f}" for f in FEATURES
    ) + " FROM scaled"
    q["pos_weight"] = _wcte(F1S, "counts AS (\n" + _label_counts("f1s", "WHERE split = 'train'") + "\n)") + (
        f"SELECT label, positive, negative, {r6('sqrt(negative / (positive + 1e-06))')} AS pos_weight FROM counts"
    )
    q["effective_number_weights"] = (
        _wcte(F1S, "counts AS (\n" + _label_counts("f1s", "WHERE split = 'train'") + "\n)") + "," + _effective("counts")
    )
    q["onehot_weights"] = (
        "WITH per_class AS (SELECT label, count(*) AS positive FROM embeddings GROUP BY label),\n"
        "tot AS (SELECT count(*) AS n, max(label) AS mx FROM embeddings),\n"
        "grid AS (SELECT CAST(unnest(range(0, mx + 1)) AS INTEGER) AS label, n FROM tot),\n"
        "counts AS (SELECT g.label, CAST(coalesce(p.positive, 0) AS BIGINT) AS positive,"
        " CAST(g.n - coalesce(p.positive, 0) AS BIGINT) AS negative FROM grid g LEFT JOIN per_class p ON g.label = p.label),"
        + _effective("counts")
    )
    q["label_distribution"] = _wcte(F1, "counts AS (\n" + _label_counts("f1") + "\n)") + (
        f"SELECT label, {LABEL_NAMES_SQL}[label + 1] AS label_name, positive, negative,"
        f" {r6('positive / (positive + negative)')} AS ratio FROM counts"
    )
    q["feature_stats"] = _wcte(F1) + _feature_stats_sql("f1", "")
    q["train_profile"] = _wcte(SCALED) + _train_profile_sql()
    from strata.plans import oracle_analytics, oracle_models

    q.update(oracle_analytics.oracle_sql())
    q.update(oracle_models.oracle_sql())
    q.update(oracle_models.scoring_sql())
    q.update(oracle_models.streaming_sql())
    q.update(oracle_models.sink_sql())
    q.update(oracle_models.batch_cb_sql())
    from strata.plans import oracle_fusion

    q.update(oracle_fusion.fusion_sql())
    from strata.plans import oracle_dcn, oracle_heads

    q.update(oracle_dcn.dcn_sql())
    q.update(oracle_dcn.gradient_sql())
    q.update(oracle_heads.heads_sql())
    return q


def _feature_stats_sql(source: str, where: str) -> str:
    unpivot = "\n  UNION ALL\n".join(f"  SELECT CAST({f} AS DOUBLE) AS x FROM {source} {where}" for f in FEATURES)
    return f"""
, vals AS (
{unpivot}
)
SELECT (SELECT count(*) FROM {source} {where}) AS n_rows, CAST({len(FEATURES)} AS BIGINT) AS n_features,
       {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std,
       coalesce(bool_or(isnan(x) OR x IS NULL), false) AS has_nan,
       coalesce(bool_or(isinf(x)), false) AS has_inf
FROM vals"""


def _train_profile_sql() -> str:
    unpivot = "\n  UNION ALL\n".join(f"  SELECT CAST({f} AS DOUBLE) AS x FROM scaled WHERE split = 'train'" for f in FEATURES)
    label_rows = "\n  UNION ALL\n".join(
        f"  SELECT '{name}' AS name, CAST(sum(y{i}) AS DOUBLE) AS pos, CAST(count(*) - sum(y{i}) AS DOUBLE) AS neg"
        f" FROM scaled WHERE split = 'train'"
        for i, name in enumerate(["y0", "y1", "y2", "y3"])
    )
    return f""", vals AS (
{unpivot}
), lab AS (
{label_rows}
), st AS (
  SELECT (SELECT count(*) FROM scaled WHERE split = 'train') AS n_rows, avg(x) AS mean, stddev_pop(x) AS std,
         coalesce(bool_or(isnan(x) OR x IS NULL), false) AS has_nan, coalesce(bool_or(isinf(x)), false) AS has_inf
  FROM vals
)
SELECT 'positive' AS section, name, pos AS value FROM lab
UNION ALL SELECT 'negative', name, neg FROM lab
UNION ALL SELECT 'ratio', name, {r6('pos / (pos + neg)')} FROM lab
UNION ALL SELECT 'pos_weight', name, {r6('sqrt(neg / (pos + 1e-06))')} FROM lab
UNION ALL SELECT 'feature_stats', 'n_rows', CAST(n_rows AS DOUBLE) FROM st
UNION ALL SELECT 'feature_stats', 'n_features', {len(FEATURES)}e0 FROM st
UNION ALL SELECT 'feature_stats', 'mean', {r6('mean')} FROM st
UNION ALL SELECT 'feature_stats', 'std', {r6('std')} FROM st
UNION ALL SELECT 'feature_stats', 'has_nan', CAST(CAST(has_nan AS INTEGER) AS DOUBLE) FROM st
UNION ALL SELECT 'feature_stats', 'has_inf', CAST(CAST(has_inf AS INTEGER) AS DOUBLE) FROM st"""


__all__ = ["oracle_sql", "GRID_CANDIDATES", "COARSE_CANDIDATES"]
