"""DuckDB oracle SQL for losses, gates and run analytics."""

from __future__ import annotations

from strata.config import SEED
from strata.plans.oracle import _label_counts, _wcte, r6
from strata.plans.oracle_analytics import F2

POSW = "pw AS (SELECT label, sqrt(CAST(negative AS DOUBLE) / (positive + 1e-06)) AS pos_weight FROM counts)"
TRAIN_COUNTS = "counts AS (\n" + _label_counts("f1s", "WHERE split = 'train'") + "\n)"


def _en(c: str) -> str:
    return f"(1e0 - pow(0.9999e0, greatest(CAST({c} AS DOUBLE), 0.0001e0))) / (1e0 - 0.9999e0)"


def _cb_table(name: str, counts: str, part: str = "") -> str:
    over = f"PARTITION BY {part}" if part else ""
    sel = f"{part}, " if part else ""
    return f"""{name}_en AS (SELECT {sel}label, {_en('positive')} AS en_pos, {_en('negative')} AS en_neg FROM {counts}),
{name} AS (SELECT {sel}label, max(en_pos) OVER ({over}) / greatest(en_pos, 0.0001e0) AS w_pos,
                 max(en_neg) OVER ({over}) / greatest(en_neg, 0.0001e0) AS w_neg FROM {name}_en)"""


ELEMENTS = """e AS (
  SELECT f2.*, CAST(f2.y AS DOUBLE) AS yd, 1e0 / (1e0 + exp(-f2.logit)) AS p,
         least(f2.logit, 0e0) - ln(1e0 + exp(-abs(f2.logit))) AS lsp,
         least(-f2.logit, 0e0) - ln(1e0 + exp(-abs(f2.logit))) AS lsn
  FROM f2
)"""

BCE_PLAIN = "(-(yd * lsp + (1e0 - yd) * lsn))"
FOCAL = "pow(1e0 - (p * yd + (1e0 - p) * (1e0 - yd)), 2e0)"

F4 = """f4 AS (
  SELECT vec_id, CAST(vec_id // 64 AS BIGINT) AS batch_id,
         list_transform(embedding, lambda x: round(1e0 / (1e0 + exp(-8e0 * CAST(x AS DOUBLE))), 6)) AS gate,
         label,
         [CAST((label * 10 + 0 + vec_id) % 100 AS DOUBLE) / 100e0,
          CAST((label * 10 + 17 + vec_id) % 100 AS DOUBLE) / 100e0,
          CAST((label * 10 + 34 + vec_id) % 100 AS DOUBLE) / 100e0,
          CAST((label * 10 + 51 + vec_id) % 100 AS DOUBLE) / 100e0] AS probs
  FROM embeddings
)"""

F4_VAL = (
    F4
    + f""",
f4r AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '{SEED}', CAST(vec_id AS VARCHAR))),
                                                           CAST(vec_id AS VARCHAR)) AS rk,
         count(*) OVER (PARTITION BY label) AS n
  FROM f4
),
f4v AS (
  SELECT * EXCLUDE (rk, n) FROM f4r WHERE rk > (8 * n + 5) // 10 AND rk <= (9 * n + 5) // 10
)"""
)

F5 = """f5 AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         event_type AS metric, value
  FROM events
)"""


def _gate_stats(src: str, nz: float, no: float, neutral: bool, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    ne = ", avg(CASE WHEN g >= 0.4e0 AND g <= 0.6e0 THEN 1e0 ELSE 0e0 END) AS neutral" if neutral else ""
    return (
        f"SELECT {g}avg(g) AS mean, stddev_pop(g) AS std, min(g) AS min, max(g) AS max,"
        f" avg(CASE WHEN g < {nz!r}e0 THEN 1e0 ELSE 0e0 END) AS near_zero,"
        f" avg(CASE WHEN g > {no!r}e0 THEN 1e0 ELSE 0e0 END) AS near_one{ne}"
        f" FROM (SELECT {g}unnest(gate) AS g FROM {src}){gb}"
    )


def oracle_sql() -> dict[str, str]:

    q: dict[str, str] = {}
    base = [F2, TRAIN_COUNTS, POSW, ELEMENTS]
    pw_join = "el AS (SELECT e.*, pw.pos_weight AS w FROM e LEFT JOIN pw ON e.label = pw.label)"
    q["loss_bce"] = _wcte(*base, pw_join) + (
        f"SELECT {r6('avg(-(w * yd * lsp + (1e0 - yd) * lsn))')} AS loss, count(*) AS n FROM el"
    )
    q["loss_focal"] = _wcte(*base, pw_join) + (
        f"SELECT {r6(f'avg((w * yd + 1e0 - yd) * {FOCAL} * {BCE_PLAIN})')} AS loss, count(*) AS n FROM el"
    )
    asl = (
        "avg((w * yd + 1e0 - yd) * (pow(1e0 - p, 1e0) * (-yd * lsp)"
        " + pow(1e0 - least(1e0 - p + 0.01e0, 1e0), 4e0) * (-(1e0 - yd) * lsn)))"
    )
    q["loss_asl"] = _wcte(*base, pw_join) + f"SELECT {r6(asl)} AS loss, count(*) AS n FROM el"
    dyn_counts = (
        "dc AS (SELECT label, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative"
        " FROM f2 GROUP BY label)"
    )
    q["loss_cb"] = _wcte(*base, dyn_counts, _cb_table("cbw", "dc"), "el AS (SELECT e.*, c.w_pos, c.w_neg FROM e LEFT JOIN cbw c ON e.label = c.label)") + (
        f"SELECT {r6(f'avg((w_pos * yd + w_neg * (1e0 - yd)) * {BCE_PLAIN})')} AS loss, count(*) AS n FROM el"
    )
    q["loss_cb_focal_dynamic"] = _wcte(*base, dyn_counts, _cb_table("cbw", "dc"), "el AS (SELECT e.*, c.w_pos, c.w_neg FROM e LEFT JOIN cbw c ON e.label = c.label)") + (
        f"SELECT {r6(f'avg((w_pos * yd + w_neg * (1e0 - yd)) * {FOCAL} * {BCE_PLAIN})')} AS loss, count(*) AS n FROM el"
    )
    q["loss_cb_focal_ones"] = _wcte(F2, ELEMENTS) + f"SELECT {r6(f'avg({FOCAL} * {BCE_PLAIN})')} AS loss, count(*) AS n FROM e"
    q["loss_focal_sum"] = _wcte(F2, ELEMENTS) + f"SELECT round(sum({FOCAL} * {BCE_PLAIN}) / 1000, 6) AS loss, count(*) AS n FROM e WHERE split = 'test'"
    q["loss_elements"] = _wcte(F2, ELEMENTS) + (
        f"SELECT row_key, label, {r6('(1e0 - p) * (-yd * lsp) + pow(1e0 - least(1e0 - p + 0.01e0, 1e0), 4e0) * (-(1e0 - yd) * lsn)')} AS loss FROM e WHERE split = 'test'"
    )
    q["loss_cb_focal"] = _wcte(
        *base, _cb_table("cbw", "counts"),
        "el AS (SELECT e.*, coalesce(c.w_pos, 1e0) AS w_pos, coalesce(c.w_neg, 1e0) AS w_neg FROM e LEFT JOIN cbw c ON e.label = c.label)",
    ) + f"SELECT {r6(f'avg((w_pos * yd + w_neg * (1e0 - yd)) * {FOCAL} * {BCE_PLAIN})')} AS loss, count(*) AS n FROM el"
    batches = f"""bt AS (
  SELECT row_key, CAST((row_number() OVER (PARTITION BY split ORDER BY
              CASE WHEN split = 'train' THEN md5(concat_ws(':', '{SEED}', '0', row_key))
                   ELSE md5(concat_ws(':', '{SEED}', row_key)) END, row_key) - 1) // 2048 AS BIGINT) AS batch_id
  FROM f1s)"""
    cb_join = "el AS (SELECT e.*, c.w_pos, c.w_neg FROM e LEFT JOIN cbw c ON e.label = c.label)"
    cbw = "(w_pos * yd + w_neg * (1e0 - yd))"
    for name, ctes, element in (
        ("loss_by_batch", [pw_join], "-(w * yd * lsp + (1e0 - yd) * lsn)"),
        ("loss_by_batch_focal", [pw_join], f"(w * yd + 1e0 - yd) * {FOCAL} * {BCE_PLAIN}"),
        ("loss_by_batch_asl", [pw_join], asl.removeprefix("avg(").removesuffix(")")),
        ("loss_by_batch_cb", [_cb_table("cbw", "counts"), cb_join], f"{cbw} * {BCE_PLAIN}"),
        ("loss_by_batch_cb_focal", [_cb_table("cbw", "counts"), cb_join], f"{cbw} * {FOCAL} * {BCE_PLAIN}"),
    ):
        q[name] = _wcte(*base, *ctes, batches) + f"""
SELECT split, {r6('avg(bl)')} AS loss, count(*) AS n_batches FROM (
  SELECT el.split, bt.batch_id, avg({element}) AS bl
  FROM el JOIN bt ON el.row_key = bt.row_key GROUP BY el.split, bt.batch_id
) GROUP BY split"""

    cols6 = ["mean", "std", "min", "max", "near_zero", "near_one"]
    q["gate_stats"] = _wcte(F4) + "SELECT " + ", ".join(f"{r6(c)} AS {c}" for c in cols6) + (
        f" FROM ({_gate_stats('f4', 0.05, 0.95, False)})"
    )
    q["gate_stats_by_batch"] = _wcte(F4) + "SELECT " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in cols6) + (
        f", count(*) AS n_batches FROM ({_gate_stats('f4', 0.05, 0.95, False, 'batch_id')})"
    )
    key = f"md5(concat_ws(':', '{SEED}', CAST(vec_id AS VARCHAR))), vec_id"
    numbered = f"vb AS (SELECT gate, CAST((row_number() OVER (ORDER BY {key}) - 1) // 16 AS BIGINT) AS bid FROM f4v)"
    q["gate_stats_eval_batches"] = _wcte(F4_VAL, numbered) + "SELECT " + ", ".join(f'{r6(f"avg({c})")} AS "eval/gate/{c}"' for c in cols6) + (
        f", count(*) AS n_batches FROM ({_gate_stats('vb', 0.05, 0.95, False, 'bid')})"
    )
    rep_cols = [*cols6, "neutral"]
    report = f"SELECT (SELECT count(*) FROM h) AS n_rows, * FROM ({_gate_stats('h', 0.1, 0.9, True)})"
    head = "h AS (SELECT * FROM f4v)"
    for name, rows in (("gate_report", head), ("gate_report_head", "h AS (SELECT * FROM f4v ORDER BY vec_id LIMIT 20)")):
        q[name] = _wcte(F4_VAL, rows) + "SELECT n_rows, " + ", ".join(f"{r6(c)} AS {c}" for c in rep_cols) + f" FROM ({report})"
    q["gate_interpretation"] = _wcte(F4_VAL, head, f"rep AS ({report})") + f"""
SELECT {r6('mean')} AS mean, {r6('std')} AS std, {r6('near_zero')} AS near_zero, {r6('near_one')} AS near_one,
       {r6('neutral')} AS neutral,
       CASE WHEN mean > 0.6 THEN 'numeric' WHEN mean < 0.4 THEN 'text' ELSE 'balanced' END AS reliance,
       CASE WHEN std > 0.3 THEN 'high' ELSE 'low' END AS variance,
       CASE WHEN neutral > 0.5 THEN 'soft_averaging' WHEN near_one + near_zero > 0.5 THEN 'selector' ELSE 'mixed' END AS behaviour
FROM rep"""
    long = "lg AS (SELECT CAST(d.i - 1 AS INTEGER) AS dim, d.g FROM f4, unnest(gate) WITH ORDINALITY AS d(g, i))"
    q["gate_per_dim"] = _wcte(F4, long) + f"SELECT dim, {r6('avg(g)')} AS mean, {r6('stddev_pop(g)')} AS std FROM lg GROUP BY dim"
    q["gate_decisions"] = _wcte(F4, long) + (
        f"SELECT dim, {r6('avg(CASE WHEN g < 0.1e0 THEN 1e0 ELSE 0e0 END)')} AS near_zero,"
        f" {r6('avg(CASE WHEN g >= 0.4e0 AND g <= 0.6e0 THEN 1e0 ELSE 0e0 END)')} AS neutral,"
        f" {r6('avg(CASE WHEN g > 0.9e0 THEN 1e0 ELSE 0e0 END)')} AS near_one FROM lg GROUP BY dim"
    )
    q["gate_histogram"] = _wcte(
        F4,
        "v AS (SELECT unnest(gate) AS g FROM f4)",
        "r AS (SELECT min(g) AS mn, max(g) AS mx FROM v)",
        "e AS (SELECT CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END AS hi FROM r)",
        "c AS (SELECT CAST(least(floor((g - e.lo) * (50e0 / (e.hi - e.lo))), 49) AS INTEGER) AS bin, count(*) AS cnt FROM v, e GROUP BY 1)",
        "b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))",
    ) + (
        f"SELECT b.bin, {r6('e.lo + b.bin * ((e.hi - e.lo) / 50e0)')} AS lo, {r6('e.lo + (b.bin + 1) * ((e.hi - e.lo) / 50e0)')} AS hi,"
        " CAST(coalesce(c.cnt, 0) AS BIGINT) AS count FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin"
    )
    q["gate_heatmap_sample"] = _wcte(
        F4,
        f"s AS (SELECT vec_id, gate FROM f4 WHERE (SELECT count(*) FROM f4) >= 10"
        f" ORDER BY md5(concat_ws(':', '{SEED}', CAST(vec_id AS VARCHAR))), CAST(vec_id AS VARCHAR) LIMIT 100)",
        f"sn AS (SELECT CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', CAST(vec_id AS VARCHAR))), CAST(vec_id AS VARCHAR)) - 1 AS INTEGER) AS sample, vec_id, gate FROM s)",
    ) + "SELECT sample, vec_id, CAST(d.i - 1 AS INTEGER) AS dim, d.value FROM sn, unnest(gate) WITH ORDINALITY AS d(value, i)"
    rowmean = "list_aggregate(gate, 'sum') / len(gate)"
    q["gate_by_class"] = _wcte(
        F4,
        f"pr AS (SELECT label AS cls, {rowmean} AS rm FROM f4)",
        "tot AS (SELECT sum(rm) AS S, count(*) AS N, max(cls) AS mx FROM pr)",
        "cl AS (SELECT CAST(unnest(range(0, mx + 1)) AS INTEGER) AS cls, S, N FROM tot)",
        "byc AS (SELECT cls, sum(rm) AS s, count(*) AS n FROM pr GROUP BY cls)",
    ) + (
        f"SELECT cl.cls AS class, {r6('CASE WHEN coalesce(byc.n, 0) > 0 THEN byc.s / byc.n END')} AS mean_pos,"
        f" {r6('CASE WHEN cl.N - coalesce(byc.n, 0) > 0 THEN (cl.S - coalesce(byc.s, 0e0)) / (cl.N - coalesce(byc.n, 0)) END')} AS mean_neg"
        " FROM cl LEFT JOIN byc ON cl.cls = byc.cls"
    )
    q["gate_by_label"] = _wcte(F4, f"gl AS (SELECT {rowmean} AS rm, l.quality, l.toxic FROM f4 JOIN labels l ON f4.vec_id = l.doc_id)") + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS label, {r6(f'avg(CASE WHEN {c} = 1 THEN rm END)')} AS mean_pos, {r6(f'avg(CASE WHEN {c} = 0 THEN rm END)')} AS mean_neg FROM gl"
        for i, c in enumerate(("quality", "toxic"))
    )
    q["gate_vs_confidence"] = _wcte(F4) + (
        f"SELECT vec_id, {r6(rowmean)} AS mean_gate, {r6('list_max(probs)')} AS max_prob FROM f4"
    )

    q["seed_summary"] = _wcte(F5, "pr AS (SELECT run, metric, avg(value) AS v FROM f5 GROUP BY run, metric)") + (
        f"SELECT metric, count(*) AS n_runs, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std"
        " FROM pr GROUP BY metric HAVING count(*) >= 2"
    )
    q["early_stopping"] = _wcte(
        F5,
        "a AS (SELECT run, epoch, value, max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM f5)",
        "b AS (SELECT *, CASE WHEN value > greatest(coalesce(bb, 0e0), 0e0) THEN epoch END AS imp FROM a)",
        "c AS (SELECT *, max(imp) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM b)",
        "d AS (SELECT *, CASE WHEN epoch - coalesce(li, 0) >= 5 THEN epoch END AS st FROM c)",
        "pr AS (SELECT run, min(st) AS stop_epoch, count(*) AS n_epochs FROM d GROUP BY run)",
        "bi AS (SELECT d.run, max(d.epoch) AS best_epoch FROM d JOIN pr ON d.run = pr.run"
        " WHERE d.imp IS NOT NULL AND (pr.stop_epoch IS NULL OR d.epoch <= pr.stop_epoch) GROUP BY d.run)",
    ) + (
        "SELECT pr.run, bi.best_epoch, d.value AS best_value, pr.stop_epoch, pr.n_epochs"
        " FROM pr LEFT JOIN bi ON pr.run = bi.run LEFT JOIN d ON d.run = bi.run AND d.epoch = bi.best_epoch"
    )
    q["experiment_grid"] = _wcte(
        F5,
        "opts AS (SELECT * FROM (VALUES (0, 'standard', 'bottleneck'), (1, 'standard', 'moe'), (2, 'gated', 'bottleneck'), (3, 'gated', 'moe')) AS o(cell, cross_type, deep_type))",
        "pr AS (SELECT run, avg(value) AS v FROM f5 GROUP BY run)",
        "pc AS (SELECT CAST(run % 4 AS INTEGER) AS cell, count(*) AS n_runs, avg(v) AS mean, stddev_pop(v) AS std FROM pr GROUP BY 1)",
    ) + (
        "SELECT o.cross_type, o.deep_type, concat_ws('_', o.cross_type, o.deep_type) AS run_name,"
        f" coalesce(pc.n_runs, 0) AS n_runs, {r6('pc.mean')} AS mean, {r6('pc.std')} AS std"
        " FROM opts o LEFT JOIN pc ON o.cell = pc.cell"
    )
    return q


def _embedding(source: str) -> list[str]:
    """Non-zero elements ``emb (doc_id, dim, micro)`` of the hashed text vectors: lower-case
    words, counted in 768 slots of their md5, scaled to length 1, in single precision."""
    return [
        f"tok AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS t FROM {source})",
        "slot AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 768 AS INTEGER) AS dim, count(*) AS c FROM tok WHERE t <> '' GROUP BY 1, 2)",
        "emb AS (SELECT doc_id, dim, CAST(round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) * 1e6) AS BIGINT) AS micro FROM slot)",
    ]


def scoring_sql() -> dict[str, str]:
    """Oracle for the cross layer (unrolled with its rational weights), parity,
    output contract, fusion join and cache round trip."""
    from strata.plans.catalog_models import CROSS_RANK, cross_weights
    from strata.plans.oracle import F3AS, FEATURES, SCALED, TEXTS

    q: dict[str, str] = {}
    w = cross_weights(len(FEATURES), CROSS_RANK)
    u = [" + ".join(f"({float(w['U'][j, k])!r}e0) * {FEATURES[k]}" for k in range(len(FEATURES))) for j in range(CROSS_RANK)]
    cols = []
    for i, f in enumerate(FEATURES):
        inner = " + ".join(f"({float(w['V'][i, j])!r}e0) * ({u[j]})" for j in range(CROSS_RANK)) + f" + ({float(w['b'][i])!r}e0)"
        cols.append(f"{r6(f'{f} * ({inner}) + {f}')} AS cross_{i}")
    q["score_cross"] = _wcte(SCALED) + "SELECT row_key, " + ", ".join(cols) + " FROM scaled"
    q["score_parity"] = _wcte(SCALED) + (
        f"SELECT count(*) * {len(FEATURES)} AS n_pairs, CAST(0 AS BIGINT) AS n_unmatched, 0e0 AS max_abs_diff, true AS verified FROM scaled"
    )
    q["score_contract"] = "SELECT count(*) AS n_rows, 4 AS min_width, 4 AS max_width, true AS ok FROM lineitem"
    q["fusion_join"] = (
        "SELECT d.doc_id, l.quality, l.toxic, e.label, CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_chars,"
        " CAST(len(e.embedding) AS INTEGER) AS emb_width"
        " FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN embeddings e ON e.vec_id = d.doc_id"
    )
    q["dataset_csv_roundtrip"] = _wcte(TEXTS) + (
        "SELECT doc_id, lang, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM dt"
    )
    q["dataset_csv_blocks"] = q["dataset_csv_roundtrip"]
    q["embed_text"] = _wcte(TEXTS, *_embedding("dt")) + (
        "SELECT dt.doc_id, CAST(768 AS INTEGER) AS width, CAST(coalesce(max(n), 0) AS INTEGER) AS n_nonzero, coalesce(max(els), '') AS elements"
        " FROM dt LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(dim || ':' || micro, ',' ORDER BY dim) AS els FROM emb GROUP BY doc_id) x"
        " ON dt.doc_id = x.doc_id GROUP BY dt.doc_id"
    )
    q["embed_store"] = q["embed_text"]
    q["embed_store_runs"] = _wcte(TEXTS, "n AS (SELECT count(DISTINCT coalesce(text, '')) AS everything, count(DISTINCT coalesce(text, '')) FILTER (WHERE lang = 'en') AS english FROM dt)") + (
        "SELECT CAST(1 AS INTEGER) AS run, english AS n_stored FROM n UNION ALL SELECT 2, everything FROM n UNION ALL SELECT 3, everything FROM n"
    )
    q["fusion_join_cached"] = q["fusion_join"]
    feats = ("n_chars", "n_spaces", "n_newlines")
    fit = "fit AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in feats) + " FROM f3s WHERE split = 'train')"
    scaled = "+".join(f"CAST(round(CAST(CAST((CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS FLOAT) AS DOUBLE) * 1e6) AS BIGINT)" for c in feats)
    q["embedding_cache_roundtrip"] = _wcte(
        F3AS, *_embedding("f3s"), fit, "es AS (SELECT doc_id, count(*) AS n, sum(micro) AS m FROM emb GROUP BY doc_id)"
    ) + (
        "SELECT split, count(*) AS n_rows, 768 AS emb_width, 3 AS feat_width, CAST(coalesce(sum(es.m), 0) AS BIGINT) AS emb_sum,"
        f" CAST(coalesce(sum(es.n), 0) AS BIGINT) AS emb_nonzero, round(sum({scaled}) / 1e9, 3) + 0e0 AS feat_sum,"
        " CAST(sum(quality + toxic) * 1000000 AS BIGINT) AS label_sum"
        " FROM f3s CROSS JOIN fit LEFT JOIN es ON f3s.doc_id = es.doc_id GROUP BY split"
    )
    return q


def streaming_sql() -> dict[str, str]:
    from strata.plans.oracle_analytics import F2 as F2_

    return {
        "stream_confusion": _wcte(F2_) + """
SELECT label,
       CAST(sum(CASE WHEN prob >= 0.5e0 THEN y ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN prob >= 0.5e0 THEN 1 - y ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN prob < 0.5e0 THEN y ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN prob < 0.5e0 THEN 1 - y ELSE 0 END) AS BIGINT) AS tn,
       count(*) AS n
FROM f2 WHERE split = 'test' GROUP BY label"""
    }


def sink_sql() -> dict[str, str]:
    return {
        "metric_log_repeat": (
            "SELECT event_type AS metric, user_id % 2 = 1 AS repeated, count(*) AS n, count(DISTINCT user_id) AS n_runs,"
            f" {r6('sum(CASE WHEN user_id % 2 = 1 THEN value ELSE value + 1 END)')} AS value_sum FROM events GROUP BY ALL"
        ),
        "metric_log_sink": (
            f"SELECT event_type AS metric, count(*) AS n, count(DISTINCT user_id) AS n_runs, {r6('sum(value)')} AS value_sum"
            " FROM events GROUP BY event_type"
        )
    }


def batch_cb_sql() -> dict[str, str]:
    batches = f"""bt AS (
  SELECT row_key, CAST((row_number() OVER (PARTITION BY split ORDER BY
              CASE WHEN split = 'train' THEN md5(concat_ws(':', '{SEED}', '0', row_key))
                   ELSE md5(concat_ws(':', '{SEED}', row_key)) END, row_key) - 1) // 2048 AS BIGINT) AS batch_id
  FROM f1s)"""
    return {
        "loss_cb_per_batch": _wcte(
            F2,
            ELEMENTS,
            batches,
            "eb AS (SELECT e.*, bt.batch_id FROM e JOIN bt ON e.row_key = bt.row_key)",
            "bc AS (SELECT split, batch_id, label, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative"
            " FROM eb GROUP BY split, batch_id, label)",
            f"ben AS (SELECT split, batch_id, label, {_en('positive')} AS en_pos, {_en('negative')} AS en_neg FROM bc)",
            "bw AS (SELECT split, batch_id, label,"
            " max(en_pos) OVER (PARTITION BY split, batch_id) / greatest(en_pos, 0.0001e0) AS w_pos,"
            " max(en_neg) OVER (PARTITION BY split, batch_id) / greatest(en_neg, 0.0001e0) AS w_neg FROM ben)",
            "el AS (SELECT eb.split, eb.batch_id, (bw.w_pos * eb.yd + bw.w_neg * (1e0 - eb.yd)) * "
            + BCE_PLAIN
            + " AS loss FROM eb JOIN bw ON eb.split = bw.split AND eb.batch_id = bw.batch_id AND eb.label = bw.label)",
        )
        + f"SELECT split, {r6('avg(bl)')} AS loss, count(*) AS n_batches FROM"
        " (SELECT split, batch_id, avg(loss) AS bl FROM el GROUP BY split, batch_id) GROUP BY split"
    }
