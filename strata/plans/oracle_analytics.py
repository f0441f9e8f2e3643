"""DuckDB oracle SQL for metrics, curves and thresholds (brute force where simplest)."""

from __future__ import annotations

from strata.config import COARSE_CANDIDATES, GRID_CANDIDATES
from strata.plans.oracle import F1S, _wcte, r6

F2 = (
    F1S
    + """,
f1x AS (
  SELECT row_key, split, y0, y1, y2, y3, l_partkey,
         CAST(l_quantity AS INTEGER) AS q,
         CAST(round(l_discount * 100) AS INTEGER) AS d,
         CAST(round(l_tax * 100) AS INTEGER) AS t,
         CAST(l_partkey % 97 AS INTEGER) AS h
  FROM f1s
),
f2p AS (
  SELECT row_key, split, 0 AS label, y0 AS y, CAST(100 + 8 * q + 250 * y0 + h AS DOUBLE) / 1000e0 AS prob FROM f1x
  UNION ALL SELECT row_key, split, 1, y1, CAST(200 + 60 * t + 40 * y1 + h AS DOUBLE) / 1000e0 FROM f1x
  UNION ALL SELECT row_key, split, 2, y2, CAST(20 + 70 * d + 2 * h AS DOUBLE) / 1000e0 FROM f1x
  UNION ALL SELECT row_key, split, 3, y3, CAST(5 + 15 * q + h AS DOUBLE) / 1000e0 FROM f1x
),
f2 AS (
  SELECT row_key, split, label, y, prob, ln(prob / (1e0 - prob)) AS logit FROM f2p
)"""
)


def dbl(x: float) -> str:
    """Exact double literal."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _cands(cands: list[float]) -> str:
    rows = ", ".join(f"({dbl(c)}, {i})" for i, c in enumerate(cands))
    return f"cands AS (SELECT * FROM (VALUES {rows}) AS v(threshold, given_pos))"


def _grid(src: str, name: str = "grid") -> str:
    """CTE ``name(label, threshold, f1)``: per-label best-F1 candidate."""
    return f"""
{name}_lab AS (SELECT label, CAST(sum(y) AS BIGINT) AS P, CAST(count(*) - sum(y) AS BIGINT) AS N FROM {src} GROUP BY label),
{name}_sweep AS (
  SELECT s.label, c.threshold, c.given_pos,
         CAST(sum(CASE WHEN s.prob >= c.threshold THEN s.y ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN s.prob >= c.threshold THEN 1 - s.y ELSE 0 END) AS BIGINT) AS fp
  FROM {src} s CROSS JOIN cands c GROUP BY s.label, c.threshold, c.given_pos
),
{name}_f1 AS (
  SELECT w.label, w.threshold, w.given_pos,
         CASE WHEN 2 * w.tp + w.fp + (l.P - w.tp) = 0 THEN 0e0
              ELSE CAST(2 * w.tp AS DOUBLE) / CAST(2 * w.tp + w.fp + (l.P - w.tp) AS DOUBLE) END AS f1
  FROM {name}_sweep w JOIN {name}_lab l ON w.label = l.label
),
{name}_best AS (
  SELECT label, threshold, f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, given_pos) AS rn FROM {name}_f1 WHERE f1 > 0
  ) WHERE rn = 1
),
{name} AS (
  SELECT l.label, coalesce(b.threshold, 0.5e0) AS threshold, coalesce(b.f1, 0e0) AS f1
  FROM {name}_lab l LEFT JOIN {name}_best b ON l.label = b.label
)"""


def _steps(src: str, name: str, part: str = "label") -> str:
    """Distinct scores in descending order with cumulative counts and next step."""
    return f"""
{name}_cnt AS (
  SELECT {part} AS label, prob AS score, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg
  FROM {src} GROUP BY 1, 2
),
{name} AS (
  SELECT label, score, pos, neg,
         CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         lead(pos) OVER w2 AS next_pos, lead(neg) OVER w2 AS next_neg,
         CAST(sum(pos) OVER (PARTITION BY label) AS BIGINT) AS P,
         CAST(sum(neg) OVER (PARTITION BY label) AS BIGINT) AS N
  FROM {name}_cnt
  WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY label ORDER BY score DESC)
)"""


def _auc(steps: str) -> str:
    return (
        f"SELECT label, CASE WHEN max(P) > 0 AND max(N) > 0 THEN"
        f" sum(CAST(neg AS DOUBLE) * (tp - pos / 2e0)) / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) END AS auc"
        f" FROM {steps} GROUP BY label"
    )


def _roc(steps: str, src: str) -> str:
    return f"""
SELECT label, CAST('inf' AS DOUBLE) AS threshold, 0e0 AS fpr, 0e0 AS tpr FROM (SELECT DISTINCT label FROM {src})
UNION ALL
SELECT label, score, CAST(fp AS DOUBLE) / CAST(N AS DOUBLE), CAST(tp AS DOUBLE) / CAST(P AS DOUBLE)
FROM {steps}
WHERE (tp = pos AND fp = neg) OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"""


def _confusion(src: str, thr: str) -> str:
    return f"""
SELECT s.label, max(t.threshold) AS threshold,
       CAST(sum(CASE WHEN s.prob >= t.threshold THEN s.y ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN s.prob >= t.threshold THEN 1 - s.y ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN s.prob < t.threshold THEN s.y ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN s.prob < t.threshold THEN 1 - s.y ELSE 0 END) AS BIGINT) AS tn
FROM {src} s JOIN {thr} t ON s.label = t.label GROUP BY s.label"""


def _scores(conf: str) -> str:
    d = lambda n, m: f"CASE WHEN ({m}) = 0 THEN 0e0 ELSE CAST({n} AS DOUBLE) / CAST({m} AS DOUBLE) END"
    return f"""
SELECT label, threshold, tp, fp, fn, tn,
       {d('tp', 'tp + fp')} AS precision, {d('tp', 'tp + fn')} AS recall, {d('2 * tp', '2 * tp + fp + fn')} AS f1
FROM {conf}"""


def _summary(scores: str) -> str:
    d = lambda n, m: f"CASE WHEN ({m}) = 0 THEN 0e0 ELSE CAST({n} AS DOUBLE) / CAST({m} AS DOUBLE) END"
    return f"""
SELECT {d('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS f1_micro, avg(f1) AS f1_macro,
       avg(precision) AS precision_macro, avg(recall) AS recall_macro
FROM {scores}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    base = [F2, "val AS (SELECT * FROM f2 WHERE split = 'val')", "test AS (SELECT * FROM f2 WHERE split = 'test')"]
    half = "half AS (SELECT DISTINCT label, 0.5e0 AS threshold FROM f2)"

    q["confusion_matrix"] = _wcte(*base, _cands(GRID_CANDIDATES), _grid("val")) + _confusion("test", "grid")
    q["f1_micro_macro"] = (
        _wcte(*base, half, f"conf AS ({_confusion('val', 'half')})", f"sc AS ({_scores('conf')})", f"su AS ({_summary('sc')})")
        + f"SELECT {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro FROM su"
    )
    q["precision_recall_macro"] = (
        _wcte(*base, half, f"conf AS ({_confusion('val', 'half')})", f"sc AS ({_scores('conf')})", f"su AS ({_summary('sc')})")
        + f"SELECT {r6('precision_macro')} AS precision_macro, {r6('recall_macro')} AS recall_macro FROM su"
    )
    q["metric_bundle"] = (
        _wcte(
            *base,
            half,
            f"conf AS ({_confusion('val', 'half')})",
            f"sc AS ({_scores('conf')})",
            f"su AS ({_summary('sc')})",
            _steps("val", "st"),
            f"au AS ({_auc('st')})",
            _steps("val", "stm", part="0"),
            f"aum AS ({_auc('stm')})",
        )
        + f"""SELECT {r6('recall_macro')} AS acc, {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro,
       {r6("CASE WHEN (SELECT count(*) FROM au WHERE auc IS NULL) > 0 OR (SELECT auc FROM aum) IS NULL THEN 0e0 ELSE (SELECT auc FROM aum) END")} AS auc_micro,
       {r6("CASE WHEN (SELECT count(*) FROM au WHERE auc IS NULL) > 0 THEN 0e0 ELSE (SELECT avg(auc) FROM au) END")} AS auc_macro
FROM su"""
    )
    q["per_label_report"] = (
        _wcte(*base, half, f"conf AS ({_confusion('test', 'half')})", f"sc AS ({_scores('conf')})", _steps("test", "st"), f"au AS ({_auc('st')})")
        + f"SELECT sc.label, sc.threshold, {r6('au.auc')} AS auc, {r6('f1')} AS f1, {r6('precision')} AS precision,"
        f" {r6('recall')} AS recall FROM sc LEFT JOIN au ON sc.label = au.label"
    )
    q["auc_per_label"] = _wcte(F2, _steps("f2", "st")) + f"SELECT label, {r6('auc')} AS auc FROM ({_auc('st')})"
    q["auc_micro"] = _wcte(F2, _steps("f2", "st", part="0")) + f"SELECT {r6('auc')} AS auc FROM ({_auc('st')})"
    q["roc_curve"] = _wcte(*base, _steps("test", "st")) + (
        f"SELECT label, threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM ({_roc('st', 'test')})"
    )
    q["pr_curve"] = _wcte(*base, _steps("test", "st")) + f"""
SELECT label, score AS threshold, {r6('CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)')} AS precision,
       {r6('CASE WHEN P = 0 THEN 1e0 ELSE CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) END')} AS recall
FROM st
UNION ALL
SELECT label, CAST(NULL AS DOUBLE), 1e0, 0e0 FROM (SELECT DISTINCT label FROM test)"""
    q["average_precision"] = _wcte(*base, _steps("test", "st")) + (
        "SELECT label, "
        + r6("CASE WHEN max(P) > 0 THEN sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(max(P) AS DOUBLE) END")
        + " AS ap FROM st GROUP BY label"
    )
    q["curve_chart"] = _wcte(*base, _steps("test", "st"), f"au AS ({_auc('st')})", f"roc AS ({_roc('st', 'test')})") + f"""
SELECT r.label, 'roc' AS curve, {r6('r.fpr')} AS x, {r6('r.tpr')} AS y, r.threshold, {r6('au.auc')} AS area
FROM roc r LEFT JOIN au ON r.label = au.label
UNION ALL
SELECT st.label, 'pr', {r6('CASE WHEN P = 0 THEN 1e0 ELSE CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) END')},
       {r6('CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)')}, score, {r6('ap.ap')}
FROM st LEFT JOIN (SELECT label, CASE WHEN max(P) > 0 THEN sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(max(P) AS DOUBLE) END AS ap FROM st GROUP BY label) ap ON st.label = ap.label
UNION ALL
SELECT l.label, 'pr', 0e0, 1e0, CAST(NULL AS DOUBLE),
       {r6('(SELECT CASE WHEN max(P) > 0 THEN sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(max(P) AS DOUBLE) END FROM st s2 WHERE s2.label = l.label)')}
FROM (SELECT DISTINCT label FROM test) l
UNION ALL
SELECT label, 'random', 0e0, 0e0, CAST(NULL AS DOUBLE), 0.5e0 FROM (SELECT DISTINCT label FROM test)
UNION ALL
SELECT label, 'random', 1e0, 1e0, CAST(NULL AS DOUBLE), 0.5e0 FROM (SELECT DISTINCT label FROM test)"""

    order = {"a": "x, y, threshold NULLS FIRST", "b": "x DESC, y DESC, threshold DESC NULLS LAST",
             "c": "y, x, threshold NULLS FIRST", "d": "y DESC, x DESC, threshold DESC NULLS LAST"}
    ranks = ", ".join(f"row_number() OVER (PARTITION BY label, curve, bucket ORDER BY {by}) AS {k}" for k, by in order.items())
    q["curve_chart_bounded"] = f"""
SELECT DISTINCT label, curve, x, y, threshold, area, {r6('y_range')} AS y_error
FROM (SELECT *, {ranks}, max(y) OVER (PARTITION BY label, curve, bucket) - min(y) OVER (PARTITION BY label, curve, bucket) AS y_range
      FROM (SELECT *, least(CAST(floor(x * 100) AS BIGINT), 99) AS bucket FROM ({q['curve_chart']})))
WHERE 1 IN (a, b, c, d)"""

    q["threshold_grid"] = _wcte(*base, _cands(GRID_CANDIDATES), _grid("val")) + (
        f"SELECT label, threshold, {r6('f1')} AS f1 FROM grid"
    )
    roc_pts = lambda: [_steps("val", "st"), f"roc AS ({_roc('st', 'val')})"]
    q["threshold_coarse"] = _wcte(*base, _cands(COARSE_CANDIDATES), _grid("val")) + (
        f"SELECT label, threshold, {r6('f1')} AS f1 FROM grid"
    )
    roc_pts = lambda: [_steps("val", "st"), f"roc AS ({_roc('st', 'val')})"]
    q["threshold_roc_youden"] = _wcte(*base, *roc_pts()) + """
SELECT label, threshold FROM (
  SELECT label, threshold, row_number() OVER (PARTITION BY label ORDER BY tpr - fpr DESC NULLS LAST, threshold DESC) AS rn
  FROM roc) WHERE rn = 1"""
    q["threshold_roc_topleft"] = _wcte(*base, *roc_pts()) + """
SELECT label, threshold FROM (
  SELECT label, threshold,
         row_number() OVER (PARTITION BY label ORDER BY sqrt((1e0 - tpr) * (1e0 - tpr) + fpr * fpr) ASC NULLS LAST, threshold DESC) AS rn
  FROM roc) WHERE rn = 1"""
    eval_ctes = [
        *base,
        _cands(GRID_CANDIDATES),
        _grid("val"),
        f"conf AS ({_confusion('test', 'grid')})",
        f"sc AS ({_scores('conf')})",
        f"su AS ({_summary('sc')})",
        _steps("test", "tst"),
        f"tau AS ({_auc('tst')})",
    ]
    q["threshold_eval"] = _wcte(*eval_ctes) + (
        f"SELECT {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro, {r6('precision_macro')} AS precision_macro,"
        f" {r6('recall_macro')} AS recall_macro, {r6('(SELECT avg(auc) FROM tau)')} AS auc_macro FROM su"
    )
    q["threshold_compare"] = _wcte(
        *eval_ctes,
        *roc_pts(),
        """youden AS (SELECT label, threshold FROM (
  SELECT label, threshold, row_number() OVER (PARTITION BY label ORDER BY tpr - fpr DESC NULLS LAST, threshold DESC) AS rn
  FROM roc) WHERE rn = 1)""",
        f"conf2 AS ({_confusion('test', 'youden')})",
        f"sc2 AS ({_scores('conf2')})",
        f"su2 AS ({_summary('sc2')})",
    ) + "\n UNION ALL \n".join(
        f"SELECT '{m}' AS method, {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro,"
        f" {r6('precision_macro')} AS precision_macro, {r6('recall_macro')} AS recall_macro,"
        f" {r6('(SELECT avg(auc) FROM tau)')} AS auc_macro FROM {t}"
        for m, t in (("grid_search", "su"), ("roc_youden", "su2"))
    )
    return q
