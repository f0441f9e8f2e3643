"""DuckDB oracle for the fusion scorers (gated and late-MLP fusion).

The forward pass is unrolled as a chain of CTEs over list columns: every
linear layer is a list of ``list_dot_product`` terms with the scorer's
rational weights (rounded to float32 and widened, exactly as the scorer loads
them), layer norms, ReLU, the stable sigmoid and the gated mix are list
lambdas. Split and scaler follow the Spark side (md5 rank per label-set,
population std fitted on train).
"""

from __future__ import annotations

import numpy as np

from strata.config import SEED
from strata.plans.oracle import F3A, _wcte, r6

FUSION_FEATURES = ["n_chars", "n_spaces", "n_newlines"]
LN_EPS = 1e-05


def _num(v: float) -> str:
    r = repr(float(v))
    return r if ("e" in r or "n" in r) else r + "e0"


def _vec(values) -> str:
    return "[" + ", ".join(_num(v) for v in values) + "]"


class _Chain:
    """CTEs ``c1, c2, ...``, each adding columns to the previous one."""

    def __init__(self, source: str):
        self.ctes: list[str] = []
        self.prev = source
        self.k = 0

    def add(self, **cols: str) -> None:
        self.k += 1
        name = f"c{self.k}"
        body = ", ".join(f"{expr} AS {col}" for col, expr in cols.items())
        self.ctes.append(f"{name} AS (SELECT *, {body} FROM {self.prev})")
        self.prev = name


class _Net:
    def __init__(self, chain: _Chain, weights: dict[str, np.ndarray]):
        self.c, self.w, self.n = chain, weights, 0

    def _new(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def linear(self, x: str, name: str, bias: bool = True) -> str:
        w = self.w[f"{name}.w"]
        b = self.w[f"{name}.b"] if bias else None
        terms = [
            f"list_dot_product({x}, {_vec(w[i])})" + (f" + {_num(b[i])}" if bias else "") for i in range(w.shape[0])
        ]
        out = self._new()
        self.c.add(**{out: "[" + ", ".join(terms) + "]"})
        return out

    def layer_norm(self, x: str, name: str, dim: int) -> str:
        mu, var, out = self._new(), self._new(), self._new()
        self.c.add(**{mu: f"list_avg({x})"})
        self.c.add(**{var: f"list_avg(list_transform({x}, lambda t: (t - {mu}) * (t - {mu})))"})
        g, beta = _vec(self.w[f"{name}.g"]), _vec(self.w[f"{name}.beta"])
        self.c.add(**{out: f"list_transform(range(1, {dim + 1}), lambda i: ({x}[i] - {mu}) / sqrt({var} + {_num(LN_EPS)}) * {g}[i] + {beta}[i])"})
        return out

    def map(self, x: str, fn: str) -> str:
        out = self._new()
        self.c.add(**{out: f"list_transform({x}, lambda t: {fn})"})
        return out

    def relu(self, x: str) -> str:
        return self.map(x, "greatest(t, 0e0)")

    def sigmoid(self, x: str) -> str:
        return self.map(x, "CASE WHEN t >= 0 THEN 1e0 / (1e0 + exp(-abs(t))) ELSE exp(-abs(t)) / (1e0 + exp(-abs(t))) END")

    def zip(self, a: str, b: str, dim: int, fn: str) -> str:
        """Element-wise ``fn`` of ``a[i]`` (``A``) and ``b[i]`` (``B``)."""
        out = self._new()
        self.c.add(**{out: f"list_transform(range(1, {dim + 1}), lambda i: {fn.replace('A', f'{a}[i]').replace('B', f'{b}[i]')})"})
        return out

    def dcn_embed(self, x: str, spec, pre: str) -> str:
        d, e = spec.projection_dim, spec.embed_dim
        x0 = self.relu(self.layer_norm(self.linear(x, f"{pre}proj"), f"{pre}proj.ln", d))
        xc = x0
        for i in range(spec.cross_layers):
            c = f"{pre}cross{i}"
            inner = self.linear(self.linear(xc, f"{c}.U", bias=False), f"{c}.V")
            cross = self.zip(x0, inner, d, "A * B")
            xc = self.zip(cross, xc, d, "A + B")
        return self.tail(self.deep(x0, spec, pre), xc, spec, pre, d, e)

    def deep(self, xd: str, spec, pre: str) -> str:
        d = spec.projection_dim
        b1, b2 = d // spec.ratios[0], d // spec.ratios[1]
        for i in range(spec.deep_layers):
            p = f"{pre}deep{i}"
            h = self.layer_norm(xd, f"{p}.ln0", d)
            h = self.relu(self.linear(h, f"{p}.l1"))
            h = self.relu(self.layer_norm(self.linear(h, f"{p}.l2"), f"{p}.ln2", b1))
            h = self.relu(self.layer_norm(self.linear(h, f"{p}.l3"), f"{p}.ln3", b2))
            h = self.relu(self.layer_norm(self.linear(h, f"{p}.l4"), f"{p}.ln4", b2))
            xd = self.zip(self.linear(h, f"{p}.l5"), xd, d, "A + B")
        return xd

    def tail(self, xd: str, xc: str, spec, pre: str, d: int, e: int) -> str:
        gate = self.sigmoid(self.linear(xd, f"{pre}gate_layer"))
        h = self.zip(xd, self.zip(gate, xc, d, "A * B"), d, "A + B")
        return self.layer_norm(self.linear(h, f"{pre}embedding"), f"{pre}embedding.ln", e)


def fusion_base() -> list[str]:
    """CTEs up to ``fx``: the split, scaled numeric features ``x`` and vectors ``emb``."""
    stats = ", ".join(
        f"avg(CAST({f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}, count({f}) AS n_{f}"
        for f in FUSION_FEATURES
    )
    scale = {
        f: f"CASE WHEN s_{f} IS NULL OR s_{f} * s_{f} <= n_{f} * 2.220446049250313e-16 * s_{f} * s_{f}"
        f" + pow(n_{f} * m_{f} * 2.220446049250313e-16, 2) THEN 1e0 ELSE s_{f} END"
        for f in FUSION_FEATURES
    }
    scaled = ", ".join(f"(CAST({f} AS DOUBLE) - m_{f}) / ({scale[f]})" for f in FUSION_FEATURES)
    return [
        F3A.strip("\n"),
        "fj AS (SELECT f3a.*, CAST(e.embedding AS DOUBLE[]) AS emb FROM f3a JOIN embeddings e ON e.vec_id = f3a.doc_id)",
        f"""fr AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic
                     ORDER BY md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR))), CAST(doc_id AS VARCHAR)) AS rk,
                   count(*) OVER (PARTITION BY quality, toxic) AS n FROM fj)""",
        """fs AS (SELECT * EXCLUDE (rk, n), CASE WHEN rk <= (8 * n + 5) // 10 THEN 'train'
                   WHEN rk <= (9 * n + 5) // 10 THEN 'val' ELSE 'test' END AS split FROM fr)""",
        f"fst AS (SELECT {stats} FROM fs WHERE split = 'train')",
        f"fx AS (SELECT doc_id, split, quality, toxic, emb, [{scaled}] AS x FROM fs, fst)",
    ]


def _fused_sql(kind: str) -> tuple[list[str], str, str, str | None]:
    """CTEs of the scored fusion table, its final CTE name, the logits column and
    (gated) the gate column."""
    from strata.operators.scoring import weight_shapes
    from strata.plans.catalog_models import fusion_spec
    from strata.plans.fixtures import rational_weights

    spec = fusion_spec(kind)
    assert spec.deep_type == "bottleneck" and spec.cross_type == "standard" and spec.activation == "relu"
    weights = {k: rational_weights(v).astype(np.float32).astype(np.float64) for k, v in weight_shapes(spec).items()}
    base = fusion_base()
    chain = _Chain("fx")
    net = _Net(chain, weights)
    e = spec.embed_dim
    h_num = net.dcn_embed("x", spec, "num.")
    h_txt = net.relu(net.layer_norm(net.linear("emb", "text_proj"), "text_proj.ln", e))
    both = net._new()
    chain.add(**{both: f"list_concat({h_num}, {h_txt})"})
    gate = None
    if kind == "gated":
        gate = net.sigmoid(net.linear(both, "fusion_gate"))
        fused = net.zip(net.zip(gate, h_num, e, "A * B"), net.zip(gate, h_txt, e, "(1e0 - A) * B"), e, "A + B")
        logits = net.linear(fused, "classifier")
    else:
        h = spec.hidden_dim or 2 * e
        m = net.relu(net.layer_norm(net.linear(both, "mlp1"), "mlp1.ln", h))
        m = net.relu(net.layer_norm(net.linear(m, "mlp2"), "mlp2.ln", e))
        logits = net.linear(m, "classifier")
    return base + chain.ctes, chain.prev, logits, gate


PROB = "CASE WHEN z >= 0 THEN 1e0 / (1e0 + exp(-abs(z))) ELSE exp(-abs(z)) / (1e0 + exp(-abs(z))) END"


def _long_cte(name: str, last: str, logits: str, where: str = "") -> str:
    """Long scored rows ``(doc_id, split, label, logit, prob, y)`` (unrounded)."""
    return (
        f"{name} AS (SELECT doc_id, split, CAST(k - 1 AS INTEGER) AS label, z AS logit, {PROB} AS prob,"
        " CAST(CASE WHEN k = 1 THEN quality ELSE toxic END AS INTEGER) AS y"
        f" FROM (SELECT *, lg[k] AS z FROM (SELECT doc_id, split, quality, toxic, unnest(range(1, 3)) AS k,"
        f" {logits} AS lg FROM {last} {where})))"
    )


def _long(kind: str) -> str:
    ctes, last, logits, _ = _fused_sql(kind)
    return _wcte(*ctes, _long_cte("lo", last, logits)) + (
        f"SELECT doc_id, label, {r6('logit')} AS logit, {r6('prob')} AS prob, y FROM lo"
    )


def _gate_stats_sql(src: str, gate: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (
        f"SELECT {g}avg(g) AS mean, stddev_pop(g) AS std, min(g) AS min, max(g) AS max,"
        " avg(CASE WHEN g < 0.05e0 THEN 1e0 ELSE 0e0 END) AS near_zero,"
        " avg(CASE WHEN g > 0.95e0 THEN 1e0 ELSE 0e0 END) AS near_one"
        f" FROM (SELECT {g}unnest({gate}) AS g FROM {src}){gb}"
    )


def _evaluate_split() -> str:
    """MET10 on the test split: BCE loss, metric bundle at 0.5, gate statistics."""
    from strata.plans.oracle_analytics import _auc, _confusion, _scores, _steps, _summary

    ctes, last, logits, gate = _fused_sql("gated")
    cols = ["mean", "std", "min", "max", "near_zero", "near_one"]
    sql = _wcte(
        *ctes,
        _long_cte("tl", last, logits, "WHERE split = 'test'"),
        "half AS (SELECT DISTINCT label, 0.5e0 AS threshold FROM tl)",
        f"conf AS ({_confusion('tl', 'half')})",
        f"sc AS ({_scores('conf')})",
        f"su AS ({_summary('sc')})",
        _steps("tl", "st"),
        f"au AS ({_auc('st')})",
        _steps("tl", "stm", part="0"),
        f"aum AS ({_auc('stm')})",
        f"gs AS ({_gate_stats_sql(last + " WHERE split = 'test'", gate)})",
    )
    bce = "-(CAST(y AS DOUBLE) * (least(logit, 0e0) - ln(1e0 + exp(-abs(logit)))) + (1e0 - CAST(y AS DOUBLE)) * (least(-logit, 0e0) - ln(1e0 + exp(-abs(logit)))))"
    bad = "(SELECT count(*) FROM au WHERE auc IS NULL) > 0"
    rows = [
        f"SELECT 'loss' AS metric, {r6(f'avg({bce})')} AS value FROM tl",
        f"SELECT 'acc', {r6('recall_macro')} FROM su",
        f"SELECT 'f1_micro', {r6('f1_micro')} FROM su",
        f"SELECT 'f1_macro', {r6('f1_macro')} FROM su",
        f"SELECT 'auc_micro', {r6(f'CASE WHEN {bad} OR (SELECT auc FROM aum) IS NULL THEN 0e0 ELSE (SELECT auc FROM aum) END')}",
        f"SELECT 'auc_macro', {r6(f'CASE WHEN {bad} THEN 0e0 ELSE (SELECT avg(auc) FROM au) END')}",
    ] + [f"SELECT 'eval/gate/{c}', {r6(c)} FROM gs" for c in cols]
    return sql + "\nUNION ALL\n".join(rows)


def fusion_sql() -> dict[str, str]:
    q = {"score_gated_fusion": _long("gated"), "score_late_mlp": _long("late_mlp")}
    ctes, last, _, gate = _fused_sql("gated")
    cols = ["mean", "std", "min", "max", "near_zero", "near_one"]
    q["fusion_gate_stats"] = _wcte(*ctes) + (
        "SELECT split, " + ", ".join(f"{r6(c)} AS {c}" for c in cols) + f" FROM ({_gate_stats_sql(last, gate, 'split')})"
    )
    q["evaluate_split"] = _evaluate_split()
    return q
