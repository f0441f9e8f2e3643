"""DuckDB oracle for the tabular scorers with the bottleneck stack (standard and gated cross).

The scorers' weights follow a rule, ``((7 i + 3 j) % 11 - 5) / 10`` in single precision, so a
layer has only eleven distinct weight rows: its eleven dot products are taken once and row i of
the layer picks number ``7 i % 11``. The rows come from one small CTE instead of literals.
"""

from __future__ import annotations

from strata.plans.oracle import FEATURES, SCALED, _wcte
from strata.plans.oracle_fusion import LN_EPS, PROB, _Chain, _Net, _num


def _rule(index: str) -> str:
    return f"CAST(CAST((({index}) % 11 - 5) / 10e0 AS FLOAT) AS DOUBLE)"


class _RuleNet(_Net):
    """``_Net`` over the rule weights: CTE ``wv`` has ``w<n>`` (eleven rows of width n) and ``b`` (biases)."""

    def linear(self, x: str, name: str, bias: bool = True) -> str:
        n_out, n_in = self.w[f"{name}.w"]
        dots, out = self._new(), self._new()
        self.c.add(**{dots: f"[list_dot_product({x}, r) for r in w{n_in}]"})
        add = " + b[i + 1]" if bias else ""
        self.c.add(**{out: f"[{dots}[(7 * i) % 11 + 1]{add} for i in range({n_out})]"})
        return out

    def layer_norm(self, x: str, name: str, dim: int) -> str:
        mu, var, out = self._new(), self._new(), self._new()
        self.c.add(**{mu: f"list_avg({x})"})
        self.c.add(**{var: f"list_avg([(t - {mu}) * (t - {mu}) for t in {x}])"})
        self.c.add(**{out: f"[({x}[i] - {mu}) / sqrt({var} + {_num(LN_EPS)}) * b[i] + b[i] for i in range(1, {dim + 1})]"})
        return out


def _erf_table() -> str:
    """CTE ``erft``: Taylor coefficients of erf at the points i / 64 up to 6. The values come from
    the series of positive terms, the derivatives from the Hermite polynomials."""
    x, g = "(i / 64e0)", "(2e0 / sqrt(pi()) * exp(-x * x))"
    terms = [
        "g", "-g * x", "g * (4 * x * x - 2) / 6e0", "-g * (8 * pow(x, 3) - 12 * x) / 24e0", "g * (16 * pow(x, 4) - 48 * x * x + 12) / 120e0",
        "-g * (32 * pow(x, 5) - 160 * pow(x, 3) + 120 * x) / 720e0", "g * (64 * pow(x, 6) - 480 * pow(x, 4) + 720 * x * x - 120) / 5040e0",
        "-g * (128 * pow(x, 7) - 1344 * pow(x, 5) + 3360 * pow(x, 3) - 1680 * x) / 40320e0",
    ]
    return f"""erfx AS (SELECT i, {x} AS x FROM range(0, 385) t(i)),
erfs AS (
  SELECT i, any_value(e.x) AS x, sum(exp(n * ln(2e0) + (2 * n + 1) * ln(greatest(e.x, 1e-300)) - e.x * e.x
           - (lgamma(2 * n + 2) - n * ln(2e0) - lgamma(n + 1)))) * 2e0 / sqrt(pi()) AS v
  FROM erfx e, range(0, 140) s(n) GROUP BY i
),
erfg AS (SELECT *, {g} AS g FROM erfs),
erft AS (SELECT list([v, {", ".join(terms)}] ORDER BY i) AS et FROM erfg)"""


def _expert_layer(net: _RuleNet, x: str, p: str, spec) -> str:
    """By the rule all experts have the same weights, so the mixture is one expert's output
    times the sum of the chosen experts' shares."""
    d, n = spec.projection_dim, spec.projection_dim // 4
    z = net.linear(x, f"{p}.gate")
    place, raw, share, a, h, mixed = (net._new() for _ in range(6))
    net.c.add(**{place: f"[len([1 for k in range(1, {spec.num_experts + 1}) if {z}[k] > {z}[e] OR ({z}[k] = {z}[e] AND k < e)]) for e in range(1, {spec.num_experts + 1})]"})
    net.c.add(**{raw: f"[CASE WHEN {place}[e] < {spec.top_k} THEN exp({z}[e] - list_max({z})) ELSE 0e0 END for e in range(1, {spec.num_experts + 1})]"})
    net.c.add(**{share: f"list_sum([r / list_sum({raw}) for r in {raw}])"})
    hidden = net.linear(x, f"{p}.e0.l1")
    net.c.add(**{a: f"[least(abs(t) / sqrt(2e0), 6e0) for t in {hidden}]"})
    k = net._new()
    net.c.add(**{k: f"[CAST(round(t * 64) AS INTEGER) for t in {a}]"})
    delta, at = f"({a}[i] - {k}[i] / 64e0)", f"et[{k}[i] + 1]"
    series = f"{at}[9]"
    for c in range(8, 0, -1):
        series = f"({series} * {delta} + {at}[{c}])"
    net.c.add(**{h: f"[0.5e0 * {hidden}[i] * (1e0 + sign({hidden}[i]) * {series}) for i in range(1, {n + 1})]"})
    out = net.linear(h, f"{p}.e0.l2")
    net.c.add(**{mixed: f"[{x}[i] + {share} * {out}[i] for i in range(1, {d + 1})]"})
    return net.layer_norm(mixed, f"{p}.norm", d)


def _dcn(net: _RuleNet, spec) -> str:
    """The tabular network; a gated cross layer multiplies its product by a sigmoid of its input."""
    d, e = spec.projection_dim, spec.embed_dim
    x0 = net.relu(net.layer_norm(net.linear("x", "proj"), "proj.ln", d))
    xc = x0
    for i in range(spec.cross_layers):
        cross = net.zip(x0, net.linear(net.linear(xc, f"cross{i}.U", bias=False), f"cross{i}.V"), d, "A * B")
        if spec.cross_type == "gated":
            cross = net.zip(net.sigmoid(net.linear(xc, f"cross{i}.G")), cross, d, "A * B")
        xc = net.zip(cross, xc, d, "A + B")
    if spec.deep_type == "bottleneck":
        xd = net.deep(x0, spec, "")
    else:
        xd = x0
        for i in range(spec.deep_layers):
            xd = _expert_layer(net, xd, f"deep{i}", spec)
    return net.tail(xd, xc, spec, "", d, e)


def _logits(cross: str, deep: str, where: str = "") -> str:
    """Subquery (row_key, y0..y3, lg) of the scaled rows under one configuration."""
    from strata.operators.scoring import ModelSpec, weight_shapes

    spec = ModelSpec(input_dim=len(FEATURES), cross_type=cross, deep_type=deep)
    shapes = weight_shapes(spec)
    widths = sorted({s[1] for s in shapes.values() if len(s) == 2})
    rows = ", ".join(f"[[{_rule('r + 3 * j')} for j in range({n})] for r in range(11)] AS w{n}" for n in widths)
    tables = f"wv AS (SELECT {rows}, [{_rule('3 * j')} for j in range({max(max(s) for s in shapes.values())})] AS b)"
    extra = ""
    if deep == "moe":
        tables, extra = f"{tables},\n{_erf_table()}", " CROSS JOIN erft"
    chain = _Chain(f"(SELECT row_key, y0, y1, y2, y3, [{', '.join(FEATURES)}] AS x, * EXCLUDE ({', '.join(FEATURES)}, row_key, y0, y1, y2, y3) FROM (SELECT scaled.*, wv.*{', erft.*' if extra else ''} FROM scaled CROSS JOIN wv{extra}) {where})")
    net = _RuleNet(chain, shapes)
    logits = net.linear(_dcn(net, spec), "classifier")
    return f"WITH {tables},\n{','.join(chain.ctes)}\nSELECT row_key, y0, y1, y2, y3, {logits} AS lg FROM {chain.prev}"


def _long(source: str) -> str:
    return " UNION ALL ".join(f"SELECT row_key, CAST({i} AS INTEGER) AS label, y{i} AS y, lg[{i + 1}] AS z FROM {source}" for i in range(4))


def dcn_sql() -> dict[str, str]:
    from strata.operators.runs import config_grid
    from strata.plans.oracle import r6
    from strata.plans.oracle_analytics import _auc, _confusion, _scores, _steps, _summary

    out = {}
    for name, cross, deep in (("bottleneck", "standard", "bottleneck"), ("moe", "standard", "moe"), ("gated", "gated", "bottleneck")):
        out[f"score_dcn_{name}"] = _wcte(SCALED, f"scored AS MATERIALIZED ({_logits(cross, deep)})") + (
            f"SELECT row_key, label, y, round(z, 4) + 0e0 AS logit, round({PROB}, 4) + 0e0 AS prob FROM ({_long('scored')})"
        )
    parts, ctes = [], []
    for i, cross, deep in config_grid():
        ctes += [
            f"w{i} AS MATERIALIZED ({_logits(cross, deep, "WHERE split = 'test'")})",
            f"t{i} AS (SELECT row_key, label, y, {PROB} AS prob FROM ({_long(f'w{i}')}))",
            f"half{i} AS (SELECT DISTINCT label, 0.5e0 AS threshold FROM t{i})",
            f"conf{i} AS ({_confusion(f't{i}', f'half{i}')})", f"sc{i} AS ({_scores(f'conf{i}')})", f"su{i} AS ({_summary(f'sc{i}')})",
            _steps(f"t{i}", f"st{i}"), f"au{i} AS ({_auc(f'st{i}')})", _steps(f"t{i}", f"stm{i}", part="0"), f"aum{i} AS ({_auc(f'stm{i}')})",
        ]
        bad = f"((SELECT count(*) FROM au{i} WHERE auc IS NULL) > 0)"
        parts.append(
            f"SELECT '{cross}' AS cross_type, '{deep}' AS deep_type, {r6('recall_macro')} AS acc, {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro,"
            f" {r6(f'CASE WHEN {bad} THEN 0e0 ELSE coalesce((SELECT auc FROM aum{i}), 0e0) END')} AS auc_micro,"
            f" {r6(f'CASE WHEN {bad} THEN 0e0 ELSE (SELECT avg(auc) FROM au{i}) END')} AS auc_macro, '{cross}_{deep}' AS run_name FROM su{i}"
        )
    out["run_grid"] = _wcte(SCALED, *ctes) + "\nUNION ALL\n".join(parts)
    return out


def gradient_sql() -> dict[str, str]:
    """Mean gradients of the linear head, written out per row part: positive rows have the
    derivative ``da`` and negative ones ``db`` (losses' fixed constants: gamma 2; 4, 1, 0.01)."""
    from strata.operators.losses import LOSSES
    from strata.plans.catalog_models import gradient_weights
    from strata.plans.oracle import r6

    w, b = gradient_weights(len(FEATURES))
    sig = lambda u: f"CASE WHEN {u} >= 0 THEN 1e0 / (1e0 + exp(-abs({u}))) ELSE exp(-abs({u})) / (1e0 + exp(-abs({u}))) END"
    lsg = lambda u: f"(least({u}, 0e0) - ln(1e0 + exp(-abs({u}))))"
    focal = lambda q, rest, lnq, g: f"pow({rest}, {g}) * ({g} * {q} * {lnq} - {rest})"
    cut = "greatest(p - 0.01e0, 0e0)"
    asl = f"(4e0 * pow({cut}, 3e0) * p * r * (-ln_r) * CAST(p > 0.01e0 AS DOUBLE) + pow({cut}, 4e0) * p)"
    parts = {
        "bce": ("-r", "p"), "cb": ("-r", "p"), "focal": (focal("p", "r", "ln_p", "2e0"), "-(" + focal("r", "p", "ln_r", "2e0") + ")"),
        "asl": (focal("p", "r", "ln_p", "1e0"), asl),
    }
    parts["cb_focal"] = parts["focal"]
    out = {}
    for loss in LOSSES:
        da, db = parts[loss]
        neg = "0.5e0" if loss.startswith("cb") else "1e0"
        rows = []
        for i in range(4):
            z = " + ".join(f"({_num(w[i, j])}) * {f}" for j, f in enumerate(FEATURES)) + f" + ({_num(b[i])})"
            inner = f"SELECT *, {sig('z')} AS p, {sig('(-z)')} AS r, {lsg('z')} AS ln_p, {lsg('(-z)')} AS ln_r FROM (SELECT *, CAST(y{i} AS DOUBLE) AS y, {z} AS z FROM scaled WHERE split = 'train')"
            grad = f"SELECT *, {1.0 + i}e0 * y * ({da}) + {neg} * (1e0 - y) * ({db}) AS g FROM ({inner})"
            rows += [f"SELECT CAST({i} AS INTEGER) AS label, '{f}' AS feature, {r6(f'avg(g * {x})')} AS gradient FROM ({grad})" for f, x in [*((f, f) for f in FEATURES), ("", "1e0")]]
        out[f"gradient_{loss}"] = _wcte(SCALED) + " UNION ALL ".join(rows)
    return out
