"""DuckDB oracle for the gradients of the trainable heads.

Forward and backward pass are written out as scalar columns, one per unit, in a chain of CTEs: each
stage only uses columns of the one before. The chain rule is applied to the network by hand here;
the Spark side multiplies matrices.
"""

from __future__ import annotations

from strata.plans.fixtures import rational_weights
from strata.plans.oracle import FEATURES, SCALED, _wcte, r6
from strata.plans.oracle_fusion import _num

LN_EPS = "1e-05"


class _Stages:
    """CTEs ``s1, s2, ...``; ``add`` computes new columns from those of all earlier stages."""

    def __init__(self, source: str) -> None:
        self.ctes: list[str] = []
        self.last = source

    def add(self, cols: dict[str, str]) -> None:
        name = f"s{len(self.ctes) + 1}"
        body = ", ".join(f"{expr} AS {col}" for col, expr in cols.items())
        self.ctes.append(f"{name} AS (SELECT *, {body} FROM {self.last})")
        self.last = name


def _dot(weights, columns: list[str]) -> str:
    return "(" + " + ".join(f"{_num(w)} * {c}" for w, c in zip(weights, columns, strict=True)) + ")"


def _losses(n: int) -> dict[str, list[str]]:
    """Per loss the derivative in each logit ``z0..`` (positive and negative rows apart; fixed
    constants: gamma 2; 4, 1, 0.01)."""
    out: dict[str, list[str]] = {k: [] for k in ("bce", "focal", "asl", "cb", "cb_focal")}
    for i in range(n):
        p, r, lp, lr = (f"{c}{i}" for c in ("p", "r", "lp", "lr"))
        focal = lambda q, s, ln, g: f"pow({s}, {g}) * ({g} * {q} * {ln} - {s})"
        cut = f"greatest({p} - 0.01e0, 0e0)"
        asl = f"(4e0 * pow({cut}, 3e0) * {p} * {r} * (-{lr}) * CAST({p} > 0.01e0 AS DOUBLE) + pow({cut}, 4e0) * {p})"
        both = {"bce": (f"-{r}", p), "focal": (focal(p, r, lp, "2e0"), f"-({focal(r, p, lr, '2e0')})"), "asl": (focal(p, r, lp, "1e0"), asl)}
        both |= {"cb": both["bce"], "cb_focal": both["focal"]}
        for loss, (da, db) in both.items():
            neg = "0.5e0" if loss.startswith("cb") else "1e0"
            out[loss].append(f"({1.0 + i}e0 * t{i} * ({da}) + {neg} * (1e0 - t{i}) * ({db}))")
    return out


def _probabilities(st: _Stages, logits: list[str], targets: list[str]) -> None:
    st.add({f"z{i}": z for i, z in enumerate(logits)} | {f"t{i}": f"CAST({y} AS DOUBLE)" for i, y in enumerate(targets)})
    e = lambda i: f"exp(-abs(z{i}))"
    st.add({
        k: v for i in range(len(logits)) for k, v in {
            f"p{i}": f"CASE WHEN z{i} >= 0 THEN 1e0 / (1e0 + {e(i)}) ELSE {e(i)} / (1e0 + {e(i)}) END",
            f"r{i}": f"CASE WHEN z{i} <= 0 THEN 1e0 / (1e0 + {e(i)}) ELSE {e(i)} / (1e0 + {e(i)}) END",
            f"lp{i}": f"(least(z{i}, 0e0) - ln(1e0 + {e(i)}))", f"lr{i}": f"(least(-z{i}, 0e0) - ln(1e0 + {e(i)}))",
        }.items()
    })


def _rows(loss: str, last: str, gradients: dict[str, list[str]]) -> list[str]:
    """One aggregate row, turned into (loss, parameter, position, gradient) rows."""
    flat = [(name, k, e) for name, exprs in gradients.items() for k, e in enumerate(exprs)]
    sums = ", ".join(f"{r6(f'avg({e})')} AS g{j}" for j, (_, _, e) in enumerate(flat))
    rows = ", ".join(f"{{'parameter': '{name}', 'position': {k}, 'gradient': g{j}}}" for j, (name, k, _) in enumerate(flat))
    return [f"SELECT '{loss}' AS loss, u.parameter, CAST(u.position AS INTEGER) AS position, u.gradient FROM (SELECT unnest([{rows}]) AS u FROM (SELECT {sums} FROM {last}))"]


def _cross() -> str:
    from strata.plans.catalog_models import cross_head

    head = cross_head(len(FEATURES))
    w = {k: rational_weights(s) for k, s in head.shapes().items()}
    d, r, n = range(head.n_features), range(head.rank), range(head.n_labels)
    ctes, parts = [], []
    for loss in _losses(head.n_labels):
        st = _Stages(f"(SELECT * FROM scaled WHERE split = 'train') AS src_{loss}")
        st.add({f"x0_{i}": f for i, f in enumerate(FEATURES)})
        for k in range(head.layers):
            x = [f"x{k}_{i}" for i in d]
            st.add({f"u{k}_{a}": _dot(w[f"U{k}"][a], x) for a in r})
            st.add({f"v{k}_{i}": f"({_dot(w[f'V{k}'][i], [f'u{k}_{a}' for a in r])} + {_num(w[f'b{k}'][i])})" for i in d})
            st.add({f"x{k + 1}_{i}": f"(x0_{i} * v{k}_{i} + x{k}_{i})" for i in d})
        top = [f"x{head.layers}_{i}" for i in d]
        _probabilities(st, [f"({_dot(w['W'][i], top)} + {_num(w['b'][i])})" for i in n], [f"y{i}" for i in n])
        st.add({f"g{i}": e for i, e in enumerate(_losses(head.n_labels)[loss])})
        st.add({f"dx{head.layers}_{i}": _dot(w["W"][:, i], [f"g{j}" for j in n]) for i in d})
        for k in reversed(range(head.layers)):
            st.add({f"ds{k}_{i}": f"(dx{k + 1}_{i} * x0_{i})" for i in d})
            st.add({f"du{k}_{a}": _dot(w[f"V{k}"][:, a], [f"ds{k}_{i}" for i in d]) for a in r})
            st.add({f"dx{k}_{i}": f"(dx{k + 1}_{i} + {_dot(w[f'U{k}'][:, i], [f'du{k}_{a}' for a in r])})" for i in d})
        grads: dict[str, list[str]] = {}
        for k in range(head.layers):
            grads[f"U{k}"] = [f"du{k}_{a} * x{k}_{i}" for a in r for i in d]
            grads[f"V{k}"] = [f"ds{k}_{i} * u{k}_{a}" for i in d for a in r]
            grads[f"b{k}"] = [f"ds{k}_{i}" for i in d]
        grads |= {"W": [f"g{j} * {c}" for j in n for c in top], "b": [f"g{j}" for j in n]}
        ctes += _renamed(st, loss)
        parts += _rows(loss, f"{loss}_{st.last}", grads)
    return _wcte(SCALED, *ctes) + "\nUNION ALL\n".join(parts)


def _renamed(st: _Stages, loss: str) -> list[str]:
    """Stage names with the loss in front, so that the chains of all losses stand in one statement."""
    out = []
    for i, cte in enumerate(st.ctes, start=1):
        cte = f"{loss}_{cte}"
        out.append(cte.replace(f" FROM s{i - 1})", f" FROM {loss}_s{i - 1})") if i > 1 else cte)
    return out


def _fusion() -> str:
    from strata.plans.catalog_models import fusion_head
    from strata.plans.oracle_fusion import fusion_base

    head = fusion_head()
    w = {k: rational_weights(s) for k, s in head.shapes().items()}
    e, n = range(head.embed_dim), range(head.n_labels)
    names = lambda c: [f"{c}{i}" for i in e]
    mean = lambda c: "((" + " + ".join(c) + f") / {head.embed_dim}e0)"
    ctes, parts = [], []
    for loss in _losses(head.n_labels):
        st = _Stages(f"(SELECT * FROM fx WHERE split = 'train') AS src_{loss}")
        vec = lambda row: "[" + ", ".join(_num(v) for v in row) + "]"
        st.add({f"h{i}": f"(list_dot_product(x, {vec(w['num'][i])}) + {_num(w['num_b'][i])})" for i in e}
               | {f"a{i}": f"(list_dot_product(emb, {vec(w['text'][i])}) + {_num(w['text_b'][i])})" for i in e})
        st.add({"mu": mean(names("a"))})
        st.add({f"c{i}": f"(a{i} - mu)" for i in e})
        st.add({"sd": f"sqrt({mean([f'c{i} * c{i}' for i in e])} + {LN_EPS})"})
        st.add({f"m{i}": f"(c{i} / sd)" for i in e})
        st.add({f"x{i}": f"greatest(m{i} * {_num(w['scale'][i])} + {_num(w['shift'][i])}, 0e0)" for i in e})
        st.add({f"q{i}": f"({_dot(w['gate'][i], [*names('h'), *names('x')])} + {_num(w['gate_b'][i])})" for i in e})
        st.add({f"k{i}": f"CASE WHEN q{i} >= 0 THEN 1e0 / (1e0 + exp(-abs(q{i}))) ELSE exp(-abs(q{i})) / (1e0 + exp(-abs(q{i}))) END" for i in e})
        st.add({f"f{i}": f"(k{i} * h{i} + (1e0 - k{i}) * x{i})" for i in e})
        _probabilities(st, [f"({_dot(w['W'][j], names('f'))} + {_num(w['b'][j])})" for j in n], ["quality", "toxic"])
        st.add({f"g{j}": expr for j, expr in enumerate(_losses(head.n_labels)[loss])})
        st.add({f"df{i}": _dot(w["W"][:, i], [f"g{j}" for j in n]) for i in e})
        st.add({f"dq{i}": f"(df{i} * (h{i} - x{i}) * k{i} * (1e0 - k{i}))" for i in e})
        st.add({f"dh{i}": f"(df{i} * k{i} + {_dot(w['gate'][:, i], names('dq'))})" for i in e}
               | {f"dx{i}": f"((df{i} * (1e0 - k{i}) + {_dot(w['gate'][:, head.embed_dim + i], names('dq'))}) * CAST(x{i} > 0 AS DOUBLE))" for i in e})
        st.add({f"dm{i}": f"(dx{i} * {_num(w['scale'][i])})" for i in e})
        st.add({"mean_dm": mean(names("dm")), "mean_dmm": mean([f"dm{i} * m{i}" for i in e])})
        st.add({f"da{i}": f"((dm{i} - mean_dm - m{i} * mean_dmm) / sd)" for i in e})
        both = [*names("h"), *names("x")]
        grads = {
            "num": [f"dh{i} * x[{j + 1}]" for i in e for j in range(head.n_features)], "num_b": names("dh"),
            "text": [f"da{i} * emb[{j + 1}]" for i in e for j in range(head.text_dim)], "text_b": names("da"),
            "scale": [f"dx{i} * m{i}" for i in e], "shift": names("dx"),
            "gate": [f"dq{i} * {c}" for i in e for c in both], "gate_b": names("dq"),
            "W": [f"g{j} * f{i}" for j in n for i in e], "b": [f"g{j}" for j in n],
        }
        ctes += _renamed(st, loss)
        parts += _rows(loss, f"{loss}_{st.last}", grads)
    return _wcte(*fusion_base(), *ctes) + "\nUNION ALL\n".join(parts)


def heads_sql() -> dict[str, str]:
    return {"gradient_cross": _cross(), "gradient_fusion": _fusion()}
