"""Trainable heads: forward and backward passes of a block of rows as matrix products.

A head maps numeric features ``x`` (and, for the fusion head, a text vector ``t``) to one logit per
label. Its parameters are one flat vector; ``forward`` returns the logits, a gate (or None) and
what ``backward`` needs to turn ``dL/dlogit`` into the gradient of all parameters. The trainer runs
both inside tasks on Arrow batches and adds up what the blocks return.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LN_EPS = 1e-5


class Head:
    """Parameters by name; subclasses give ``shapes`` and the two passes."""

    reads_text = False

    def shapes(self) -> dict[str, tuple[int, ...]]:
        raise NotImplementedError

    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes().values())

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def join(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([parts[name].ravel() for name in self.shapes()])

    def start(self, seed: int) -> np.ndarray:
        """Uniform in +-1/sqrt(fan in) (a bias like its matrix); scales one, shifts zero."""
        rng = np.random.default_rng(seed)
        out, bound = {}, 1.0
        for name, shape in self.shapes().items():
            if name.endswith(("scale", "shift")):
                out[name] = np.full(shape, 1.0 if name.endswith("scale") else 0.0)
                continue
            bound = 1.0 / math.sqrt(shape[1]) if len(shape) == 2 else bound
            out[name] = rng.uniform(-bound, bound, size=shape)
        return self.join(out)

    def forward(self, w: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, tuple]:
        raise NotImplementedError

    def backward(self, w: dict[str, np.ndarray], kept: tuple, dz: np.ndarray) -> dict[str, np.ndarray]:
        raise NotImplementedError


@dataclass(frozen=True)
class Linear(Head):
    """``z = W x + b``."""

    n_features: int
    n_labels: int

    def shapes(self):
        return {"W": (self.n_labels, self.n_features), "b": (self.n_labels,)}

    def forward(self, w, x, t):
        return x @ w["W"].T + w["b"], None, (x,)

    def backward(self, w, kept, dz):
        return {"W": dz.T @ kept[0], "b": dz.sum(axis=0)}


@dataclass(frozen=True)
class LowRankCross(Head):
    """Cross layers ``x' = x0 * (V (U x) + b) + x`` of a low rank, then a linear head."""

    n_features: int
    n_labels: int
    layers: int = 2
    rank: int = 32

    def shapes(self):
        out: dict[str, tuple[int, ...]] = {}
        for k in range(self.layers):
            out |= {f"U{k}": (self.rank, self.n_features), f"V{k}": (self.n_features, self.rank), f"b{k}": (self.n_features,)}
        return out | {"W": (self.n_labels, self.n_features), "b": (self.n_labels,)}

    def forward(self, w, x, t):
        levels, inner = [x], []
        for k in range(self.layers):
            u = levels[-1] @ w[f"U{k}"].T
            s = u @ w[f"V{k}"].T + w[f"b{k}"]
            inner.append((u, s))
            levels.append(x * s + levels[-1])
        return levels[-1] @ w["W"].T + w["b"], None, (levels, inner)

    def backward(self, w, kept, dz):
        levels, inner = kept
        out = {"W": dz.T @ levels[-1], "b": dz.sum(axis=0)}
        dx = dz @ w["W"]
        for k in reversed(range(self.layers)):
            u, _ = inner[k]
            ds = dx * levels[0]  # x0 is an input: it takes no gradient
            du = ds @ w[f"V{k}"]
            out |= {f"b{k}": ds.sum(axis=0), f"V{k}": ds.T @ u, f"U{k}": du.T @ levels[k]}
            dx = dx + du @ w[f"U{k}"]
        return out


@dataclass(frozen=True)
class GatedFusion(Head):
    """Numeric and text side projected to one width (the text side layer-normed and rectified), mixed
    by a sigmoid gate over both, then a linear head."""

    n_features: int
    text_dim: int
    n_labels: int
    embed_dim: int = 128
    reads_text = True

    def shapes(self):
        e = self.embed_dim
        return {
            "num": (e, self.n_features), "num_b": (e,), "text": (e, self.text_dim), "text_b": (e,), "scale": (e,), "shift": (e,),
            "gate": (e, 2 * e), "gate_b": (e,), "W": (self.n_labels, e), "b": (self.n_labels,),
        }

    def forward(self, w, x, t):
        num = x @ w["num"].T + w["num_b"]
        a = t @ w["text"].T + w["text_b"]
        centred = a - a.mean(axis=1, keepdims=True)
        spread = np.sqrt((centred**2).mean(axis=1, keepdims=True) + LN_EPS)
        normed = centred / spread
        text = np.maximum(normed * w["scale"] + w["shift"], 0.0)
        both = np.concatenate([num, text], axis=1)
        g = sigmoid(both @ w["gate"].T + w["gate_b"])
        fused = g * num + (1.0 - g) * text
        return fused @ w["W"].T + w["b"], g, (x, t, num, normed, spread, text, both, g, fused)

    def backward(self, w, kept, dz):
        x, t, num, normed, spread, text, both, g, fused = kept
        e = self.embed_dim
        df = dz @ w["W"]
        dq = df * (num - text) * g * (1.0 - g)  # at the gate's sigmoid
        dboth = dq @ w["gate"]
        dnum = df * g + dboth[:, :e]
        drect = (df * (1.0 - g) + dboth[:, e:]) * (text > 0)
        dn = drect * w["scale"]
        da = (dn - dn.mean(axis=1, keepdims=True) - normed * (dn * normed).mean(axis=1, keepdims=True)) / spread
        return {
            "num": dnum.T @ x, "num_b": dnum.sum(axis=0), "text": da.T @ t, "text_b": da.sum(axis=0),
            "scale": (drect * normed).sum(axis=0), "shift": drect.sum(axis=0), "gate": dq.T @ both, "gate_b": dq.sum(axis=0),
            "W": dz.T @ fused, "b": dz.sum(axis=0),
        }


# ----------------------------------------------------------------- losses on blocks


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def log_sigmoid(z: np.ndarray) -> np.ndarray:
    return np.minimum(z, 0.0) - np.log1p(np.exp(-np.abs(z)))


def _both_sides(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``sigmoid(z)``, ``sigmoid(-z)`` and their logarithms from one exponential and one logarithm."""
    e = np.exp(-np.abs(z))
    up, log = z >= 0, np.log1p(e)
    return np.where(up, 1.0, e) / (1.0 + e), np.where(up, e, 1.0) / (1.0 + e), np.minimum(z, 0.0) - log, np.minimum(-z, 0.0) - log


def _focal(q: np.ndarray, rest: np.ndarray, logq: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """``(1-q)^g (-ln q)`` with ``q = sigmoid(u)``, and its slope in ``u``."""
    power = rest**gamma
    return power * -logq, power * (gamma * q * logq - rest)


@dataclass(frozen=True)
class BlockLoss:
    """One loss with its per-label weights (``w_pos``, ``w_neg``), for logit blocks of rows by labels."""

    name: str
    w_pos: np.ndarray
    w_neg: np.ndarray
    gamma: float
    gamma_neg: float
    gamma_pos: float
    clip: float

    def __call__(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Element losses and ``dL/dz``; the same functions as the column expressions of the trainer."""
        p, rest, logp, logrest = _both_sides(z)
        if self.name in ("bce", "cb"):
            a, da, b, db = -logp, -rest, -logrest, p
        elif self.name in ("focal", "cb_focal"):
            (a, da), (b, back) = _focal(p, rest, logp, self.gamma), _focal(rest, p, logrest, self.gamma)
            db = -back
        elif self.name == "asl":
            m = np.maximum(p - self.clip, 0.0)
            a, da = _focal(p, rest, logp, self.gamma_pos)
            soft = -logrest
            b = m**self.gamma_neg * soft
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = np.where(p > self.clip, self.gamma_neg * m ** (self.gamma_neg - 1) * p * rest * soft, 0.0)
            db = slope + m**self.gamma_neg * p
        else:
            raise ValueError(f"Unknown loss: {self.name}")
        pos, neg = self.w_pos * y, self.w_neg * (1.0 - y)
        return pos * a + neg * b, pos * da + neg * db


#: Numbers of a block of logits that ``LinearOptions`` holds at a time (a few such blocks fit a core's cache),
#: and the margin from which on exp would leave the doubles.
BLOCK_LOGITS, FAR = 1 << 15, 700.0


def _times_power(out: np.ndarray, x: np.ndarray, g: float) -> None:
    """``out *= x**g``; small whole powers by products."""
    if g in (0, 1, 2, 3, 4):
        for _ in range(int(g)):
            out *= x
    else:
        out *= x**g


class LinearOptions:
    """Linear heads of several options over the same rows with labels 0 and 1.

    Options whose losses are one function (of several weights) are one matrix of logits, options by labels
    by rows. With hard labels an element has one side only: its loss and slope are functions of the margin, ``z``
    or ``-z``, which take one exponential and one logarithm."""

    def __init__(self, head: Linear, thetas: dict[int, np.ndarray], losses_of: dict[int, BlockLoss]) -> None:
        self.head, self.options = head, list(thetas)
        groups: dict[tuple, list[int]] = {}
        for i, option in enumerate(self.options):
            loss = losses_of[option]
            kind = {"bce": "log", "cb": "log", "focal": "focal", "cb_focal": "focal", "asl": "asl"}.get(loss.name)
            if kind is None:
                raise ValueError(f"Unknown loss: {loss.name}")
            settings = {"log": (), "focal": (loss.gamma,), "asl": (loss.gamma_neg, loss.gamma_pos, loss.clip)}[kind]
            groups.setdefault((kind, *settings), []).append(i)
        self.groups, self.weights = [], []
        for kind, members in groups.items():
            w = [head.parts(thetas[self.options[i]]) for i in members]
            wide = np.concatenate([np.concatenate([p["W"], p["b"][:, None]], axis=1) for p in w])
            self.groups.append((kind, members, wide, [self._weight(losses_of[self.options[i]]) for i in members]))
        labels = head.n_labels
        self.step = max(256, BLOCK_LOGITS // (labels * max([len(m) for m in groups.values()], default=1)))
        most = max([len(m) for m in groups.values()], default=1) * labels * self.step
        self.room = [np.empty(most) for _ in range(4)]

    def _weight(self, loss: BlockLoss) -> int:
        """The number of an option's label weights; options often have the same."""
        both = [w * np.ones(self.head.n_labels) for w in (loss.w_pos, loss.w_neg)]
        for k, known in enumerate(self.weights):
            if all((a[:, 0] == b).all() for a, b in zip(known, both, strict=True)):
                return k
        self.weights.append([w[:, None] for w in both])
        return len(self.weights) - 1

    @staticmethod
    def takes(y: np.ndarray) -> bool:
        return bool(y.max(initial=0) <= 1) if y.dtype == np.uint8 else bool(((y == 0) | (y == 1)).all())

    def sums(self, x: np.ndarray, y: np.ndarray, gradient: bool) -> np.ndarray:
        """Per option its gradient sums (if asked for), loss sum, rows, and true and false positives and false
        negatives of each label at logit 0."""
        labels, features, size = self.head.n_labels, self.head.n_features, self.head.size() if gradient else 0
        out = np.zeros((len(self.options), size + 2 + 3 * labels))
        for i in range(0, len(x), self.step):
            n = len(x[i : i + self.step])
            across = np.ones((features + 1, n))  # the last row takes the biases
            across[:features] = x[i : i + n].T
            truth = np.empty((labels, n))
            truth[:] = y[i : i + n].T
            pos = truth > 0.5
            sign = 1.0 - 2.0 * truth  # the margin with its sign turned is z * sign
            weights = [np.where(pos, *w) for w in self.weights]
            signed = [w * sign for w in weights] if gradient else []
            positives = _hits(pos)
            for kind, members, wide, own in self.groups:
                shape = (len(members), labels, n)
                room = [r[: len(wide) * n].reshape(shape) for r in self.room]
                z = room[0]
                np.matmul(wide, across, out=z.reshape(len(wide), n))
                hit = z >= 0
                hits = _hits(hit)
                hit &= pos
                tp = _hits(hit)
                z *= sign
                el, slope = _margin_loss(kind, room, pos)
                at = np.empty((len(members), out.shape[1]))
                for k, w in enumerate(own):
                    at[k, size] = np.vdot(el[k], weights[w])
                    if gradient:
                        slope[k] *= signed[w]
                if gradient:
                    g = (slope.reshape(len(wide), n) @ across.T).reshape(len(members), labels, features + 1)
                    at[:, : labels * features] = g[:, :, :features].reshape(len(members), -1)
                    at[:, labels * features : size] = g[:, :, features]
                at[:, size + 1] = n
                at[:, size + 2 :] = np.concatenate([tp, hits - tp, positives - tp], axis=1)
                out[members] += at
        return out


def linear_scores(head: Linear, thetas: dict[int, np.ndarray], rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(option, ``sigmoid`` of its logits, labels by rows) of rows in parts."""
    for option, theta in thetas.items():
        w = head.parts(theta)
        out, i = np.empty((head.n_labels, sum(map(len, rows)))), 0
        for x in rows:
            z = w["W"] @ x.T
            z += w["b"][:, None]
            out[:, i : i + len(x)] = sigmoid(z)
            i += len(x)
        yield option, out


def _hits(flags: np.ndarray) -> np.ndarray:
    return flags.view(np.int8).sum(axis=-1, dtype=np.int32)


def _margin_loss(kind: tuple, room: list[np.ndarray], pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unweighted element losses and their slopes in ``u = room[0]``, the margin with its sign turned: the
    functions of ``BlockLoss`` for labels 0 and 1. All four arrays are overwritten."""
    t, d, s, spare = room
    over = None
    if t.max(initial=-np.inf) > FAR:
        over = np.maximum(t - FAR, 0.0)
        np.minimum(t, FAR, out=t)
    np.exp(t, out=t)
    np.log1p(t, out=s)  # -ln of the true class's probability, which is 1 / d
    if over is not None:
        s += over
    np.add(t, 1.0, out=d)
    if kind[0] == "log":
        return s, np.divide(t, d, out=t)
    q = np.divide(1.0, d, out=d)
    r = np.multiply(t, q, out=t)  # probability of the false class
    qs = np.multiply(q, s, out=q)
    if kind[0] == "focal":
        gamma = kind[1]
        qs *= gamma
        qs += r
        _times_power(s, r, gamma)
        _times_power(qs, r, gamma)
        return s, qs
    gamma_neg, gamma_pos, clip = kind[1:]
    qs *= np.where(pos, gamma_pos, gamma_neg)
    base = np.subtract(r, np.where(pos, 0.0, clip), out=spare)
    np.maximum(base, 0.0, out=base)
    qs += base
    qs *= r
    s *= base
    low = np.ones_like(base)
    _times_power(low, base, gamma_neg - 1)
    if gamma_neg <= 1:
        low = np.where(base > 0, low, 0.0)
    high = 1.0
    if gamma_pos != 1:
        high = np.ones_like(base)
        _times_power(high, base, gamma_pos - 1)
        high = high if gamma_pos > 1 else np.where(base > 0, high, 0.0)
    power = np.where(pos, high, low)
    s *= power
    qs *= power
    return s, qs
