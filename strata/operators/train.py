"""Data-parallel training of multi-label heads under any supported loss, many options at once.

An option is a loss, a seed and optimiser settings. The rows are written once as packed matrices,
dealt evenly over the tasks. Per epoch ONE pass over that table returns, for all options that still run, the loss sums and the gradients of all parameters:
tasks multiply matrices per Arrow batch (``heads``), partial sums are merged by Spark in blocks,
and only as many numbers as there are parameters reach the driver, which runs the optimiser (AdamW,
gradient-norm clipping, warm-up + cosine learning rate) over them. Validation macro-AUC after every epoch drives
early stopping; the best parameters are kept. Steps are full-batch, or mini-batch rounds whose
partitions are averaged.

The linear head's gradient also exists as column expressions (``gradient_sums``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import (
    ASL_CLIP, ASL_GAMMA_NEG, ASL_GAMMA_POS, CB_BETA, FOCAL_GAMMA, GATE_NEAR_ONE_BATCH, GATE_NEAR_ZERO_BATCH, PATIENCE,
)
from strata.functions.columns import log_sigmoid, sigmoid, softplus
from strata.operators import heads, losses, ranking
from strata.operators.prep import effective_number_weights, pos_weight
from strata.session import spread
from strata.sources.tables import LOG_SCHEMA, write_shared_table


@dataclass
class LinearModel:
    """Multi-label linear head ``z = W x + b``."""

    features: list[str]
    W: np.ndarray
    b: np.ndarray
    history: list[dict] = field(default_factory=list)
    best_epoch: int | None = None

    def with_parameters(self, df: DataFrame) -> DataFrame:
        """``df`` beside the parameters as data (one broadcast row): every epoch runs the same
        generated code, whatever the parameters' values."""
        row = [([[float(x) for x in w] for w in self.W], [float(x) for x in self.b])]
        return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(row, "_w array<array<double>>, _b array<double>")))

    def logits(self) -> list[Column]:
        """Logit columns over ``with_parameters``."""
        return [
            sum((F.col("_w")[l][j] * F.col(f) for j, f in enumerate(self.features)), F.col("_b")[l])
            for l in range(self.W.shape[0])
        ]

    def save(self, spark, path: str) -> None:
        """Store the parameters as a ``(label, feature, value)`` table; the bias is feature ''."""
        rows = [(l, f, float(v)) for l in range(len(self.b)) for f, v in [*zip(self.features, self.W[l]), ("", self.b[l])]]
        spark.createDataFrame(rows, "label int, feature string, value double").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark, path: str, features: list[str]) -> LinearModel:
        got = {(r["label"], r["feature"]): r["value"] for r in spark.read.parquet(path).collect()}  # labels x features rows
        n = 1 + max(l for l, _ in got)
        return cls(features, np.array([[got[(l, f)] for f in features] for l in range(n)]), np.array([got[(l, "")] for l in range(n)]))

    def score(self, df: DataFrame, key_cols: list[str], label_cols: list[str]) -> DataFrame:
        """Long scored table ``(key, label, y, logit, prob)`` (a projection + explode)."""
        rows = [
            F.struct(F.lit(l).alias("label"), F.col(c).cast("int").alias("y"), z.alias("logit"))
            for l, (c, z) in enumerate(zip(label_cols, self.logits()))
        ]
        long = self.with_parameters(df).select(*key_cols, F.inline(F.array(*rows)))
        return long.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))))


def lr_at(epoch: int, lr: float, warmup: int = 20, t_max: int = 80) -> float:
    """Linear warm-up from 0.1*lr over ``warmup`` epochs, then cosine to 0.1*lr."""
    if epoch < warmup:
        return lr * (0.1 + 0.9 * epoch / warmup)
    return 0.1 * lr + 0.9 * lr * (1 + math.cos(math.pi * (epoch - warmup) / t_max)) / 2


def _focal_grad(u: Column, gamma: float) -> Column:
    """d/du of ``(1-q)^g (-ln q)`` with ``q = sigmoid(u)``: ``(1-q)^g (g q ln q - (1-q))``. ``ln q``
    and ``1-q`` come from ``u`` itself, so they are finite however wrong the row is scored."""
    q, rest = sigmoid(u), sigmoid(-u)
    return F.pow(rest, F.lit(gamma)) * (F.lit(gamma) * q * log_sigmoid(u) - rest)


def loss_and_grad(z: Column, y: Column, loss: str, w_pos: Column, w_neg: Column, alpha: Column, gamma: float,
                  gamma_neg: float, gamma_pos: float, clip: float) -> tuple[Column, Column]:
    """Element loss (of ``losses.loss_parts``) and ``dL/dz`` as column expressions."""
    one = F.lit(1.0)
    a, b = losses.loss_parts(loss, z, y, gamma, gamma_neg, gamma_pos, clip)
    if loss in ("bce", "cb"):
        da, db = -sigmoid(-z), sigmoid(z)
    elif loss in ("focal", "cb_focal"):
        da, db = _focal_grad(z, gamma), -_focal_grad(-z, gamma)
    else:  # asl; loss_parts has refused any other
        p = sigmoid(z)
        m = F.greatest(p - F.lit(clip), F.lit(0.0))
        da = _focal_grad(z, gamma_pos)
        inner = F.when(p > F.lit(clip), F.lit(gamma_neg) * F.pow(m, F.lit(gamma_neg - 1)) * p * sigmoid(-z) * softplus(z)).otherwise(F.lit(0.0))
        db = inner + F.pow(m, F.lit(gamma_neg)) * p
    pos, neg = (w_pos, w_neg) if loss in ("cb", "cb_focal") else (alpha, one)
    return pos * y * a + neg * (one - y) * b, pos * y * da + neg * (one - y) * db


def gradient_sums(
    rows: DataFrame, model: LinearModel, label_cols: list[str], loss: str, alpha: dict[int, float], cb: dict[int, tuple[float, float]],
    gamma: float = FOCAL_GAMMA, gamma_neg: float = ASL_GAMMA_NEG, gamma_pos: float = ASL_GAMMA_POS, clip: float = ASL_CLIP,
) -> DataFrame:
    """One row from one aggregate: ``g<label>_<feature number>`` and ``g<label>_b`` (gradient sums),
    ``loss_sum`` and ``n``. ``alpha`` and ``cb`` are the per-label weights."""
    aggs, terms = [], []
    for l, z in enumerate(model.logits()):
        w_pos, w_neg = cb[l]
        el, g = loss_and_grad(z, F.col(label_cols[l]), loss, F.lit(float(w_pos)), F.lit(float(w_neg)), F.lit(float(alpha[l])), gamma, gamma_neg, gamma_pos, clip)
        terms.append(el)
        aggs += [F.sum(g * F.col(f)).alias(f"g{l}_{j}") for j, f in enumerate(model.features)]
        aggs.append(F.sum(g).alias(f"g{l}_b"))
    aggs += [F.sum(sum(terms, F.lit(0.0))).alias("loss_sum"), F.count(F.lit(1)).alias("n")]
    return model.with_parameters(rows).agg(*aggs)


@dataclass(frozen=True)
class Option:
    """One configuration to fit: loss, seed and optimiser settings."""

    loss: str = "bce"
    seed: int = 0
    lr: float = 1e-3
    weight_decay: float = 1e-2
    max_grad_norm: float = 1.0
    gamma: float = FOCAL_GAMMA
    gamma_neg: float = ASL_GAMMA_NEG
    gamma_pos: float = ASL_GAMMA_POS
    clip: float = ASL_CLIP

    def block_loss(self, alpha: np.ndarray, cb: np.ndarray) -> heads.BlockLoss:
        """``alpha``: pos_weight per label; ``cb``: class-balanced (w_pos, w_neg) per label."""
        w_pos, w_neg = cb.T if self.loss in ("cb", "cb_focal") else (alpha, np.ones_like(alpha))
        return heads.BlockLoss(self.loss, w_pos, w_neg, self.gamma, self.gamma_neg, self.gamma_pos, self.clip)


@dataclass
class Fitted:
    """A fitted head: best parameters, their epoch and the log of every epoch."""

    head: heads.Head
    option: Option
    theta: np.ndarray
    history: list[dict] = field(default_factory=list)
    best_epoch: int | None = None


@dataclass
class _State:
    """Parameters and AdamW moments of one option."""

    theta: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: float = 0.0

    def step(self, grad: np.ndarray, lr: float, option: Option) -> float:
        """One AdamW step on a mean gradient, its norm clipped; returns the norm before clipping."""
        norm = float(np.linalg.norm(grad))
        if norm > option.max_grad_norm:
            grad = grad * (option.max_grad_norm / (norm + 1e-6))
        b1, b2, eps = 0.9, 0.999, 1e-8
        self.steps += 1
        self.m, self.v = b1 * self.m + (1 - b1) * grad, b2 * self.v + (1 - b2) * grad * grad
        mh, vh = self.m / (1 - b1**self.steps), self.v / (1 - b2**self.steps)
        self.theta = self.theta * (1 - lr * option.weight_decay) - lr * mh / (np.sqrt(vh) + eps)
        return norm

    def vector(self) -> np.ndarray:
        return np.concatenate([self.theta, self.m, self.v, [self.steps]])

    @classmethod
    def of(cls, v: np.ndarray) -> _State:
        n = (len(v) - 1) // 3
        return cls(v[:n], v[n : 2 * n], v[2 * n : 3 * n], float(v[-1]))


BLOCK = 1024  # numbers of a partial sum per row
_MERGE = 16  # partial sums of an option that reach the driver, at most
_PARTIAL = "option int, block int, part int, sums array<double>, most array<double>"


def block_rows(df: DataFrame, features: list[str], label_cols: list[str], text_col: str | None = None, batch_col: str | None = None) -> DataFrame:
    """Rows as the trainer's tasks read them: arrays ``x``, ``y`` (and ``t``, ``batch``)."""
    cols = [F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.array(*[F.col(c).cast("double") for c in label_cols]).alias("y")]
    if text_col:
        cols.append(F.col(text_col).cast("array<double>").alias("t"))
    if batch_col:
        cols.append(F.col(batch_col).cast("long").alias("batch"))
    return df.select(*cols)


#: Bytes of a packed row (a batch of them stays below 100 MB), and rows of a task's matrix products.
PACKED_BYTES, TASK_ROWS = 8192, 4096


def _matrix(record: pa.RecordBatch, name: str) -> np.ndarray | None:
    if name not in record.schema.names:
        return None
    column = record.column(name)
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(record.num_rows, -1)
    # packed: the matrices of a batch lie one after the other in the column's buffer
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + record.num_rows + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float64)
    return values.reshape(int(record.column("n").to_numpy().sum()), -1)


def _labels(record: pa.RecordBatch) -> np.ndarray | None:
    """The label matrix; of packed rows with a byte a label (``small_labels``) as bytes, if all of them are."""
    if "b" not in record.schema.names:
        return _matrix(record, "y")
    if record.column("y").null_count == record.num_rows:
        column, n = record.column("b"), int(record.column("n").to_numpy().sum())
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + record.num_rows + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(n, -1)
    some = zip(record.column("n").to_pylist(), record.column("b").to_pylist(), record.column("y").to_pylist(), strict=True)
    return np.concatenate([(np.frombuffer(y) if b is None else np.frombuffer(b, np.uint8).astype(np.float64)).reshape(n, -1) for n, b, y in some])


def _flags(record: pa.RecordBatch) -> np.ndarray:
    """Of each row, whether it is a validation row."""
    if "val" not in record.schema.names:
        return np.zeros(record.num_rows if "n" not in record.schema.names else int(record.column("n").to_numpy().sum()), bool)
    flags = record.column("val").to_numpy(zero_copy_only=False)
    return np.repeat(flags, record.column("n").to_numpy()) if "n" in record.schema.names else flags


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(validation rows?, x, y, t) of at most ``TASK_ROWS`` rows, out of Arrow batches of rows or packed rows."""
    for record in batches:
        if not record.num_rows:
            continue
        matrices, flags = [_matrix(record, "x"), _labels(record), _matrix(record, "t")], _flags(record)
        edge = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
        if len(edge) <= 2 + len(flags) // TASK_ROWS:  # long runs are read where they lie
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                for i in range(a, b, TASK_ROWS):
                    rows = slice(i, min(i + TASK_ROWS, b))
                    x, y, t = (None if m is None else m[rows] for m in matrices)
                    yield bool(flags[a]), x, y, t
            continue
        for val in (False, True):
            mine = np.flatnonzero(flags == val)
            for i in range(0, len(mine), TASK_ROWS):
                rows = mine[i : i + TASK_ROWS]
                x, y, t = (None if m is None else m[rows] for m in matrices)
                yield val, x, y, t


def packed_rows(rows: DataFrame, small_labels: bool = False) -> DataFrame:
    """``block_rows`` (with or without ``val``) in rows of several: ``n`` and the matrices ``x``, ``y``
    (and ``t``) as bytes, which an epoch reads without taking rows apart; map only. With ``small_labels`` the
    labels stand in ``b``, one byte each, where all of a row are 0 or 1, and ``y`` is null there."""
    names = [c for c in "xyt" if c in rows.columns]
    flagged = "val" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for val, x, y, t in _parts(batches):
            matrices = [np.ascontiguousarray(m, dtype=np.float64) for m in (x, y, t) if m is not None]
            size = max(1, PACKED_BYTES // (8 * sum(m.shape[1] for m in matrices)))
            cuts = range(0, len(x), size)
            columns = [pa.array([len(x[i : i + size]) for i in cuts], pa.int32())]
            columns += [pa.array([m[i : i + size].tobytes() for i in cuts], pa.binary()) for m in matrices]
            if small_labels:
                labels = matrices[1]
                hard = bool(((labels == 0) | (labels == 1)).all())
                columns[2] = pa.nulls(len(cuts), pa.binary()) if hard else columns[2]
                columns.append(pa.array([labels[i : i + size].astype(np.uint8).tobytes() for i in cuts] if hard else [None] * len(cuts), pa.binary()))
            columns += [pa.array([val] * len(cuts), pa.bool_())] if flagged else []
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    fields = ["n", *names, *(["b"] if small_labels else []), *(["val"] if flagged else [])]
    schema = ", ".join([f"{c} {'int' if c == 'n' else 'boolean' if c == 'val' else 'binary'}" for c in fields])
    return rows.mapInArrow(run, schema)


def _counts(z: np.ndarray, y: np.ndarray, gate: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums (tp, fp, fn per label at logit 0, gate values, gate moments) and maxima (gate, -gate) of a block."""
    hit = z >= 0
    sums = [np.concatenate([(hit * y).sum(0), (hit * (1 - y)).sum(0), (~hit * y).sum(0)])]
    if gate is None:
        return np.concatenate([*sums, np.zeros(5)]), np.full(2, -np.inf)
    sums.append(np.array([gate.size, gate.sum(), (gate * gate).sum(), (gate < GATE_NEAR_ZERO_BATCH).sum(), (gate > GATE_NEAR_ONE_BATCH).sum()], float))
    return np.concatenate(sums), np.array([gate.max(initial=-np.inf), (-gate).max(initial=-np.inf)])


def _partial_rows(option: int, part: int, sums: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
    blocks = [sums[i : i + BLOCK].tolist() for i in range(0, len(sums), BLOCK)]
    n = len(blocks)
    return pa.RecordBatch.from_arrays([
        pa.array([option] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()),
        pa.array(blocks, pa.list_(pa.float64())), pa.array([most.tolist()] * n, pa.list_(pa.float64())),
    ], names=[x.split()[0] for x in _PARTIAL.split(", ")])


def _merge(table: pa.Table) -> pa.Table:
    """Partial sums of one group, added in the order of their partitions (the same after a retry)."""
    table = table.sort_by("part")
    sums = np.sum(np.array(table.column("sums").to_pylist()), axis=0)
    most = np.max(np.array(table.column("most").to_pylist()), axis=0)
    first = {c: table.column(c).slice(0, 1) for c in ("option", "block", "part")}
    return pa.table(first | {"sums": pa.array([sums.tolist()], pa.list_(pa.float64())), "most": pa.array([most.tolist()], pa.list_(pa.float64()))})


def _gathered(partials: DataFrame, partitions: int = _MERGE + 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums and maxima of each option. Partitions' partials, in blocks of bounded length, are merged
    in groups by Spark (unless there are so few ``partitions`` that they are no more than the groups);
    the driver adds the last few and holds as many numbers as the parameters."""
    merged = partials
    if partitions > _MERGE:
        group = F.pmod("part", F.lit(_MERGE))
        merged = partials.groupBy("option", "block", group.alias("group")).applyInArrow(lambda t: _merge(t), _PARTIAL)
    rows = sorted(merged.collect(), key=lambda r: (r["option"], r["block"], r["part"]))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for option in sorted({r["option"] for r in rows}):
        mine = [r for r in rows if r["option"] == option]
        blocks = {b: np.sum([r["sums"] for r in mine if r["block"] == b], axis=0) for b in sorted({r["block"] for r in mine})}
        out[option] = np.concatenate(list(blocks.values())), np.max([r["most"] for r in mine], axis=0)
    return out


def gradient_partials(rows: DataFrame, head: heads.Head, thetas: dict[int, np.ndarray], losses_of: dict[int, heads.BlockLoss]) -> DataFrame:
    """One pass over ``block_rows`` or ``packed_rows`` for ALL options: per option and partition the sums of the gradient
    (a product of matrices per Arrow batch), the loss, the row count and the batch counts. Rows whose
    column ``val`` (if there is one) is true give no gradient; their sums stand under -1 - option."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        most: dict[int, np.ndarray] = {}
        together = heads.LinearOptions(head, thetas, losses_of) if isinstance(head, heads.Linear) else None
        for val, x, y, t in _parts(batches):
            if together and together.takes(y):  # all options at once
                added = np.concatenate([together.sums(x, y, not val), np.zeros((len(thetas), 5))], axis=1)  # no gate
                new = {option: (add, np.full(2, -np.inf)) for option, add in zip(thetas, added, strict=True)}
            else:
                new, y = {}, y.astype(np.float64)
                for option, theta in thetas.items():
                    w = head.parts(theta)
                    z, gate, kept = head.forward(w, x, t)
                    el, dz = losses_of[option](z, y)
                    counts, peak = _counts(z, y, gate)
                    grad = [] if val else head.join(head.backward(w, kept, dz))
                    new[option] = np.concatenate([grad, [el.sum(), len(y)], counts]), peak
            for option, (add, peak) in new.items():
                key = -1 - option if val else option
                sums[key] = sums[key] + add if key in sums else add
                most[key] = np.maximum(most[key], peak) if key in most else peak
        part = TaskContext.get().partitionId()
        for option in sums:
            yield _partial_rows(option, part, sums[option], most[option])

    return rows.mapInArrow(run, _PARTIAL)


def local_round(
    rows: DataFrame, head: heads.Head, states: dict[int, _State], losses_of: dict[int, heads.BlockLoss], options: dict[int, Option], lr: dict[int, float]
) -> DataFrame:
    """One epoch of mini-batches for all options: every partition takes its batches (runs of equal
    ``batch``, in the order of the rows) from the given states, one AdamW step each, and returns its
    parameters and moments times its rows, beside loss and counts. Nothing random happens inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {o: _State.of(s.vector().copy()) for o, s in states.items()}
        n, sums, most = 0, {}, {}
        for x, y, t in _whole_batches(batches):
            n += len(y)
            for option, state in mine.items():
                w = head.parts(state.theta)
                z, gate, kept = head.forward(w, x, t)
                el, dz = losses_of[option](z, y)
                counts, peak = _counts(z, y, gate)
                add = np.concatenate([[el.sum()], counts])
                sums[option] = sums[option] + add if option in sums else add
                most[option] = np.maximum(most[option], peak) if option in most else peak
                state.step(head.join(head.backward(w, kept, dz)) / len(y), lr[option], options[option])
        part = TaskContext.get().partitionId()
        for option in sums:
            yield _partial_rows(option, part, np.concatenate([mine[option].vector() * n, sums[option][:1], [n], sums[option][1:]]), most[option])

    return rows.mapInArrow(run, _PARTIAL)


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Training batches (x, y, t) out of Arrow batches: rows with the same ``batch`` that follow each other."""
    held: list[tuple] = []
    number = None

    def joined():
        return tuple(None if p[0] is None else np.concatenate(p) for p in zip(*held, strict=True))

    for record in batches:
        if not record.num_rows:
            continue
        x, y, t = (_matrix(record, c) for c in "xyt")
        ids = record.column("batch").to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and ids[s] != number:
                yield joined()
                held = []
            number = ids[s]
            held.append((x[s:e], y[s:e], None if t is None else t[s:e]))
    if held:
        yield joined()


def score_options(rows: DataFrame, head: heads.Head, thetas: dict[int, np.ndarray], keep: Sequence[str] = (), packed: bool = False) -> DataFrame:
    """Long scores (keep..., option, label, y, logit, prob) of all options over ``block_rows`` (map only). ``packed``
    (nothing kept) gives the same scores in rows of many: (option, label, y, logit, prob) with an Arrow batch's values of an option
    and label as bytes (y one byte each)."""
    kept = [f for f in rows.schema.fields if f.name in keep]
    if packed and kept:
        raise ValueError("packed scores keep no columns")
    y_type, value = ("binary", "binary") if packed else ("int", "double")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"option int, label int, y {y_type}, logit {value}, prob {value}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            x, y, t = (_matrix(record, c) for c in "xyt") if record.num_rows else (None,) * 3
            for option, theta in thetas.items() if record.num_rows else ():
                z = head.forward(head.parts(theta), x, t)[0]
                n, labels = z.shape
                if packed:
                    across = [np.ascontiguousarray(c.T) for c in (y.astype(np.int8), z, heads.sigmoid(z))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(labels, option, np.int32)), pa.array(np.arange(labels, dtype=np.int32)),
                        *(pa.array([v.tobytes() for v in c], pa.binary()) for c in across),
                    ], names=["option", "label", "y", "logit", "prob"])
                    continue
                row = pa.array(np.repeat(np.arange(n), labels))
                yield pa.RecordBatch.from_arrays([
                    *(record.column(f.name).take(row) for f in kept), pa.array(np.full(n * labels, option, np.int32)),
                    pa.array(np.tile(np.arange(labels, dtype=np.int32), n)), pa.array(y.ravel().astype(np.int32)),
                    pa.array(z.ravel()), pa.array(heads.sigmoid(z).ravel()),
                ], names=[*(f.name for f in kept), "option", "label", "y", "logit", "prob"])

    return rows.mapInArrow(run, schema)


def _rates(counts: np.ndarray, most: np.ndarray, labels: int, prefix: str) -> dict[str, float]:
    """Macro recall and F1, and gate statistics, from the counts of ``_counts``."""
    tp, fp, fn = counts[: 3 * labels].reshape(3, labels)
    out = {
        f"{prefix}/acc": float(np.mean(np.divide(tp, tp + fn, out=np.zeros(labels), where=tp + fn > 0))),
        f"{prefix}/f1_micro": float(2 * tp.sum() / max(2 * tp.sum() + fp.sum() + fn.sum(), 1.0)),
        f"{prefix}/f1_macro": float(np.mean(np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros(labels), where=2 * tp + fp + fn > 0))),
    }
    n, total, squares, low, high = counts[3 * labels :]
    if n:
        mean = total / n
        gate = {"mean": mean, "std": math.sqrt(max(squares / n - mean * mean, 0.0)), "min": -most[1], "max": most[0], "near_zero": low / n, "near_one": high / n}
        out |= {f"{prefix}/gate/{k}": float(v) for k, v in gate.items()}
    return out


def _held_out(rows: DataFrame, head: heads.Head, thetas: dict[int, np.ndarray], losses_of: dict[int, heads.BlockLoss], partitions: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Loss and counts of all options over validation rows alone."""
    got = _gathered(gradient_partials(rows.withColumn("val", F.lit(True)), head, thetas, losses_of), partitions)
    return {-1 - o: v for o, v in got.items()}


#: Scores of a piece, about; rows ranked at a time; packed rows that tell where to cut the scores.
PIECE_SCORES, RANKED_ROWS, CUT_ROWS = 1 << 18, 1 << 17, 64
_PIECES = "option int, label int, piece int, keys binary, counts binary"


@dataclass
class Validation:
    """Packed validation rows, and what cuts their scores into pieces: how many, and some rows (x, t) to
    take quantiles from. The cuts balance the pieces; the AUC is exact wherever they fall."""

    rows: DataFrame
    pieces: int
    some: tuple[np.ndarray, np.ndarray | None] | None

    @classmethod
    def of(cls, rows: DataFrame) -> Validation:
        n = rows.agg(F.sum("n")).first()[0] or 0
        pieces = max(1, -(-int(n) // PIECE_SCORES))
        if pieces == 1:
            return cls(rows, 1, None)
        table = rows.limit(CUT_ROWS).toArrow().combine_chunks()  # rows are dealt evenly: any few will do
        record = table.to_batches()[0]
        return cls(rows, pieces, (_matrix(record, "x"), _matrix(record, "t")))

    def cuts(self, head: heads.Head, thetas: dict[int, np.ndarray], labels: int) -> dict[int, list[np.ndarray]]:
        """Per option and label the scores between pieces."""
        if self.some is None:
            return {o: [np.zeros(0)] * labels for o in thetas}
        at = np.arange(1, self.pieces) / self.pieces
        out = {}
        for option, theta in thetas.items():
            p = heads.sigmoid(head.forward(head.parts(theta), *self.some)[0])
            q = np.quantile(p, at, axis=0, method="nearest")
            out[option] = [np.unique(c[~np.isnan(c)]) for c in q.T]
        return out


def ranked_pieces(rows: DataFrame, head: heads.Head, thetas: dict[int, np.ndarray], cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """(option, label, piece) with the scores and labels of some rows, as the sorted keys of ``ranking.score_keys``;
    piece k lies between cut k - 1 (included) and cut k, so equal scores share a piece. Map only."""

    def scores(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[tuple[int, np.ndarray]]:
        """(option, scores), labels by rows."""
        if isinstance(head, heads.Linear):
            yield from heads.linear_scores(head, thetas, [x for x, _ in parts])
            return
        for option, theta in thetas.items():
            w = head.parts(theta)
            yield option, np.concatenate([heads.sigmoid(head.forward(w, x, t)[0]) for x, t in parts]).T

    def ranked(parts: list[tuple[np.ndarray, np.ndarray | None]], y: np.ndarray) -> pa.RecordBatch:
        found, y = [], np.ascontiguousarray(y.T)
        for option, p in scores(parts):
            for label in range(len(p)):
                keys = ranking.score_keys(p[label], y[label])
                keys.sort()
                found += [(option, label, *piece) for piece in ranking.cut_pieces(keys, cuts[option][label])]
        types = [pa.int32()] * 3 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ys, held = [], [], 0
        for _, x, y, t in _parts(batches):
            parts.append((x, t))
            ys.append(y.astype(np.uint64))
            held += len(y)
            if held >= RANKED_ROWS:
                yield ranked(parts, np.concatenate(ys))
                parts, ys, held = [], [], 0
        if held:
            yield ranked(parts, np.concatenate(ys))

    return rows.mapInArrow(run, _PIECES)


def _rank_piece(table: pa.Table) -> pa.Table:
    """A piece's positives and negatives, and twice its pairs in order (a tie is half a pair)."""
    pos, neg, pairs = ranking.pairs_in_order(*ranking.merged(table.column("keys").to_pylist(), table.column("counts").to_pylist()))
    first = {c: table.column(c).slice(0, 1) for c in ("option", "label", "piece")}
    return pa.table(first | {"pos": pa.array([pos]), "neg": pa.array([neg]), "pairs": pa.array([pairs])})


def _validate(val: Validation, head: heads.Head, thetas: dict[int, np.ndarray], labels: int) -> dict[int, dict[str, float]]:
    """Exact validation macro-AUC of all options in one job (0 when a label is single-class): the scores are
    ranked piece by piece, and a row per piece tells the driver what it adds."""
    pieces = ranked_pieces(val.rows, head, thetas, val.cuts(head, thetas, labels))
    ranked = pieces.groupBy("option", "label", "piece").applyInArrow(lambda t: _rank_piece(t), "option int, label int, piece int, pos long, neg long, pairs long")
    got: dict[tuple[int, int], list] = {}
    for r in ranked.collect():
        got.setdefault((r["option"], r["label"]), []).append((r["piece"], r["pos"], r["neg"], r["pairs"]))
    out = {}
    for option in thetas:
        auc = []
        for label in range(labels):
            higher = pairs = negatives = 0
            for _, pos, neg, inside in sorted(got.get((option, label), []), reverse=True):
                pairs += inside + 2 * neg * higher
                higher, negatives = higher + pos, negatives + neg
            if higher and negatives:
                auc.append(pairs / (2 * higher * negatives))
        out[option] = {"val_auc_macro": sum(auc) / labels if len(auc) == labels else 0.0}
    return out


def _loss_weights(train: DataFrame, label_cols: list[str], beta: float) -> tuple[np.ndarray, np.ndarray]:
    """pos_weight (labels) and class-balanced weights (labels x 2) of the train split."""
    pw = {r["label"]: r["pos_weight"] for r in pos_weight(train, label_cols).collect()}
    cb = {r["label"]: (r["w_pos"], r["w_neg"]) for r in effective_number_weights(train, label_cols, beta).collect()}
    return np.array([pw[l] for l in range(len(label_cols))]), np.array([cb[l] for l in range(len(label_cols))])


def fit_many(
    train: DataFrame,
    val: DataFrame,
    features: list[str],
    label_cols: list[str],
    options: Sequence[Option],
    head: heads.Head | None = None,
    text_col: str | None = None,
    batch_col: str | None = None,
    epochs: int = 50,
    patience: int = PATIENCE,
    beta: float = CB_BETA,
) -> list[Fitted]:
    """TRN1 + TRN2 for many options at once: each epoch is one gradient pass over train and one
    validation pass for ALL options that still run; parameters travel as data. An option keeps the
    parameters of its best validation macro-AUC epoch and leaves after ``patience`` epochs
    without strict improvement. Results don't depend on which options run together.

    Full-batch AdamW steps by default. With ``batch_col`` (``prep.assign_batches``) an epoch is a round
    of mini-batch steps: partitions take their batches one after the other from the common state, and
    their parameters and moments are averaged by rows. Train and val are read and written once to the shared
    folder, packed (mini-batches: as rows in their order)."""
    head = head or heads.Linear(len(features), len(label_cols))
    text = text_col if head.reads_text else None
    labels = len(label_cols)
    alpha, cb = _loss_weights(train, label_cols, beta)
    tr = block_rows(train, features, label_cols, text, batch_col)
    val_rows = block_rows(val, features, label_cols, text)
    va = write_shared_table(packed_rows(spread(val_rows), small_labels=True), "fit-val")
    ranking = Validation.of(va)
    if batch_col:
        tr = write_shared_table(tr.repartitionByRange("batch").sortWithinPartitions("batch", "x", "y"), "fit-train")
    else:
        both = tr.withColumn("val", F.lit(False)).unionByName(val_rows.withColumn("val", F.lit(True)))
        packed = packed_rows(both, small_labels=True)  # packed first: a hundredth of the rows to deal
        tr = write_shared_table(spread(packed).sortWithinPartitions("val"), "fit-rows")
    partitions = {id(df): df.rdd.getNumPartitions() for df in (tr, va)}  # from the plan; nothing runs
    fitted = [Fitted(head, o, head.start(o.seed)) for o in options]
    states = {i: _State(f.theta, np.zeros(head.size()), np.zeros(head.size())) for i, f in enumerate(fitted)}
    losses_of = {i: o.block_loss(alpha, cb) for i, o in enumerate(options)}
    best, since = dict.fromkeys(states, 0.0), dict.fromkeys(states, 0)

    def thetas() -> dict[int, np.ndarray]:
        return {i: s.theta for i, s in states.items()}

    def gradients(rows: DataFrame, now: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return _gathered(gradient_partials(rows, head, now, losses_of), partitions[id(rows)])

    def round_of_batches(epoch: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        lr = {i: lr_at(epoch, options[i].lr) for i in states}
        return _gathered(local_round(tr, head, states, losses_of, dict(enumerate(options)), lr), partitions[id(tr)])

    # an epoch's validation and the next epoch's gradient use the same parameters: one pass over all
    # rows, beside the job that ranks the validation scores
    with ThreadPoolExecutor(max_workers=2) as pool:
        sums = round_of_batches(0) if batch_col else gradients(tr, thetas())
        for epoch in range(epochs):
            logged = {}
            for i, state in states.items():
                total, most = sums[i]
                at = 3 * head.size() + 1 if batch_col else head.size()
                loss_sum, n, counts = total[at], total[at + 1], total[at + 2 :]
                lr = lr_at(epoch, options[i].lr)
                row = {"epoch": epoch + 1, "train_loss": loss_sum / (n * labels), "lr": lr}
                if batch_col:
                    states[i] = _State.of(total[:at] / n)
                else:
                    row["grad_norm"] = state.step(total[:at] / n, lr, options[i])
                logged[i] = row | _rates(counts, most, labels, "train")
            now = thetas()
            ranked = pool.submit(_validate, ranking, head, now, labels)
            if batch_col:
                checked = pool.submit(_held_out, va, head, now, losses_of, partitions[id(va)])
                sums = round_of_batches(epoch + 1) if epoch + 1 < epochs else {}
                held_out = checked.result()
            else:
                sums = gradients(tr, now)
                held_out = {-1 - o: v for o, v in sums.items() if o < 0}
            for i, (total, most) in held_out.items():
                logged[i] |= {"val_loss": total[0] / (total[1] * labels)} | _rates(total[2:], most, labels, "eval")
            for i, got in ranked.result().items():
                row = logged[i] | got
                fitted[i].history.append(row)
                if row["val_auc_macro"] > best[i]:
                    best[i], since[i] = row["val_auc_macro"], 0
                    fitted[i].theta, fitted[i].best_epoch = now[i], epoch + 1
                else:
                    since[i] += 1
                    if since[i] >= patience:
                        del states[i]
            if not states:
                break
    return fitted


def save_fitted(spark: SparkSession, fitted: Sequence[Fitted], path: str) -> None:
    """Store the best parameters of several fits as (option, position, value) rows."""
    rows = [(i, k, float(v)) for i, f in enumerate(fitted) for k, v in enumerate(f.theta)]
    spark.createDataFrame(rows, "option int, position int, value double").coalesce(1).write.parquet(path)


def load_thetas(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    """Parameters of ``save_fitted`` by option."""
    out: dict[int, list[tuple[int, float]]] = {}
    for r in spark.read.parquet(path).collect():  # options x parameters rows
        out.setdefault(r["option"], []).append((r["position"], r["value"]))
    return {i: np.array([v for _, v in sorted(rows)]) for i, rows in out.items()}


def fit(
    train: DataFrame, val: DataFrame, features: list[str], label_cols: list[str], key_cols: list[str] | None = None,
    epochs: int = 50, patience: int = PATIENCE, beta: float = CB_BETA, **settings,
) -> LinearModel:
    """``fit_many`` of one linear head; ``settings`` are those of ``Option``."""
    one = fit_many(train, val, features, label_cols, [Option(**settings)], epochs=epochs, patience=patience, beta=beta)[0]
    return linear_model(one, features)


def linear_model(fitted: Fitted, features: list[str]) -> LinearModel:
    w = fitted.head.parts(fitted.theta)
    return LinearModel(features, w["W"], w["b"], fitted.history, fitted.best_epoch)




def history_rows(history: list[dict], run: int = 0, seed: int = 0) -> list[tuple]:
    return [(run, seed, h["epoch"], k, float(v)) for h in history for k, v in h.items() if k != "epoch"]


def history_table(spark: SparkSession, model: LinearModel | Fitted, run: int = 0, seed: int = 0) -> DataFrame:
    """Metric log ``(run, seed, epoch, metric, value)`` of a fit (SRC5 shape)."""
    return spark.createDataFrame(history_rows(model.history, run, seed), LOG_SCHEMA)
