"""Ranks of scores as sorted whole numbers, for exact counts of pairs in order.

A key holds a score of 0 or more (its bits are ordered like the numbers) and, as its lowest bit, whether the row is
positive: sorted keys are sorted scores, and of equal scores the negatives come first. ``Ranked`` is a scored table
in pieces of such keys, from which AUCs, counts at thresholds and ROC points are read exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.config import SCORE_BUCKETS
from strata.sources.tables import write_shared_table


def score_keys(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One key per row; scores are doubles from 0 on, labels 0 or 1."""
    keys = np.array(scores, dtype=np.float64).view(np.uint64)
    keys <<= np.uint64(1)
    keys |= y.astype(np.uint64, copy=False)
    return keys


def key_of(score: float) -> np.uint64:
    """The least key of a score."""
    return np.float64(0.0 if score <= 0 else score).view(np.uint64) << np.uint64(1)


def key_scores(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(1)).view(np.float64)


def cut_pieces(keys: np.ndarray, cuts: np.ndarray) -> list[tuple[int, bytes, bytes | None]]:
    """(piece, keys, counts) of sorted keys between cuts of the score; where most keys repeat, each one once and how
    often, else all of them and no counts."""
    at = np.searchsorted(keys, np.array([key_of(c) for c in cuts], dtype=np.uint64))
    edge = [0, *at.tolist(), len(keys)]
    out = []
    for piece, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if a == b:
            continue
        mine = keys[a:b]
        new = np.flatnonzero(mine[1:] != mine[:-1])
        if 4 * (len(new) + 1) <= len(mine):
            first = np.concatenate([[0], new + 1])
            out.append((piece, mine[first].tobytes(), np.diff(first, append=len(mine)).astype(np.int64).tobytes()))
        else:
            out.append((piece, mine.tobytes(), None))
    return out


def merged(keys: Sequence[bytes], counts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray | None]:
    """The sorted keys of several pieces' parts, and how often each is there (None: once each time it is listed)."""
    parts = [np.frombuffer(k, np.uint64) for k in keys]
    if all(c is None for c in counts):
        return np.sort(np.concatenate(parts)), None
    n = [np.ones(len(p), np.int64) if c is None else np.frombuffer(c, np.int64) for p, c in zip(parts, counts, strict=True)]
    distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(n))
    return distinct, total


def pairs_in_order(keys: np.ndarray, counts: np.ndarray | None) -> tuple[int, int, int]:
    """Positives, negatives, and twice the pairs of a negative and a positive with the greater score (a tie is half a pair)."""
    is_pos = (keys & np.uint64(1)).astype(bool)
    tie = np.flatnonzero((keys[1:] - keys[:-1] == 1) & is_pos[1:])  # a score's last negative, its first positive after it
    if counts is None:
        at = np.flatnonzero(is_pos)
        pos = len(at)
        neg = len(keys) - pos
        below = int(at.sum()) - pos * (pos - 1) // 2  # negatives before each positive
        ends = np.searchsorted(keys, keys[tie + 1], side="right")
        starts = np.searchsorted(keys, keys[tie], side="left")
        tied = int(((tie + 1 - starts) * (ends - tie - 1)).sum())
    else:
        n_pos, n_neg = np.where(is_pos, counts, 0), np.where(is_pos, 0, counts)
        pos, neg = int(n_pos.sum()), int(n_neg.sum())
        below = int((n_pos * np.cumsum(n_neg)).sum())
        tied = int((n_neg[tie] * n_pos[tie + 1]).sum())
    return pos, neg, 2 * below - tied


def distinct_scores(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores of sorted keys, rising, with their positives and negatives."""
    which = keys >> np.uint64(1)
    first = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)
    is_pos = (keys & np.uint64(1)).astype(np.int64)
    n_pos, n = (is_pos, np.ones_like(is_pos)) if counts is None else (is_pos * counts, counts)
    pos, n = (np.add.reduceat(c, first) if len(keys) else np.zeros(0, np.int64) for c in (n_pos, n))
    return which[first].view(np.float64), pos, n - pos


def counts_from(keys: np.ndarray, counts: np.ndarray | None, thresholds: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Positives and negatives of sorted keys with a score of at least each threshold."""
    at = np.searchsorted(keys, np.array([key_of(t) for t in thresholds], dtype=np.uint64))
    is_pos = (keys & np.uint64(1)).astype(np.int64)
    n_pos, n = (is_pos, np.ones_like(is_pos)) if counts is None else (is_pos * counts, counts)
    pos, n = (np.append(np.cumsum(c[::-1])[::-1], 0)[at] for c in (n_pos, n))
    return pos, n - pos


#: Scores of a piece of a model, about, and rows that a task sorts at a time.
MODEL_PIECE, SORTED_ROWS = 1 << 17, 1 << 20
_PARTS = "model int, label int, piece int, keys binary, counts binary"
_RANKED = "model int, label int, piece int, low double, high double, pos long, neg long, pairs long, top_pos long, top_neg long, keys binary, counts binary"
POOLED = -1


def result_table(rows: Sequence[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], types[t]) for i, (name, t) in enumerate(fields)})


def stored_keys(row: dict) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(row["keys"], np.uint64), None if row["counts"] is None else np.frombuffer(row["counts"], np.int64)


@dataclass
class Ranked:
    """A scored table ``(label, y, prob)`` of several models, label // ``labels`` being the model, sorted in pieces.

    Piece k of a model has the scores of all its labels from the piece's cut to that of the next, so equal scores share
    one. ``rows`` is a stored row a label and piece (sorted keys), and one a piece with the pairs of all labels pooled. ``stats``
    is the same without the keys, a few numbers a piece, by label with the highest piece first. Cuts balance the
    pieces; every count is exact wherever they fall."""

    rows: DataFrame
    labels: int
    stats: dict[tuple[int, int], list[dict]]

    @classmethod
    def of(cls, scored: DataFrame, labels: int) -> Ranked:
        """Of rows ``(label, y, prob)``, or rows of many (``y`` and ``prob`` as bytes: ``train.score_options``)."""
        typed = scored.select(F.col("label").cast("int").alias("label"), "y", "prob")
        if dict(typed.dtypes)["prob"] != "binary":
            typed = typed.select("label", F.col("y").cast("tinyint").alias("y"), F.col("prob").cast("double").alias("prob"))
        n = typed.mapInArrow(lambda batches: _bucket_counts(batches, labels), "model int, b int, n long").groupBy("model", "b").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("model").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # at most SCORE_BUCKETS rows
        piece = F.floor(F.coalesce(before, F.lit(0)) / MODEL_PIECE).alias("piece")
        first: dict[int, list[int]] = {}
        for r in n.select("model", piece, "b").groupBy("model", "piece").agg(F.min("b").alias("b")).collect():  # a row a piece
            first.setdefault(r["model"], []).append(r["b"])
        cuts = {m: _bucket_scores(np.sort(np.array(b))[1:]) for m, b in first.items()}
        pieces = typed.mapInArrow(lambda batches: _sorted_parts(batches, labels, cuts), _PARTS).groupBy("model", "piece")
        rows = write_shared_table(pieces.applyInArrow(lambda t: _merge_piece(t), _RANKED), "ranked")
        stats: dict[tuple[int, int], list[dict]] = {}
        for r in rows.drop("keys", "counts").collect():  # a few numbers a piece
            stats.setdefault((r["model"], r["label"]), []).append(r.asDict())
        return cls(rows, labels, {k: sorted(v, key=lambda r: -r["piece"]) for k, v in sorted(stats.items())})

    def names(self) -> list[int]:
        return [label for _, label in self.stats if label != POOLED]

    def models(self) -> list[int]:
        return sorted({m for m, _ in self.stats})

    def of_label(self, label: int) -> list[dict]:
        return self.stats[label // self.labels, label]

    def totals(self, label: int) -> tuple[int, int]:
        mine = self.of_label(label)
        return sum(r["pos"] for r in mine), sum(r["neg"] for r in mine)

    def auc(self, model: int, label: int = POOLED) -> float | None:
        """Exact AUC of a label, or of a model's labels pooled; None with a single class."""
        higher = negatives = pairs = 0
        for r in self.stats[model, label]:
            pairs += r["pairs"] + 2 * r["neg"] * higher
            higher, negatives = higher + r["pos"], negatives + r["neg"]
        return pairs / (2 * higher * negatives) if higher and negatives else None

    def counts_at(self, thresholds: dict[int, Sequence[float]]) -> dict[int, list[tuple[int, int]]]:
        """Per label the positives and negatives with a score of at least each of its thresholds, in one job: only
        pieces that a threshold falls into are read for it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                found = []
                for row in record.to_pylist():
                    asked = [(i, t) for i, t in enumerate(thresholds.get(row["label"], ())) if row["low"] < t <= row["high"]]
                    if asked:
                        counted = counts_from(*stored_keys(row), [t for _, t in asked])
                        found += [(row["label"], i, row["piece"], int(p), int(n)) for (i, _), p, n in zip(asked, *counted, strict=True)]
                if found:
                    yield from result_table(found, schema).to_batches()

        schema = "label int, i int, piece int, pos long, neg long"
        needed = self.rows.where((F.col("label") != POOLED) & F.col("label").isin(*thresholds)) if thresholds else self.rows.limit(0)
        inside = {(r["label"], r["i"], r["piece"]): (r["pos"], r["neg"]) for r in needed.select("label", "piece", "low", "high", "keys", "counts").mapInArrow(run, schema).collect()}
        out = {}
        for label, asked in thresholds.items():
            out[label] = []
            for i, t in enumerate(asked):
                got = [(r["pos"], r["neg"]) if not r["low"] < t else inside.get((label, i, r["piece"]), (0, 0)) for r in self.of_label(label)]
                out[label].append((sum(p for p, _ in got), sum(n for _, n in got)))
        return out

    def youden(self) -> dict[int, float]:
        """Per label the threshold of the ROC point with the highest ``tpr - fpr``, of equal ones the highest threshold;
        infinity with a single class. The points are those of ``curves.roc_curve``."""
        above: dict[tuple[int, int], tuple] = {}
        for label in self.names():
            mine, (p, n), tp, fp = self.of_label(label), self.totals(label), 0, 0
            for r, lower in zip(mine, [*mine[1:], None], strict=True):
                above[label, r["piece"]] = (p, n, tp, fp, (lower["top_pos"], lower["top_neg"]) if lower else None)
                tp, fp = tp + r["pos"], fp + r["neg"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                found = []
                for row in record.to_pylist():
                    p, n, tp, fp, below = above[row["label"], row["piece"]]
                    if not (p and n):
                        continue
                    scores, pos, neg = (c[::-1] for c in distinct_scores(*stored_keys(row)))
                    after = [np.append(c[1:], b) for c, b in zip((pos, neg), below or (-1, -1), strict=True)]  # -1: the last score
                    keep = (after[0] != pos) | (after[1] != neg)
                    keep[0] |= tp + fp == 0
                    j = ((tp + np.cumsum(pos)) / p - (fp + np.cumsum(neg)) / n)[keep]
                    if len(j):
                        best = int(np.argmax(j))  # the first of equal ones
                        found.append((row["label"], float(j[best]), float(scores[keep][best])))
                if found:
                    yield from result_table(found, schema).to_batches()

        schema = "label int, j double, threshold double"
        best = {label: (0.0, float("inf")) if all(self.totals(label)) else (float("inf"),) * 2 for label in self.names()}
        for r in self.rows.where(F.col("label") != POOLED).select("label", "piece", "keys", "counts").mapInArrow(run, schema).collect():
            best[r["label"]] = max(best[r["label"]], (r["j"], r["threshold"]))
        return {label: t for label, (_, t) in best.items()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(y, prob) by label of about ``SORTED_ROWS`` rows at a time."""

    def by_label(label: np.ndarray, y: np.ndarray, prob: np.ndarray) -> Iterator[tuple[int, tuple]]:
        small = label.astype(np.uint16) if label.min() >= 0 and label.max() < 1 << 16 else label  # sorted in linear time
        order = np.argsort(small, kind="stable")
        label, y, prob = label[order], y[order], prob[order]
        edge = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield int(label[a]), (y[a:b], prob[a:b])

    held: dict[int, list[tuple]] = {}
    n = 0
    for record in batches:
        if not record.num_rows:
            continue
        label, y, prob = (record.column(c) for c in ("label", "y", "prob"))
        if pa.types.is_binary(prob.type):
            found = [(k, (np.frombuffer(a.as_buffer(), np.int8), np.frombuffer(p.as_buffer(), np.float64))) for k, a, p in zip(label.to_pylist(), y, prob, strict=True)]
        else:
            found = list(by_label(*(c.to_numpy(zero_copy_only=False) for c in (label, y, prob))))
        for k, pair in found:
            if (pair[1] < 0).any():
                raise ValueError("scores below 0 cannot be ranked")
            held.setdefault(k, []).append(pair)
            n += len(pair[1])
            if n >= SORTED_ROWS:
                yield {k: tuple(np.concatenate(c) for c in zip(*v, strict=True)) for k, v in held.items()}
                held, n = {}, 0
    if n:
        yield {k: tuple(np.concatenate(c) for c in zip(*v, strict=True)) for k, v in held.items()}


def _score_buckets(prob: np.ndarray) -> np.ndarray:
    """Rising buckets of scores, equally wide in the logit between -40 and 40 (those of ``score_bucket``, about)."""
    p = np.clip(prob, 1e-300, 1.0 - 1e-16)
    z = np.clip(np.log(p) - np.log1p(-p), -40.0, 40.0)
    return np.minimum(np.nan_to_num((z + 40.0) * (SCORE_BUCKETS / 80.0), nan=SCORE_BUCKETS), SCORE_BUCKETS - 1).astype(np.int32)


def _bucket_scores(buckets: np.ndarray) -> np.ndarray:
    """The scores that buckets start from."""
    return 1.0 / (1.0 + np.exp(40.0 - buckets * (80.0 / SCORE_BUCKETS)))


def _bucket_counts(batches: Iterator[pa.RecordBatch], labels: int) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        by_model: dict[int, list[np.ndarray]] = {}
        for label, (_, prob) in run.items():
            by_model.setdefault(label // labels, []).append(_score_buckets(prob))
        for model, found in by_model.items():
            n = np.bincount(np.concatenate(found))
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), model, np.int32)), pa.array(b.astype(np.int32)), pa.array(n[b].astype(np.int64))], names=["model", "b", "n"])


def _sorted_parts(batches: Iterator[pa.RecordBatch], labels: int, cuts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Parts of the pieces out of scored rows."""
    for run in _runs(batches):
        for label, (y, prob) in run.items():
            keys = score_keys(prob, y)
            keys.sort()
            yield from result_table([(label // labels, label, *p) for p in cut_pieces(keys, cuts[label // labels])], _PARTS).to_batches()


def _merge_piece(table: pa.Table) -> pa.Table:
    """The whole of a model's piece: a row per label, and one for all of them pooled."""
    model, piece, found, pooled = table.column("model")[0].as_py(), table.column("piece")[0].as_py(), [], []
    names = table.column("label").to_numpy()
    for label in np.unique(names).tolist():
        mine = table.filter(pa.array(names == label))
        keys, counts = merged(mine.column("keys").to_pylist(), mine.column("counts").to_pylist())
        top = counts_from(keys, counts, [key_scores(keys[-1:])[0]])
        edges = key_scores(keys[[0, -1]]).tolist()
        packed = keys.tobytes(), None if counts is None else counts.tobytes()
        found.append((model, label, piece, *edges, *pairs_in_order(keys, counts), int(top[0][0]), int(top[1][0]), *packed))
        pooled.append(packed)
    both = merged(*zip(*pooled, strict=True))
    edges = key_scores(both[0][[0, -1]]).tolist()
    return result_table([*found, (model, POOLED, piece, *edges, *pairs_in_order(*both), 0, 0, None, None)], _RANKED)
