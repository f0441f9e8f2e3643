"""Decision-threshold search and evaluation over a scored table ``(label, y, prob)``."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import COARSE_CANDIDATES, GRID_CANDIDATES, SIMPLEX_BOUNDS, SIMPLEX_FATOL, SIMPLEX_XATOL
from strata.functions.columns import div0
from strata.operators import curves, metrics
from strata.operators.ranking import POOLED, Ranked, distinct_scores, key_of, stored_keys, result_table
from strata.sources.tables import write_shared_table

# ----------------------------------------------------------------- grid search (THR1-3)


def tune_grid(scored: DataFrame | Ranked, candidates: Sequence[float] | None = None, metric: str = "f1") -> DataFrame:
    """THR1/THR2: per label the candidate with the highest F1 (``prob >= t``).

    One pass: each row gets ``bucket = #candidates <= prob``; a grouped aggregate
    gives ``(label, bucket)`` counts (at most labels x (K+1) rows); the counts at
    every candidate are suffix sums over buckets. Selection follows the strict
    ``>`` scan from ``(0.5, 0.0)`` in the given candidate order: the best F1
    wins, ties go to the earlier candidate and a label whose F1 is 0 everywhere
    gets 0.5. Returns ``(label, threshold, f1)``."""
    if metric != "f1":
        raise ValueError(f"grid search knows no metric {metric!r}, only 'f1'")
    cands = [float(c) for c in (GRID_CANDIDATES if candidates is None else candidates)]
    if isinstance(scored, Ranked):
        return _grid_of_ranked(scored, cands)
    order = sorted(range(len(cands)), key=lambda i: cands[i])
    sorted_c = [cands[i] for i in order]
    bucket = sum((F.col("prob") >= F.lit(c)).cast("int") for c in sorted_c)
    if {"pos", "neg"} <= set(scored.columns):  # already aggregated per distinct score
        pos, neg = F.col("pos"), F.col("neg")
    else:
        pos, neg = F.col("y").cast("long"), 1 - F.col("y").cast("long")
    counts = scored.groupBy("label", bucket.alias("bucket")).agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
    # (label, k) grid of candidates: k-th smallest candidate, its position in the given order
    grid_rows = F.array(
        *[
            F.struct(F.lit(k + 1).alias("k"), F.lit(sorted_c[k]).alias("threshold"), F.lit(order[k]).alias("given_pos"))
            for k in range(len(sorted_c))
        ]
    )
    labels = counts.groupBy("label").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = labels.select("label", "P", "N", F.inline(grid_rows))
    # bounded tables (labels x K rows each): suffix sums by a range-conditioned broadcast join
    c = F.broadcast(counts).alias("c")
    g = grid.alias("g")
    swept = (
        g.join(c, (F.col("g.label") == F.col("c.label")) & (F.col("c.bucket") >= F.col("g.k")), "left")
        .groupBy("g.label", "g.k", "g.threshold", "g.given_pos", "g.P", "g.N")
        .agg(F.coalesce(F.sum("c.pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("c.neg"), F.lit(0)).alias("fp"))
    )
    f1 = div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + (F.col("P") - F.col("tp")))
    scored_grid = swept.select("label", "threshold", "given_pos", f1.alias("f1"))
    w = Window.partitionBy("label").orderBy(F.col("f1").desc(), F.col("given_pos").asc())
    best = scored_grid.where(F.col("f1") > 0).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return labels.select("label").join(best, "label", "left").select(
        "label", F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.coalesce("f1", F.lit(0.0)).alias("f1")
    )


def _grid_of_ranked(ranked: Ranked, cands: list[float]) -> DataFrame:
    """``tune_grid`` of a ``Ranked`` table: its counts at all candidates, and the same scan."""
    rows = []
    for label, counted in ranked.counts_at({label: cands for label in ranked.names()}).items():
        positives, best = ranked.totals(label)[0], (0.5, 0.0)
        for t, (tp, fp) in zip(cands, counted, strict=True):
            f1 = 2.0 * tp / (2 * tp + fp + positives - tp) if tp else 0.0
            best = (t, f1) if f1 > best[1] else best
        rows.append((label, *best))
    return ranked.rows.sparkSession.createDataFrame(rows, "label int, threshold double, f1 double")


def tune_coarse(scored: DataFrame | Ranked) -> DataFrame:
    """THR3: the coarse 8-candidate grid used as the simplex start."""
    return tune_grid(scored, COARSE_CANDIDATES)


# ----------------------------------------------------------------- ROC choice (THR5)


def tune_roc(scored: DataFrame | Ranked, criterion: str = "youden") -> DataFrame:
    """THR5: per label the ROC point maximising Youden's J (``tpr - fpr``) or
    closest to the top-left corner; the first such point in descending-threshold
    order wins (ties -> highest threshold; ``+inf`` means nothing predicted)."""
    if isinstance(scored, Ranked):
        if criterion != "youden":
            raise ValueError(f"no such ROC criterion of a ranked table: {criterion!r}")
        return scored.rows.sparkSession.createDataFrame(list(scored.youden().items()), "label int, threshold double")
    roc = curves.roc_curve(scored)
    if criterion == "youden":
        key_value = F.col("tpr") - F.col("fpr")  # larger is better; NULL sorts lowest (last)
    elif criterion == "closest_topleft":
        d = F.sqrt((F.lit(1.0) - F.col("tpr")) * (F.lit(1.0) - F.col("tpr")) + F.col("fpr") * F.col("fpr"))
        key_value = -d  # smaller distance is better; NULL sorts lowest (last)
    else:
        raise ValueError(f"no such ROC criterion: {criterion!r}")
    # first in (key, threshold desc) order = max of (key, threshold) with the key's
    # order turned ascending-is-better; one partial hash aggregate per label, so a
    # label with most of the ROC points is not sorted in one task
    best = F.max(F.struct(key_value.alias("k"), F.col("threshold").alias("t")))
    return roc.groupBy("label").agg(best.getField("t").alias("threshold"))


# ----------------------------------------------------------------- evaluation (THR6-7)


def evaluate_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """THR6: ``(f1_micro, f1_macro, precision_macro, recall_macro, auc_macro)``."""
    counts = curves.score_counts(scored)
    summ = metrics.summary_from_confusion(metrics.confusion_from_counts(counts, thresholds))
    auc = curves.auc_from_counts(counts, ["label"]).agg(F.avg("auc").alias("auc_macro"))
    return summ.crossJoin(F.broadcast(auc)).select("f1_micro", "f1_macro", "precision_macro", "recall_macro", "auc_macro")  # one row each


def compare_methods(
    val: DataFrame | Ranked,
    test: DataFrame | Ranked,
    methods: Sequence[str] = ("grid_search", "bayesian", "roc_youden"),
    simplex_iterations: int = 30,
    labels_per_model: int | None = None,
) -> DataFrame:
    """THR7: tune on ``val`` with each method, evaluate on ``test``:
    ``(method, f1_micro, f1_macro, precision_macro, recall_macro, auc_macro)``.

    With ``labels_per_model`` the labels belong to several models (``model`` =
    label // labels_per_model, the first column of the result), all tuned and evaluated in the same jobs. Tables of
    many scores are best given as ``Ranked`` ones."""
    tuned = []
    for m in methods:
        if m == "grid_search":
            t = tune_grid(val)
        elif m == "bayesian":
            t = tune_simplex(val, "f1_macro", simplex_iterations, labels_per_model)
        elif m == "roc_youden":
            t = tune_roc(val, "youden")
        else:
            raise ValueError(f"Unknown method: {m}")
        tuned.append(t.select(F.lit(m).alias("method"), "label", F.col("threshold").cast("double")))
    all_t = tuned[0]
    for t in tuned[1:]:
        all_t = all_t.unionByName(t)
    if isinstance(test, Ranked):
        at: dict[str, dict[int, float]] = {m: dict.fromkeys(test.names(), 0.5) for m in methods}
        for r in all_t.collect():  # labels x methods rows
            if r["label"] in at[r["method"]]:
                at[r["method"]][r["label"]] = r["threshold"]
        conf, aucs = metrics.confusion_of_ranked(test, at), metrics.auc_of_ranked(test)
    else:
        counts = curves.score_counts(test)  # one pass over the test rows for all methods and the AUC
        conf = metrics.confusion_from_counts(counts, all_t, group_cols=("method",))
        aucs = curves.auc_from_counts(counts, ["label"])
    out = ["method", "f1_micro", "f1_macro", "precision_macro", "recall_macro", "auc_macro"]
    if labels_per_model is None:
        auc = aucs.agg(F.avg("auc").alias("auc_macro"))
        return metrics.summary_from_confusion(conf, ("method",)).crossJoin(F.broadcast(auc)).select(*out)  # auc: one row
    model = F.floor(F.col("label") / labels_per_model).cast("int")
    auc = aucs.groupBy(model.alias("model")).agg(F.avg("auc").alias("auc_macro"))
    return metrics.summary_from_confusion(conf.withColumn("model", model), ("model", "method")).join(auc, "model").select("model", *out)


# ----------------------------------------------------------------- simplex refinement (THR4)


def _metric_value(metric: str, tp: np.ndarray, fp: np.ndarray, P: np.ndarray, N: np.ndarray) -> float:
    """Objective from per-label counts (zero_division = 0)."""
    fn, tn = P - tp, N - fp

    def d(a, b):
        return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)

    if metric == "f1_macro":
        return float(np.mean(d(2.0 * tp, 2.0 * tp + fp + fn)))
    if metric == "f1_micro":
        den = 2.0 * tp.sum() + fp.sum() + fn.sum()
        return float(2.0 * tp.sum() / den) if den else 0.0
    if metric == "balanced_acc":
        return float(np.mean((d(tp * 1.0, tp + fn) + d(tn * 1.0, tn + fp)) / 2.0))
    raise ValueError(f"Unknown metric: {metric}")


class CountIndex:
    """Exact counts of scores from a threshold on, for a search that asks for many thresholds.

    Level 1 holds the counts of 4,096 equally wide buckets per label. A threshold inside a bucket needs
    that bucket's own scores (or, if they are many, its 4,096 sub-buckets); until ``fetch`` has
    brought them, its count is estimated and the bucket noted in ``missing``. A search is therefore
    run on the estimates, what it touched is fetched in one job, and it is run again, until it touches
    nothing unknown. Bucket numbers are exact: they scale a score by powers of two."""

    BITS, SCORES, DEEPEST = 12, 4096, 4

    def __init__(self, steps: DataFrame | Ranked) -> None:
        self.steps, self.jobs = steps, 0
        self.nodes: dict[tuple[int, int, int], tuple] = {}
        self.missing: dict[tuple[int, int, int], int] = {}
        if isinstance(steps, Ranked):
            self._store(self._of_pieces([(label, 0, 0, False) for label in steps.names()]))
        else:
            self._store(steps.select("label", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(False).alias("whole"),
                                     self._bucket(1).cast("double").alias("key"), "pos", "neg", F.lit(1).alias("n")))
        self.totals = {label: (int(n[2][0]), int(n[3][0])) for (label, _, _), n in self.nodes.items()}

    def _bucket(self, level: int) -> Column:
        return F.floor(F.col("score") * float(1 << (self.BITS * level)))

    def _store(self, rows: DataFrame) -> None:
        """Collect nodes: at most 4,096 keys each (sub-buckets, or scores)."""
        self.jobs += 1
        got = rows.groupBy("label", "level", "node", "whole", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n")).collect()
        grouped: dict[tuple, list] = {}
        for r in got:
            grouped.setdefault((r["label"], r["level"], r["node"], r["whole"]), []).append((r["key"], r["pos"], r["neg"], r["n"]))
        for (label, level, node, whole), rows_ in grouped.items():
            key, pos, neg, n = map(np.array, zip(*sorted(rows_), strict=True))
            upto = [np.append(np.cumsum(c[::-1])[::-1], 0) for c in (pos, neg)]
            self.nodes[(label, level, node)] = (whole, key, *upto, n)

    def from_(self, label: int, t: float) -> tuple[float, float]:
        """(positives, negatives) of ``label`` with a score of ``t`` or more."""
        where, pos, neg = (label, 0, 0), 0.0, 0.0
        while True:
            whole, key, p, n, distinct = self.nodes[where]
            if whole:
                i = int(np.searchsorted(key, t))
                return pos + p[i], neg + n[i]
            level = where[1] + 1
            bucket = math.floor(t * (1 << (self.BITS * level)))
            i = int(np.searchsorted(key, bucket, side="right"))
            pos, neg = pos + p[i], neg + n[i]
            if i == 0 or key[i - 1] != bucket:
                return pos, neg
            where = (label, level, bucket)
            if where not in self.nodes:
                self.missing[where] = int(distinct[i - 1])
                return pos + (p[i - 1] - p[i]) / 2, neg + (n[i - 1] - n[i]) / 2

    def fetch(self) -> None:
        """Bring the missing buckets in one job."""
        asked, self.missing = self.missing, {}
        if isinstance(self.steps, Ranked):
            self._store(self._of_pieces([(lab, lv, b, n <= self.SCORES or lv >= self.DEEPEST) for (lab, lv, b), n in asked.items()]))
            return
        parts = []
        for level in sorted({w[1] for w in asked}):
            rows = [(lab, b, n <= self.SCORES or level >= self.DEEPEST) for (lab, lv, b), n in asked.items() if lv == level]
            wanted = F.broadcast(self.steps.sparkSession.createDataFrame(rows, "label int, node long, whole boolean"))
            found = self.steps.withColumn("node", self._bucket(level)).join(wanted, ["label", "node"])
            key = F.when(F.col("whole"), F.col("score")).otherwise(self._bucket(level + 1).cast("double"))
            parts.append(found.select("label", F.lit(level).alias("level"), "node", "whole", key.alias("key"), "pos", "neg", F.lit(1).alias("n")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        self._store(rows)

    def _of_pieces(self, asked: list[tuple[int, int, int, bool]]) -> DataFrame:
        """The keys of some nodes (label, level, node, whole) from each piece of a ``Ranked`` table."""
        bits, schema = self.BITS, "label int, level int, node long, whole boolean, key double, pos long, neg long, n long"
        by_label: dict[int, list[tuple[int, int, bool]]] = {}
        for label, *node in asked:
            by_label.setdefault(label, []).append(tuple(node))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                for row in record.to_pylist():
                    # from a node's number times a power of two to that of the next; the top level has all scores
                    near = [(lv, b, whole) for lv, b, whole in by_label[row["label"]]
                            if lv == 0 or (b / (1 << bits * lv) <= row["high"] and row["low"] < (b + 1) / (1 << bits * lv))]
                    if not near:
                        continue
                    keys, counts = stored_keys(row)
                    for level, node, whole in near:
                        edge = [0, len(keys)] if level == 0 else np.searchsorted(keys, [key_of(k / (1 << bits * level)) for k in (node, node + 1)])
                        mine = slice(*edge)
                        score, pos, neg = distinct_scores(keys[mine], None if counts is None else counts[mine])
                        n = np.ones_like(pos)
                        if not whole and len(score):
                            score = np.floor(score * float(1 << bits * (level + 1)))
                            first = np.concatenate([[0], np.flatnonzero(np.diff(score)) + 1])
                            score, pos, neg, n = score[first], *(np.add.reduceat(c, first) for c in (pos, neg, n))
                        same = [(row["label"], level, node, whole)] * len(score)
                        yield from result_table([(*s, *v) for s, v in zip(same, zip(score.tolist(), pos.tolist(), neg.tolist(), n.tolist()), strict=True)], schema).to_batches()

        rows = self.steps.rows.where((F.col("label") != POOLED) & F.col("label").isin(*by_label))
        return rows.select("label", "low", "high", "keys", "counts").mapInArrow(run, schema)


def _step(mirror: float, far: float, outside: float, inside: float, heights: np.ndarray) -> str | None:
    """Which trial point replaces the highest corner; None asks for a smaller simplex."""
    lowest, second, highest = heights[0], heights[-2], heights[-1]
    if mirror < lowest:
        return "far" if far < mirror else "mirror"
    if mirror < second:
        return "mirror"
    if mirror < highest:
        return "outside" if outside <= mirror else None
    return "inside" if inside < highest else None


def simplex_rounds(
    start: np.ndarray, rounds: int, point_tol: float = SIMPLEX_XATOL, value_tol: float = SIMPLEX_FATOL
) -> Generator[list[np.ndarray], list[float], np.ndarray]:
    """The downhill simplex of Nelder and Mead (1965) as a generator: it yields the points whose
    heights it needs next, is sent those heights, and returns the minimum. The first corners are
    ``start`` and one step of 5 % (0.00025 from a zero) along each axis. A round looks along the line from
    the highest corner through the centre of the others: its mirror image, a point twice as far,
    and one half way on either side, all evaluated as one batch."""
    start = np.asarray(start, dtype=float)
    corners = np.vstack([start, start + np.diag(np.where(start == 0, 0.00025, 0.05 * start))])
    heights = np.array((yield list(corners)))
    reach = {"mirror": 1.0, "far": 2.0, "outside": 0.5, "inside": -0.5}
    for _ in range(1, rounds):
        order = np.argsort(heights, kind="stable")
        corners, heights = corners[order], heights[order]
        if heights[-1] - heights[0] <= value_tol and np.abs(corners - corners[0]).max() <= point_tol:
            break
        centre = corners[:-1].mean(axis=0)
        trial = {name: centre + r * (centre - corners[-1]) for name, r in reach.items()}
        height = dict(zip(trial, (yield list(trial.values())), strict=True))
        name = _step(**height, heights=heights)
        if name:
            corners[-1], heights[-1] = trial[name], height[name]
        else:
            corners[1:] = (corners[1:] + corners[0]) / 2
            heights[1:] = yield list(corners[1:])
    return corners[np.argmin(heights)]


def minimise_together(
    searches: Sequence[Generator[list[np.ndarray], list[float], np.ndarray]], evaluate: Callable[[list[tuple[int, np.ndarray]]], list[float]]
) -> list[np.ndarray]:
    """Run several searches side by side: one call of ``evaluate`` per round takes the
    (search number, point) pairs that all unfinished searches ask for."""
    best: list[np.ndarray] = [np.zeros(0)] * len(searches)
    asked = {i: next(s) for i, s in enumerate(searches)}
    while asked:
        pairs = [(i, p) for i, points in asked.items() for p in points]
        heights = iter(evaluate(pairs))
        again = {}
        for i, points in asked.items():
            try:
                again[i] = searches[i].send([next(heights) for _ in points])
            except StopIteration as end:
                best[i] = end.value
        asked = again
    return best


def downhill_simplex(
    evaluate: Callable[[list[np.ndarray]], list[float]],
    start: np.ndarray,
    rounds: int,
    point_tol: float = SIMPLEX_XATOL,
    value_tol: float = SIMPLEX_FATOL,
) -> np.ndarray:
    """Minimum of one function by ``simplex_rounds``; ``evaluate`` takes a batch of points."""
    return minimise_together([simplex_rounds(start, rounds, point_tol, value_tol)], lambda pairs: evaluate([p for _, p in pairs]))[0]


def tune_simplex(scored: DataFrame | Ranked, metric: str = "f1_macro", n_iterations: int = 50, labels_per_model: int | None = None) -> DataFrame:
    """THR4: joint refinement of all labels' thresholds by Nelder-Mead on
    ``-metric`` (``f1_macro``, ``f1_micro`` or ``balanced_acc``), started from the
    coarse grid, result clipped to [0.05, 0.95]. The driver holds the simplex and a
    ``CountIndex`` of the distinct scores: a search costs a few jobs, not one per round, and its
    counts are exact. Returns ``(label, threshold)``.

    With ``labels_per_model`` the labels belong to several models (label // labels_per_model),
    each refined by a simplex of its own; they share the index and its jobs."""
    if metric not in ("f1_macro", "f1_micro", "balanced_acc"):
        raise ValueError(f"Unknown metric: {metric}")
    if isinstance(scored, Ranked):
        spark, steps = scored.rows.sparkSession, scored
        coarse = tune_coarse(scored)
    else:
        spark = scored.sparkSession
        steps = write_shared_table(curves.score_counts(scored), "simplex-counts")  # scanned by the few jobs of the index
        coarse = tune_coarse(steps.select("label", F.col("score").alias("prob"), "pos", "neg"))
    start = {r["label"]: r["threshold"] for r in coarse.collect()}
    index = CountIndex(steps)
    models: dict[int, list[int]] = {}
    for lab in sorted(start):
        models.setdefault(lab // labels_per_model if labels_per_model else 0, []).append(lab)
    groups = list(models.values())

    def height(labels: list[int], point: np.ndarray) -> float:
        got = np.array([index.from_(lab, float(t)) for lab, t in zip(labels, point, strict=True)])
        total = np.array([index.totals[lab] for lab in labels], dtype=float)
        return -_metric_value(metric, got[:, 0], got[:, 1], total[:, 0], total[:, 1])

    while True:
        searches = [simplex_rounds(np.array([start[lab] for lab in labels]), n_iterations) for labels in groups]
        best = minimise_together(searches, lambda pairs: [height(groups[i], p) for i, p in pairs])
        if not index.missing:
            break
        index.fetch()
    lo, hi = SIMPLEX_BOUNDS
    rows = [(int(lab), float(np.clip(t, lo, hi))) for labels, point in zip(groups, best, strict=True) for lab, t in zip(labels, point, strict=True)]
    return spark.createDataFrame(rows, "label int, threshold double")


THRESHOLD_METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "grid": tune_grid,
    "bayesian": lambda val: tune_simplex(val, "f1_macro", 30),
    "roc": lambda val: tune_roc(val, "youden"),
}


def tune(scored: DataFrame, method: str = "grid") -> DataFrame:
    """THR8: dispatch by method name."""
    if method not in THRESHOLD_METHODS:
        raise ValueError(f"Unknown threshold method: {method}")
    return THRESHOLD_METHODS[method](scored)
