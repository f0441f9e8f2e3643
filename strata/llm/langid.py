"""Language identification in two levels: the family first, then the language within it.

Both levels decide by one-versus-one linear support vector machines on hashed letter trigrams
of the whole text: first between families, then between the languages of the chosen family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import vec

#: Families of ISO 639-1 codes (fixed values); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
}
#: Rows of each language that the machines are fitted on, about (rows are taken by hash); the
#: feature slots; passes over the sample; cost of a margin error.
SAMPLE_PER_LANGUAGE, SLOTS, PASSES, COST = 1_000, 1 << 14, 12, 1.0
_PIECE_BYTES = 2 << 20


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"={lang}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_FOLD = np.zeros(256, np.uint32)
_FOLD[np.arange(128, 256)] = np.arange(128, 256)
_FOLD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 27)
_FOLD[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(1, 27)


def trigram_slots(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the letter trigrams of each text of a piece (with a space before and
    after), and the bounds of each text's slots. Anything but letters counts as a space;
    A-Z and Latin-1 capitals as small letters."""
    lo, hi, n = int(off[0]), int(off[-1]), len(off) - 1
    body = _FOLD[raw[lo:hi]]
    if len(body) > 1:
        latin = np.concatenate([[False], raw[lo : hi - 1] == 0xC3]) & (body >= 0x80) & (body <= 0x9E)
        body = np.where(latin, body | 0x20, body)
    at = off - lo + 2 * np.arange(n + 1)
    padded = np.zeros(hi - lo + 2 * n, np.uint32)
    padded[np.arange(hi - lo) + 1 + 2 * np.repeat(np.arange(n), np.diff(off))] = body
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)
    first = np.minimum(at, len(slot))
    # trigrams that reach into the next text, and runs of spaces, are no features
    slot[(padded[:-2] == 0) & (padded[1:-1] == 0)] = -1
    edges = at[1:-1]
    for back in (1, 2):
        where = edges - back
        slot[where[(where >= 0) & (where < len(slot))]] = -1
    slot[(padded[1:-1] == 0) & (padded[2:] == 0)] = -1
    return slot, first


def vector(slots: np.ndarray) -> np.ndarray:
    """Root counts of the slots, scaled to length 1."""
    x = np.sqrt(np.bincount(slots[slots >= 0], minlength=SLOTS))
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, passes: int = PASSES, cost: float = COST) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent (hinge loss), weights then bias.
    ``rows`` are (slots, values). Each side's cost is scaled by its share of the rows."""
    w = np.zeros(SLOTS + 1)
    rows = [(np.append(s, SLOTS), np.append(v, 1.0)) for s, v in rows]
    upper = np.where(sign > 0, cost * len(sign) / (2 * max((sign > 0).sum(), 1)), cost * len(sign) / (2 * max((sign < 0).sum(), 1)))
    alpha, square = np.zeros(len(rows)), np.array([v @ v for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            s, v = rows[i]
            new = min(max(alpha[i] - (sign[i] * (w[s] @ v) - 1) / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w[s] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
    return w


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Model:
    """Pairwise machines of both levels; ``machines[(a, b)]`` is positive for a."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str], np.ndarray]) -> None:
        self.langs = sorted(langs)
        self.members: dict[str, list[str]] = {}
        for x in self.langs:
            self.members.setdefault(family(x), []).append(x)
        self.pairs = sorted(machines)
        self.weights = np.stack([machines[p] for p in self.pairs], axis=1) if machines else np.zeros((SLOTS + 1, 0))

    def _vote(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with most wins (ties: larger sum of margins, then order), and its least margin."""
        own = {a: [margin.get((a, b), -margin.get((b, a), 0.0)) for b in names if b != a] for a in names}
        best = min(names, key=lambda a: (-sum(m > 0 for m in own[a]), -sum(own[a]), a))
        return best, min(own[best], default=np.inf)

    def predict(self, slots: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return "und", 0.0
        m = vector(slots) @ self.weights[:-1] + self.weights[-1]
        margin = dict(zip(self.pairs, m.tolist(), strict=True))
        group, first = self._vote(sorted(self.members), margin)
        lang, second = self._vote(self.members[group], margin)
        return lang, float(1 / (1 + np.exp(-3 * np.clip(min(first, second), -20, 20))))


def _pair_names(langs: list[str]) -> dict[str, list[tuple[str, str, int]]]:
    """Per language: the machines (a, b) it is an example of, and its side."""
    groups: dict[str, list[str]] = {}
    for x in sorted(langs):
        groups.setdefault(family(x), []).append(x)
    names = sorted(groups)
    out: dict[str, list[tuple[str, str, int]]] = {x: [] for x in langs}
    for g, own in groups.items():
        for x in own:
            out[x] += [(min(g, o), max(g, o), 1 if g < o else -1) for o in names if o != g]
            out[x] += [(min(x, o), max(x, o), 1 if x < o else -1) for o in own if o != x]
    return out


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on (doc_id, text, lang) rows whose lang is not null and whose text has a letter.

    Languages are counted over all rows; about ``sample_per_language`` rows of each are taken by
    a hash of their id (a documented bound for the classifier alone). Each machine is fitted in
    one task on its two sides; what returns to the driver is one weight vector per machine."""
    rows = labelled.where(F.col("lang").isNotNull() & _lettered(F.col("text")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return Model([], {})
    pairs = _pair_names(sorted(counts))
    if not any(pairs.values()):
        return Model(list(counts), {})
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_per_language / n)))])
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit < share[F.col("lang")]).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            langs = record.column(0).to_pylist()
            raw, off = vec.text_buffer(record.column(1))
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                slots, at = trigram_slots(raw, off[a : b + 1])
                out = []
                for lang, s, e in zip(langs[a:b], at[:-1], at[1:], strict=True):
                    x = vector(slots[s:e])
                    on = np.flatnonzero(x)
                    out += [(p, q, side, on.astype(np.int32).tobytes(), x[on].astype(np.float32).tobytes()) for p, q, side in pairs[lang]]
                if out:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "side", "slots", "vals"])

    def train(table: pa.Table) -> pa.Table:
        x = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for s, v in zip(table.column("slots").to_pylist(), table.column("vals").to_pylist(), strict=True)]
        order = sorted(range(len(x)), key=lambda i: (x[i][0].tobytes(), x[i][1].tobytes()))  # whatever order rows came in
        side = table.column("side").to_numpy()
        w = fit_svm([x[i] for i in order], side[order].astype(np.float64))
        return pa.table({"a": [table.column("a")[0].as_py()], "b": [table.column("b")[0].as_py()], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    found = sample.mapInArrow(features, "a string, b string, side int, slots binary, vals binary").groupBy("a", "b").applyInArrow(train, "a string, b string, w binary").collect()
    return Model(list(counts), {(r["a"], r["b"]): np.frombuffer(r["w"], np.float32).astype(np.float64) for r in found})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; map only, from the text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Null ids
    and repeated rows each give a row; other columns are not read. Score is a squashed smallest
    margin over both levels (1 if only one language was learned)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _lettered(F.col(text_col).cast("string")).alias("lettered"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight vector per machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for record in batches:
            ok = record.column(1).to_pylist()
            raw, off = vec.text_buffer(record.column(2))
            out: list[tuple[str, float]] = []
            for a, b in vec.pieces(np.diff(off), _PIECE_BYTES):
                slots, at = trigram_slots(raw, off[a : b + 1])
                out += [own.predict(slots[s:e]) if good else ("und", 0.0) for good, s, e in zip(ok[a:b], at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [record.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
