"""Quality by Bradley-Terry pairwise ranking.

A document's worth is a linear score of text features.  Preference pairs set a document of
quality 1 against one of quality 0; the chance that the first wins is the logistic of the
difference of their scores, and the weights minimise the logistic loss on feature differences.
The cut is a quantile of the training scores: the share of quality 0 among the labelled rows.
Scores are mapped to 0..1 by a logistic curve that takes the cut to the threshold.

A fit takes every labelled row that is not held out, and every pair of them.  Pairs are never
listed: a sum over pairs is one over differences of two scores, so each row is spread over the
POINTS grid points around its score as interpolation would (polynomials of degree POINTS - 1 on
steps of STEP, within 1e-9 of the logistic), and pairs of grid points stand for pairs of rows.
The features stay in a table; a Newton step reads it twice, and sums on the grid reach the driver.
The cut is an exact quantile.  Scoring reads every whole text.

Edge cases: null and empty texts have the features of a text without words and are scored like
any other; a very long text is counted whole; without labels of both classes every score is 0.5;
a document with two labels counts as good if either says so; texts of equal features, repeated
rows among them, get equal scores, and a raw score at the cut is at the threshold; a null doc_id is
kept; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.ranks import values_at
from clarispark.llm.common import arrow_map, batch_of, held_out, slices, usable_labels
from clarispark.session import materialize, release

THRESHOLD, L2 = 0.7, 1e-3
#: The grid that scores are spread over; its points around a score, and what divides their weights.
STEP, POINTS = 0.125, 8
_AROUND = np.arange(1 - POINTS // 2, POINTS // 2 + 1)
_DIVISORS = np.array([np.prod([j - m for m in _AROUND if m != j]) for j in _AROUND], float)
#: Tasks of a pass over the features at most, each of which sends its sums to the driver.
TASKS = 64

_KINDS = np.zeros(256, np.int64)  # of UTF-8 bytes: 0 lower or beyond ASCII, 1 upper, 2 digit, 3 space, 4 line end, 5 plain punctuation, 6 other symbol
for _b in range(128):
    _c = chr(_b)
    _KINDS[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 0 if _c.islower() else 5 if _c in ".,;:'\"-()" else 6

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "symbol", "symbol_pairs", "line_ends", "distinct_words",
    "repeats_next", "top_word", "upper_words", "symbol_words", "line_bytes", "any_symbol", "any_upper_run", "any_repeat_run",
)


def features(text: str | None) -> list[float]:
    """Of the whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not raw.strip():
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    kinds = _KINDS[data]
    count = np.bincount(kinds, minlength=7)
    symbol = kinds == 6
    words = raw.split()
    k = len(words)
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    shouted = sum(map(bytes.isupper, words))
    ends = np.flatnonzero(kinds == 4)
    # White space ends a word; a word with a symbol in it counts once.
    space = (kinds == 3) | (kinds == 4)
    word_of = np.cumsum(space)
    marked = len(np.unique(word_of[symbol])) if symbol.any() else 0
    top = max(Counter(words).values()) / k
    return [
        np.log1p(n), np.log1p(k), sum(map(len, words)) / k, count[1] / n, count[2] / n, count[5] / n, count[6] / n, float((symbol[1:] & symbol[:-1]).sum()) / n,
        len(ends) / k, distinct / k, repeats / k, top, shouted / k, marked / k, np.log1p(n / (len(ends) + 1)),
        min(count[6] / 20, 1.0), min(shouted / 20, 1.0), min(repeats / 20, 1.0),
    ]


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray | None
    cut: float
    spread: float
    threshold: float = THRESHOLD

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; the cut scores as the threshold does."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = (self.raw(x) - self.cut) / self.spread + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _spread(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, POINTS): the numbers of the grid points around each score, and their weights."""
    cell = np.floor(s / STEP)
    gaps = (s / STEP - cell)[:, None] - _AROUND
    weights = np.stack([np.prod(np.delete(gaps, j, 1), 1) for j in range(POINTS)], 1) / _DIVISORS
    return cell.astype(np.int64)[:, None] + _AROUND, weights


@dataclass
class Sums:
    """Of the rows of a class, on the grid from point ``lo`` on: how many, and the sum of their features."""

    lo: int
    values: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray, w: np.ndarray) -> Sums:
        points, weights = _spread(z @ w)
        lo = int(points.min())
        flat, n = (points - lo).ravel(), int(points.max()) - lo + 1
        return cls(lo, np.stack([np.bincount(flat, (weights * c[:, None]).ravel(), n) for c in (np.ones(len(z)), *z.T)], 1))

    def __add__(self, other: Sums) -> Sums:
        lo = min(self.lo, other.lo)
        out = np.zeros((max(x.lo + len(x.values) for x in (self, other)) - lo, self.values.shape[1]))
        for x in (self, other):
            out[x.lo - lo : x.lo - lo + len(x.values)] += x.values
        return Sums(lo, out)

    def padded(self) -> Sums:
        """With a point more on either side: a score that is computed again may round to the next cell."""
        return Sums(self.lo - 1, np.pad(self.values, ((1, 1), (0, 0))))


class Pairs:
    """Loss and its derivatives over all pairs of a row of quality 1 and one of quality 0, from their sums on the grid."""

    def __init__(self, bad: Sums, good: Sums):
        self.bad, self.good = bad.padded(), good.padded()
        (m0, v0), (m1, v1) = ((x.values[:, 0], x.values[:, 1:]) for x in (self.bad, self.good))
        t0, t1 = (STEP * (x.lo + np.arange(len(x.values))) for x in (self.bad, self.good))
        total, d = m0.sum() * m1.sum(), v0.shape[1]
        self.loss, self.grad, self.cross = 0.0, np.zeros(d), np.zeros((d, d))
        #: At each grid point: the curvature that the pairs of a row there add, as a share of all pairs.
        self.curve0, self.curve1 = np.zeros(len(t0)), np.zeros(len(t1))
        for at in range(0, len(t1), 512):
            k = slice(at, at + 512)
            gap = t1[k, None] - t0[None, :]
            loses = np.exp(-np.logaddexp(0, gap))
            q = loses * (1 - loses)
            self.loss += m1[k] @ np.logaddexp(0, -gap) @ m0 / total
            self.grad -= (v1[k].T @ (loses @ m0) - v0.T @ (loses.T @ m1[k])) / total
            self.cross += v1[k].T @ q @ v0 / total
            self.curve1[k] = q @ m0 / total
            self.curve0 += q.T @ m1[k] / total

    def curvature(self, side: int, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What rows of one class add to the second derivative, but for products across the classes."""
        curve, lo = (self.curve1, self.good.lo) if side else (self.curve0, self.bad.lo)
        points, weights = _spread(z @ w)
        return (z * (weights * curve[points - lo]).sum(1)[:, None]).T @ z


def _descend(sums, curvature, d: int, l2: float) -> np.ndarray:
    """The weights of least mean loss over all pairs, by Newton steps that are halved while they raise it.

    ``sums``: of weights, the classes' Sums; ``curvature``: of Pairs and weights, the sum of all rows' curvature.
    """
    w = np.zeros(d)
    pairs = Pairs(*sums(w))
    for _ in range(50):
        hess = curvature(pairs, w) - pairs.cross - pairs.cross.T + l2 * np.eye(d)
        step = np.linalg.solve(hess, pairs.grad + l2 * w)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        loss = pairs.loss + l2 / 2 * w @ w
        while True:
            after = w - step
            pairs = Pairs(*sums(after))
            if pairs.loss + l2 / 2 * after @ after <= loss + 1e-9 or np.abs(step).max() < 1e-7:
                break
            step = step / 2
        w = after
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int | None = None, l2: float = L2, threshold: float = THRESHOLD, seed: int = 0) -> Model:
    """Bradley-Terry weights from all pairs of a row with y = 1 and one with y = 0 of an array, or from so many drawn ones."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    if not len(good) or not len(bad):
        return Model(mean, std, None, 0.0, 1.0, threshold)
    z = np.clip((x - mean) / std, -8, 8)
    sides = z[bad], z[good]
    if pairs is None:
        w = _descend(lambda w: [Sums.of(s, w) for s in sides], lambda p, w: sum(p.curvature(i, s, w) for i, s in enumerate(sides)), x.shape[1], l2)
    else:
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            grad = -(d * p[:, None]).mean(0) + l2 * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            w = w - step
            if np.abs(step).max() < 1e-7:
                break
    model = Model(mean, std, w, 0.0, 1.0, threshold)
    raw = np.sort(model.raw(x))
    model.cut = float(raw[[len(bad) - 1, len(bad)]].mean())  # between the last row below the quantile and the next
    model.spread = max(float(np.median(np.abs(raw - model.cut))) / 4, 1e-6)
    return model


FEATURED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the features (x) of every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield batch_of(FEATURED, [b.column("doc_id"), b.column("held_out"), [features(t) for t in b.column("text").to_pylist()]])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return arrow_map(named, run, "doc_id long, held_out boolean, x array<double>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _fold(known: DataFrame, model: Model, of: Callable[[int, np.ndarray], object]) -> list:
    """Of each class, the sum of ``of``(class, standardised features) over all rows of known (label, x); each task adds up its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, object] = {}
        for b in slices(batches, 8192):
            y, z = b.column("label").to_numpy(), np.clip((_matrix(b) - model.mean) / model.std, -8, 8)
            for side in (0, 1):
                if (y == side).any():
                    own = of(side, z[y == side])
                    sums[side] = sums[side] + own if side in sums else own
        schema = pa.schema([("part", pa.int32()), ("label", pa.int32()), ("sums", pa.binary())])
        part = TaskContext.get().partitionId()
        yield batch_of(schema, [[part] * len(sums), list(sums), [pickle.dumps(x) for x in sums.values()]])

    out: list = [None, None]
    for r in sorted(arrow_map(known.coalesce(TASKS), run, "part int, label int, sums binary").collect()):  # a row per task and class
        own = pickle.loads(bytes(r["sums"]))
        out[r["label"]] = own if out[r["label"]] is None else out[r["label"]] + own
    return out


def fit_featured(rows: DataFrame, labels: DataFrame, l2: float = L2, threshold: float = THRESHOLD) -> Model:
    """Fits on all rows of ``featured`` that have a label and are not held out."""
    known = rows.where(~F.col("held_out")).join(usable_labels(labels, "quality").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    known = materialize(known.where(F.col("__label").isin(0, 1)).select(F.col("__label").alias("label"), "x"), "labelled_features")
    try:
        d = range(len(FEATURES))
        n, good, *moments = known.agg(F.count(F.lit(1)), F.sum("label"), *[F.avg(F.col("x")[i]) for i in d], *[F.stddev_pop(F.col("x")[i]) for i in d]).first()
        if not n or good in (0, n):
            return Model(np.zeros(len(d)), np.ones(len(d)), None, 0.0, 1.0, threshold)
        mean, std = np.array(moments, float).reshape(2, -1)
        model = Model(mean, std + 1e-9, None, 0.0, 1.0, threshold)
        model.weights = _descend(
            lambda w: _fold(known, model, lambda side, z: Sums.of(z, w)), lambda p, w: sum(_fold(known, model, lambda side, z: p.curvature(side, z, w))), len(d), l2
        )
        bad = n - good
        raw = arrow_map(known.select("x"), lambda batches: (pa.record_batch([pa.array(model.raw(_matrix(b)))], ["raw"]) for b in slices(batches, 8192)), "raw double")
        model.cut = float(np.mean(values_at(raw, {"raw": [bad - 1, bad]})["raw"]))  # between the last row below the quantile and the next
        apart = raw.select(F.abs(F.col("raw") - model.cut).alias("apart"))
        model.spread = max(values_at(apart, None, {"apart": [0.5]})["apart"][0] / 4, 1e-6)
        return model
    finally:
        release(known)


def fit(spark, docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on all rows of docs that have a label and are not held out."""
    return fit_featured(featured(docs), labels)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_featured(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``featured``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            s = model.score(_matrix(b))
            yield batch_of(SCORES, [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= model.threshold).astype(np.int32))])

    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return score_featured(featured(docs), model)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    rows = materialize(featured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality_features")
    return score_featured(rows, fit_featured(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
