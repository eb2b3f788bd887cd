"""Additive models of piecewise-linear shape functions, fitted from one pass of sufficient statistics.

The design has, for each feature, its scaled value and a hinge per threshold.  One distributed
pass forms the Gram matrix; every later step, edits and constraints included, runs on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispark.functions.linalg import nnls, t_quantile
from clarispark.functions.ranks import values_at

MAX_COLUMNS = 4000
# Names of constraint types.
CONSTRAINTS = {n: k for k, names in {"Increase": ("i", "inc", "increase"), "Decrease": ("d", "dec", "decrease"), "Convex": ("v", "vex", "convex"), "Concave": ("c", "cave", "concave"),
                                     "Flat": ("flat",), "Linear": ("linear",)}.items() for n in names}
FIRST, SECOND = {"Increase", "Decrease", "Flat"}, {"Convex", "Concave", "Linear"}


def thresholds(df: DataFrame, feature: str, bins: int = 64) -> list[float]:
    """At most bins distinct values, evenly spaced by rank, the smallest first."""
    def evenly(n: int) -> list[int]:
        return sorted({min(round(i * n / min(bins, n)), n - 1) for i in range(min(bins, n))}) if n else []

    return sorted(set(values_at(df, {feature: evenly}, distinct=True)[feature]))


def suffix_sums(df: DataFrame, feature: str, cuts: list[float], weight: str | None = None) -> list[tuple[float, float, float, float]]:
    """(cut, sum of w, of w x, of w x^2) over the rows with x >= cut: sums by bin in Spark, added up on the driver."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = F.col(feature).cast("double")
    bin_ = sum((F.when(x >= F.lit(c), 1).otherwise(0) for c in cuts[1:]), F.when(x >= F.lit(cuts[0]), 0).otherwise(-1))
    sums = {r["b"]: r for r in df.groupBy(bin_.alias("b")).agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2")).collect()}
    out, run = [], np.zeros(3)
    for i in range(len(cuts) - 1, -1, -1):
        if i in sums:
            run = run + [sums[i]["s0"], sums[i]["s1"], sums[i]["s2"]]
        out.append((cuts[i], *map(float, run)))
    return out[::-1]


def gram(df: DataFrame, features: list[str], label: str, cuts: list[list[float]], mean: np.ndarray, std: np.ndarray, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Z'WZ, Z'Wy, y'Wy, sum of w, sum of w y, with Z = (1, hinges of each feature): one pass, a partial per task."""
    size = 1 + sum(len(c) for c in cuts)
    if size > MAX_COLUMNS:
        raise ValueError(f"{size} columns exceed {MAX_COLUMNS}; use fewer features or bins")
    scaled = [(np.array(c) - m) / s for c, m, s in zip(cuts, mean, std, strict=True)]

    def design(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), *[hinges((x[:, i] - mean[i]) / std[i], scaled[i]) for i in range(x.shape[1])]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for f in frames:
            for at in range(0, len(f), 20_000):
                part = f.iloc[at : at + 20_000]
                z = np.hstack([design(part[[f"x{i}" for i in range(len(features))]].to_numpy(float)), part[["y"]].to_numpy(float)])
                total += (z * part["w"].to_numpy(float)[:, None]).T @ z
        at = np.arange(size + 1)
        yield pd.DataFrame({"i": np.repeat(at, size + 1), "j": np.tile(at, size + 1), "v": total.ravel()})

    named = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(f"`{label}`").cast("double").alias("y"),
                      (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).na.drop()
    rows = named.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # at most MAX_COLUMNS squared
    full = np.zeros((size + 1, size + 1))
    full[rows["i"], rows["j"]] = rows["v"]
    return full[:-1, :-1], full[:-1, -1], full[-1, -1], full[0, 0], full[0, -1]


def hinges(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """max(x - cut, 0) for each cut; for the first cut x - cut itself, so that the line goes on to its left."""
    out = np.maximum(x[:, None] - cuts[None, :], 0)
    if len(cuts):
        out[:, 0] = x - cuts[0]
    return out


@dataclass
class GAM:
    """Fit, predict, edit.  ``lambda_1`` weighs the squared hinge weights (a ridge, relaxed for weights that are large, as Huber's loss is)."""

    max_iter: int = 100
    lambda_1: float = 0.1
    eta: float = 0.01
    bin_num: int = 64
    block_size: int = 50
    reg_type: str = "Huber"
    seed: int = 0
    features: list[str] = field(default_factory=list)
    constraints: dict[str, list[tuple[float, float, str]]] = field(default_factory=dict)
    overrides: dict[str, Callable[[Column], Column] | float] = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None, category_features: list[str] | None = None) -> GAM:
        self.features, self.label, self.categories = features, label, set(category_features or [])
        clean = df.select(*features, label, *([weight] if weight else [])).na.drop()
        stats = clean.agg(*[e for i, c in enumerate(features) for e in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))], F.stddev_pop(label).alias("sy"), F.count(F.lit(1)).alias("n")).first()
        if not stats["n"]:
            raise ValueError("no rows without missing values")
        self.mean = np.array([stats[f"m{i}"] for i in range(len(features))])
        self.std = np.array([stats[f"s{i}"] for i in range(len(features))]) + 1e-15
        self.y_scale, self.n_rows = stats["sy"] + 1e-15, stats["n"]
        self.cuts = [thresholds(clean, c, self.bin_num) for c in features]
        self.q, self.r, self.yy, self.sw, self.sy = gram(clean, features, label, self.cuts, self.mean, self.std, weight)
        self.theta = np.zeros(len(self.r))
        self.theta[0] = self.sy / max(self.sw, 1e-300)
        self.starts = np.cumsum([1, *[len(c) for c in self.cuts]])
        return self.update()

    def update(self, max_iter: int | None = None) -> GAM:
        """Goes on from the present weights: blocks of random hinges, exactly solved with the rest held; constraints are projected on after each sweep."""
        rng, eps = np.random.default_rng(self.seed), 1.0
        ridge = np.full(len(self.r), self.lambda_1 * self.eta * self.sw)
        ridge[0] = 1e-9
        for i, c in enumerate(self.features):
            if c in self.categories:
                ridge[self.starts[i] : self.starts[i + 1]] = 1e-9 * self.sw
        last = np.inf
        for it in range(max_iter or self.max_iter):
            for i in rng.permutation(len(self.features)):
                own = np.arange(self.starts[i], self.starts[i + 1])
                block = np.concatenate(([0], np.sort(rng.permutation(own)[: self.block_size])))
                soft = ridge[block] / (np.maximum(1.0, np.abs(self.theta[block]) / (eps * self.y_scale)) if self.reg_type == "Huber" else 1.0)
                a = self.q[np.ix_(block, block)] + np.diag(soft + 1e-9 * self.sw)
                b = self.r[block] - self.q[block] @ self.theta + self.q[np.ix_(block, block)] @ self.theta[block]
                self.theta[block] = np.linalg.solve(a, b)
            for name, cons in self.constraints.items():
                self._project(self.features.index(name), cons)
            if self.constraints:  # the constant that fits the shapes as they are now
                self.theta[0] = (self.r[0] - self.q[0, 1:] @ self.theta[1:]) / max(self.q[0, 0], 1e-300)
            eps = max(eps * 0.95, 1e-3)
            if it % 20 == 19:
                loss = self.loss()
                if abs(last - loss) <= 1e-5 * max(abs(last), 1e-300):
                    break
                last = loss
        return self

    def loss(self) -> float:
        return float(self.yy - 2 * self.theta @ self.r + self.theta @ self.q @ self.theta)

    def residual_variance(self) -> float:
        return self.loss() / max(1.0, self.n_rows - np.linalg.matrix_rank(self.q))

    # --- Constraints and edits ---

    def add_constraint(self, left: float, right: float, kind: str, feature: str | int | None = None) -> GAM:
        """Between left and right the shape rises, falls, or is convex or concave; feature: name, number, or None for all."""
        if kind.lower() not in CONSTRAINTS:
            raise ValueError(f"unknown constraint {kind!r}")
        names = self.features if feature is None else [self.features[feature] if isinstance(feature, int) else feature]
        for name in names:
            if name not in self.features:
                raise ValueError(f"no feature {name!r}")
            self.constraints[name] = merged([*self.constraints.get(name, []), (left, right, CONSTRAINTS[kind.lower()])])
        return self

    def add_constraints(self, constraints: list[tuple[float, float, str]], feature: str | int | None = None) -> GAM:
        for left, right, kind in constraints:
            self.add_constraint(left, right, kind, feature)
        return self

    def _values(self, i: int) -> np.ndarray:
        """The shape at its cuts, but for a constant."""
        x = (np.array(self.cuts[i]) - self.mean[i]) / self.std[i]
        return hinges(x, x) @ self.theta[self.starts[i] : self.starts[i + 1]]

    def _project(self, i: int, cons: list[tuple[float, float, str]]) -> None:
        cuts = np.array(self.cuts[i])
        if len(cuts) < 2:
            return
        x = (cuts - self.mean[i]) / self.std[i]
        slope = np.cumsum(self.theta[self.starts[i] : self.starts[i + 1]])
        gaps = np.append(np.diff(x), 1.0)
        for left, right, kind in cons:
            at = np.flatnonzero((np.append(cuts[1:], np.inf) > left) & (cuts < right))
            if not len(at):
                continue
            if kind in ("Increase", "Decrease"):
                # Nearest shape with steps of one sign: non-negative least squares on the steps.
                sign = 1.0 if kind == "Increase" else -1.0
                steps = sign * slope[at] * gaps[at]
                low = np.tril(np.ones((len(at), len(at))))
                slope[at] = sign * nnls(low, low @ steps) / gaps[at]
            elif kind == "Flat":
                slope[at] = 0.0
            elif kind == "Linear":
                slope[at] = (slope[at] * gaps[at]).sum() / gaps[at].sum()
            else:
                sign = 1.0 if kind == "Convex" else -1.0
                slope[at] = sign * _monotone(sign * slope[at], gaps[at])
        self.theta[self.starts[i] : self.starts[i + 1]] = np.diff(slope, prepend=0.0)

    def update_weights(self, left: float, right: float, by: float, feature: str | int) -> GAM:
        """Scales the changes of slope at the cuts within [left, right]."""
        i = feature if isinstance(feature, int) else self.features.index(feature)
        cuts = np.array(self.cuts[i])
        at = self.starts[i] + np.flatnonzero((cuts >= left) & (cuts <= right))
        self.theta[at] *= by
        return self

    def set_prediction(self, feature: str, value: Callable[[Column], Column] | float) -> GAM:
        """The feature contributes a constant, or what a function of its column gives."""
        self.overrides[feature] = value
        return self

    # --- Columns and tables ---

    def segments(self, feature: str) -> list[tuple[float, float, float]]:
        """(from, value there, slope) of each piece of a shape, in the units of x and y."""
        i = self.features.index(feature)
        slope = np.cumsum(self.theta[self.starts[i] : self.starts[i + 1]]) / self.std[i]
        return list(zip(self.cuts[i], map(float, self._values(i)), map(float, slope), strict=True))

    def shape_column(self, feature: str, x: Column | None = None) -> Column:
        x = F.col(f"`{feature}`").cast("double") if x is None else x
        if feature in self.overrides:
            own = self.overrides[feature]
            return own(x) if callable(own) else F.lit(float(own))
        return piecewise(x, self.segments(feature))

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        if missing := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"missing columns: {missing}")
        return df.withColumn(to, sum((self.shape_column(c) for c in self.features), F.lit(float(self.theta[0]))))

    def contributions(self, df: DataFrame, intercept: bool = False) -> DataFrame:
        """A column ``<feature>__effect`` per feature; without an intercept each carries its share of the offset, so they sum to the prediction."""
        share = 0.0 if intercept else float(self.theta[0]) / len(self.features)
        return df.withColumns({f"{c}__effect": self.shape_column(c) + F.lit(share) for c in self.features})

    def shape_table(self, df: DataFrame, feature: str) -> DataFrame:
        """(x, y, density) at the distinct values of a feature."""
        counted = df.select(F.col(feature).cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        total = counted.agg(F.sum("n")).first()[0] or 1
        return counted.select("x", self.shape_column(feature, F.col("x")).alias("y"), (F.col("n") / F.lit(total)).alias("density"))

    def confidence(self, alpha: float = 0.05) -> dict[str, list[tuple[float, float, float, float]]]:
        """(x, shape, lower, upper) at the cuts of each feature, of the least-squares fit's covariance."""
        cov = np.linalg.pinv(self.q + 1e-9 * self.sw * np.eye(len(self.q))) * self.residual_variance()
        t = t_quantile(1 - alpha / 2, max(1, self.n_rows - len(self.q)))
        out = {}
        for i, c in enumerate(self.features):
            own = slice(self.starts[i], self.starts[i + 1])
            x = (np.array(self.cuts[i]) - self.mean[i]) / self.std[i]
            z = hinges(x, x)
            half = t * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, cov[own, own], z), 0))
            y = self._values(i)
            out[c] = [(float(a), float(b), float(b - h), float(b + h)) for a, b, h in zip(self.cuts[i], y, half, strict=True)]
        return out

    def pointwise_confidence(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """prediction, lower, upper of each row."""
        cov = np.linalg.pinv(self.q + 1e-9 * self.sw * np.eye(len(self.q))) * self.residual_variance()
        t = t_quantile(1 - alpha / 2, max(1, self.n_rows - len(self.q)))
        scaled = [(np.array(c) - m) / s for c, m, s in zip(self.cuts, self.mean, self.std, strict=True)]
        names, mean, std = self.features, self.mean, self.std

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = f[names].to_numpy(float)
                z = np.hstack([np.ones((len(x), 1)), *[hinges((x[:, i] - mean[i]) / std[i], scaled[i]) for i in range(len(names))]])
                half = t * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, cov, z), 0))
                f["lower"], f["upper"] = f["prediction"] - half, f["prediction"] + half
                yield f

        base = self.predict(df)
        from pyspark.sql import types as T

        return base.mapInPandas(run, T.StructType([*base.schema.fields, T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))

    def r2(self, df: DataFrame) -> float:
        e = self.predict(df).select(F.col(self.label).cast("double").alias("y"), "prediction").na.drop()
        row = e.agg(F.sum((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y") * F.count("y")).first()
        return 1 - row[0] / row[1]

    def waterfall(self, df: DataFrame, key: str) -> DataFrame:
        """Long table for plots: key, feature, value, effect."""
        each = self.contributions(df)
        items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"), F.col(f"`{c}__effect`").alias("effect")) for c in self.features])
        return each.select(key, F.explode(items).alias("i")).select(key, "i.feature", "i.value", "i.effect")


def piecewise(x: Column, segments: list[tuple[float, float, float]]) -> Column:
    """The piece a value lies in, as one flat CASE; left of the first cut the first slope goes on."""
    chain = None
    for x0, y0, slope in reversed(segments[1:]):
        value = F.lit(y0) + F.lit(slope) * (x - F.lit(x0))
        chain = F.when(x >= F.lit(x0), value) if chain is None else chain.when(x >= F.lit(x0), value)
    x0, y0, slope = segments[0]
    first = F.lit(y0) + F.lit(slope) * (x - F.lit(x0))
    return first if chain is None else chain.otherwise(first)


def _monotone(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Nearest rising sequence by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b in zip(v, w, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            y, z = blocks.pop(), blocks.pop()
            blocks.append([(y[0] * y[1] + z[0] * z[1]) / (y[1] + z[1]), y[1] + z[1], y[2] + z[2]])
    return np.concatenate([np.full(int(n), a) for a, _, n in blocks])


def merged(cons: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    """Intervals of one order made disjoint: same types join, contrary ones are flat (first order) or straight (second) where they meet."""
    out = []
    for order, clash in ((FIRST, "Flat"), (SECOND, "Linear")):
        own = [c for c in cons if c[2] in order]
        edges = sorted({e for c in own for e in c[:2]})
        pieces: list[list] = []
        for a, b in zip(edges, edges[1:], strict=False):
            kinds = {k for lo, hi, k in own if lo <= a and b <= hi}
            if kinds:
                kind = kinds.pop() if len(kinds) == 1 else clash
                if pieces and pieces[-1][2] == kind and pieces[-1][1] == a:
                    pieces[-1][1] = b
                else:
                    pieces.append([a, b, kind])
        out += [tuple(p) for p in pieces]
    return out
