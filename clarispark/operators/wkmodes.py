"""Weighted k-modes over 0/1 columns, and rules from contrasting the centres of two classes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate, Rule


def distances(columns: list[str], centers: np.ndarray, weights: np.ndarray) -> list[Column]:
    """Sum of weights of the columns in which a row differs from each centre: x (w - 2 w c) + sum of w c, for 0/1 data."""
    out = []
    for c, w in zip(centers, weights, strict=True):
        terms = [F.col(f"`{x}`") * F.lit(float(wj - 2 * wj * cj)) for x, wj, cj in zip(columns, w, c, strict=True)]
        out.append(sum(terms[1:], terms[0]) + F.lit(float((w * c).sum())))
    return out


def assigned(df: DataFrame, columns: list[str], centers: np.ndarray, weights: np.ndarray) -> DataFrame:
    """df with cluster (nearest centre, of equals the first) and distance."""
    d = F.array(*[F.round(x, 9) for x in distances(columns, centers, weights)])
    return df.withColumn("__d", d).withColumn("distance", F.array_min("__d")).withColumn("cluster", (F.array_position("__d", F.col("distance")) - 1).cast("int")).drop("__d")


def updated(assigned_df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums of columns) of each cluster: one grouped pass."""
    n, sums = np.zeros(k), np.zeros((k, len(columns)))
    for r in assigned_df.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)]).collect():
        n[r["cluster"]] = r["__n"]
        sums[r["cluster"]] = [float(r[f"__{i}"]) for i in range(len(columns))]
    return n, sums


@dataclass
class WKModes:
    """Clusters with weights of columns: exp(-percent of the cluster's rows that differ from its centre / lambda_), scaled to a sum of 1.

    Percent and not numbers of rows: with these a large table puts all weight on the column with the
    fewest differing rows, by chance or not.  A cluster of 100 rows has the same weights either way.
    """

    n_clusters: int = 3
    max_iter: int = 100
    lambda_: float = 7.0
    init: str = "huang"
    seed: int = 42
    centers: np.ndarray | None = None
    weights: np.ndarray | None = None
    cost: list[float] = field(default_factory=list)
    converged: bool = False

    def _initial(self, df: DataFrame, columns: list[str]) -> np.ndarray:
        """huang: columns drawn by their frequencies, moved to the nearest row pattern; random: patterns; cao: dense and far apart.

        The columns' shares are of all rows; all choose among the most frequent row patterns, at most 1000 of them.
        """
        rows = df.groupBy(*columns).count().orderBy(F.desc("count"), *columns).limit(1000).collect()
        patterns = np.array([[float(r[c] or 0) for c in columns] for r in rows]).reshape(len(rows), len(columns))
        weight = np.array([r["count"] for r in rows], float)
        k, rng = min(self.n_clusters, len(patterns)), np.random.default_rng(self.seed)
        chosen: list[int] = []
        means = df.agg(F.count(F.lit(1)), *[F.avg(f"`{c}`") for c in columns]).first()
        share = np.array([float(x or 0) for x in means[1:]])
        density = weight / max(means[0], 1) + (patterns * share + (1 - patterns) * (1 - share)).mean(1)
        for _ in range(k):
            if self.init == "random":
                score = rng.random(len(patterns))
            elif self.init == "cao":
                score = density if not chosen else density * np.min([np.abs(patterns - patterns[c]).sum(1) for c in chosen], axis=0)
            else:
                score = -np.abs(patterns - (rng.random(len(columns)) < share)).sum(1)
            score[chosen] = -np.inf
            chosen.append(int(np.argmax(score)))
        return patterns[chosen]

    def fit(self, df: DataFrame, columns: list[str]) -> WKModes:
        data = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).persist()
        try:
            centers = self._initial(data, columns)
            weights = np.full(centers.shape, 1.0 / max(1, len(columns)))
            for _ in range(self.max_iter):
                near = assigned(data, columns, centers, weights)
                n, sums = updated(near, columns, len(centers))
                held = n > 0
                after = centers.copy()
                after[held] = np.floor(sums[held] / n[held][:, None] + 0.5)
                spread = np.abs(sums - after * n[:, None])
                z = -100 * spread / np.maximum(n, 1)[:, None] / self.lambda_
                weights = np.exp(z - z.max(1, keepdims=True))
                weights /= weights.sum(1, keepdims=True)
                self.cost.append(float((weights * spread).sum()))
                moved = float(((after - centers) ** 2).sum())
                centers = after
                if moved < 1e-7:
                    self.converged = True
                    break
        finally:
            data.unpersist()
        self.centers, self.weights, self.columns = centers, weights, columns
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return assigned(df, self.columns, self.centers, self.weights)

    def fit_predict(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).predict(df)


def extract_wkmodes(df: DataFrame, columns: list[str], flag: str, pos_k: int = 3, neg_k: int = 3, lambda_: float = 0.1, most: int = 4, all_apart: bool = False) -> list[Rule]:
    """Rules that tell each positive centre from every negative one: its heaviest columns in which they differ.

    A rule ends when it is told from all, or, with ``all_apart``, has all columns in which it differs
    from every negative centre; at ``most`` conditions in any case.
    """
    pos = WKModes(pos_k, lambda_=lambda_).fit(df.where(F.col(flag) == 1), columns)
    neg = WKModes(neg_k, lambda_=lambda_).fit(df.where(F.col(flag) == 0), columns)
    rules: dict[tuple, None] = {}
    for c, w in zip(pos.centers, pos.weights, strict=True):
        order = np.argsort(-w, kind="stable")
        left, items = list(range(len(neg.centers))), []
        for j in order:
            apart = [i for i in left if neg.centers[i][j] != c[j]]
            if all_apart:
                if (neg.centers[:, j] != c[j]).all():
                    items.append(Predicate(columns[j], "==", int(c[j])))
            elif apart:
                items.append(Predicate(columns[j], "==", int(c[j])))
                left = [i for i in left if i not in apart]
            if (not left and not all_apart) or len(items) >= most:
                break
        if items:
            rules.setdefault(tuple(sorted(items)), None)
    return [Rule(r) for r in rules]
