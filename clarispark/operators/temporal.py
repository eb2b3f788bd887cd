"""Attribution of time series by patches: what a span of one feature contributes when the rest is replaced.

Series are arrays.  A span of patches of one feature is held and the feature's other steps come
from a generator; the model is a function of {feature: array Column} to a Column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SeriesModel = Callable[[dict[str, Column]], Column]


def validate(df: DataFrame, features: list[str], patch_size: int) -> int:
    """The number of patches; an error unless all series have one length that patches divide."""
    sizes = df.agg(*[e for c in features for e in (F.min(F.size(c)), F.max(F.size(c)))]).first()
    if len(set(sizes)) != 1 or sizes[0] is None or sizes[0] <= 0 or sizes[0] % patch_size:
        raise ValueError(f"series lengths {sorted(set(sizes), key=str)} must be one multiple of {patch_size}")
    return sizes[0] // patch_size


def empirical(background: DataFrame, features: list[str], key: str, draws: int) -> DataFrame:
    """Generator of the data's own series: the ``draws`` rows with the smallest hashed keys, as (draw, g_<feature>)."""
    return background.orderBy(F.xxhash64(key), key).limit(draws).select(F.xxhash64(key).alias("draw"), *[F.col(c).alias(f"g_{c}") for c in features])


def gaussian_mean(background: DataFrame, features: list[str]) -> DataFrame:
    """Generator of one draw: the mean of each step."""
    out = None
    for c in features:
        one = background.select(F.posexplode(c).alias("t", "v")).groupBy("t").agg(F.avg("v").alias("v")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias(f"g_{c}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.withColumn("draw", F.lit(0).cast("long"))


def spans(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def patch_weights(n: int, lambda_1: float = 0.0) -> list[float]:
    """How an interaction over n patches is spread over them; 0: evenly, more: to the ends."""
    w = np.exp(-lambda_1 * np.arange(n) * (n - 1 - np.arange(n)) / n)
    return (w / w.sum()).tolist()


def effects(df: DataFrame, key: str, features: list[str], model: SeriesModel, generator: DataFrame, patch_size: int, lambda_1: float = 0.0) -> DataFrame:
    """(key, feature, plain, means, inter, main) for each row and feature.

    ``plain`` is the model itself.  ``means`` are, by span (i, j) of patches, the means of the model
    with the span of the feature held and its other steps drawn.  ``inter`` are interactions, on the
    diagonal the patch's own mean less the base (mean over the diagonal), for neighbours the pair's less
    each alone plus the base, farther 2 x ((i..j + i+1..j-1) / 2 - (i..j-1 + i+1..j) / 2); ``main`` are these
    spread over the patches.  All of a row is computed within the row: nothing is shuffled.  The
    generator's draws, a number that is its parameter, come to each row as one array.
    """
    n = validate(df, features, patch_size)
    draws = generator.agg(F.sort_array(F.collect_list(F.struct("draw", *[f"g_{c}" for c in features]))).alias("__draws"))
    met = df.select(key, *features).crossJoin(F.broadcast(draws))  # one row
    each = spans(n)
    place = {x: k for k, x in enumerate(each)}

    def mean_of(c: str, i: int, j: int) -> Column:
        lo, hi = i * patch_size, (j + 1) * patch_size

        def add(total: Column, g: Column) -> Column:
            drawn = g[f"g_{c}"]
            own = F.concat(F.slice(drawn, 1, lo), F.slice(c, lo + 1, hi - lo), F.slice(drawn, hi + 1, n * patch_size - hi))
            return total + model({k: own if k == c else F.col(k) for k in features}).cast("double")

        return F.aggregate("__draws", F.lit(0.0), add) / F.size("__draws")

    wide = met.select(key, model({k: F.col(k) for k in features}).cast("double").alias("__plain"), *[F.array(*[mean_of(c, i, j) for i, j in each]).alias(f"__e_{c}") for c in features])
    at = lambda c, i, j: F.col(f"__e_{c}")[place[i, j]]

    def interaction(c: str, i: int, j: int) -> Column:
        base = sum((at(c, k, k) for k in range(n)), F.lit(0.0)) / n
        if i == j:
            return at(c, i, j) - base
        if j == i + 1:
            return at(c, i, j) - at(c, i, i) - at(c, j, j) + base
        return at(c, i, j) + at(c, i + 1, j - 1) - at(c, i, j - 1) - at(c, i + 1, j)

    wide = wide.withColumns({f"__i_{c}": F.array(*[interaction(c, i, j) for i, j in each]) for c in features})

    def main_effect(c: str, patch: int) -> Column:
        terms = [F.col(f"__i_{c}")[place[i, j]] * F.lit(patch_weights(j - i + 1, lambda_1)[patch - i]) for i, j in each if i <= patch <= j]
        return sum(terms, F.lit(0.0))

    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col("__plain").alias("plain"), F.col(f"__e_{c}").alias("means"), F.col(f"__i_{c}").alias("inter"), F.array(*[main_effect(c, p) for p in range(n)]).alias("main"))
        for c in features
    ])
    return wide.select(key, F.explode(rows).alias("x")).select(key, "x.feature", "x.plain", "x.means", "x.inter", "x.main")


def by_span(found: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """(key, feature, i, j, value) of ``means`` or ``inter``."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spans(n)])
    return found.select(key, "feature", F.explode(F.arrays_zip(each.alias("at"), F.col(column).alias("value"))).alias("x")).select(key, "feature", "x.at.i", "x.at.j", "x.value")


def by_patch(found: DataFrame, key: str) -> DataFrame:
    """(key, feature, patch, value) of ``main``."""
    return found.select(key, "feature", F.posexplode("main").alias("patch", "value"))


class TemporalExplainer:
    """Main and interaction effects of patches, for a model of one output or of several steps."""

    def __init__(self, model: SeriesModel | dict[int, SeriesModel], features: list[str], generator: Callable[[DataFrame], DataFrame] | None = None, draws: int = 10, lambda_1: float = 0.0):
        self.models = model if isinstance(model, dict) else {-1: model}
        self.features, self.draws, self.generator, self.lambda_1 = features, draws, generator, lambda_1

    def explain(self, df: DataFrame, key: str, background: DataFrame, patch_size: int = 1, only_last: bool = True) -> tuple[DataFrame, DataFrame]:
        """(main effects, interactions), with the output step t; only_last: the last step alone."""
        gen = self.generator(background) if self.generator else empirical(background, self.features, key, self.draws)
        n = validate(df, self.features, patch_size)
        main = inter = None
        for t in sorted(self.models)[-1:] if only_last else sorted(self.models):
            found = effects(df, key, self.features, self.models[t], gen, patch_size, self.lambda_1)
            rows, own = by_span(found, key, "inter", n).withColumn("t", F.lit(t)), by_patch(found, key).withColumn("t", F.lit(t))
            inter, main = (rows, own) if inter is None else (inter.unionByName(rows), main.unionByName(own))
        return main, inter


# --- A conditional generator ----------------------------------------------------------------------


def training_masks(rows: int, features: int, length: int, seed: int = 0) -> np.ndarray:
    """(rows, features, length): in each row a random span of the steps of half of the features and one is shown."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, features, length), bool)
    for mask in out:
        lo, hi = np.sort(rng.permutation(length + 1)[:2])
        mask[rng.permutation(features)[: features // 2 + 1], lo:hi] = True
    return out


@dataclass
class GaussianGenerator:
    """Series drawn from a normal distribution with the data's mean and covariance, given the steps that are held."""

    mean: np.ndarray
    cov: np.ndarray
    features: list[str]
    ridge: float = 1e-9

    @classmethod
    def fit(cls, background: DataFrame, features: list[str], most: int = 4000) -> GaussianGenerator:
        """From one pass: a partial sum of products for each task."""
        length = validate(background, features, 1)
        size = length * len(features)
        if size > most:
            raise ValueError(f"{size} steps exceed {most}; use fewer features or longer steps")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((size + 1, size + 1))
            for f in frames:
                z = np.hstack([np.ones((len(f), 1)), _flat(f, features)])
                total += z.T @ z
            yield pd.DataFrame({"i": range(size + 1), "v": list(total)})

        rows = background.select(*features).mapInPandas(run, "i int, v array<double>").groupBy("i").agg(
            F.array(*[F.sum(F.col("v")[k]) for k in range(size + 1)]).alias("v")).orderBy("i").collect()
        full = np.array([r["v"] for r in rows])
        n = max(full[0, 0], 1.0)
        mean = full[0, 1:] / n
        return cls(mean, full[1:, 1:] / n - np.outer(mean, mean), features)

    def given(self, x: np.ndarray, held: np.ndarray, draws: int = 0, rng: np.random.Generator | None = None) -> np.ndarray:
        """(rows, max(1, draws), steps): flat series whose ``held`` steps are those of x; without draws the conditional mean."""
        rest = ~held
        a = self.cov[np.ix_(held, held)] + self.ridge * np.eye(held.sum()) * max(1.0, np.trace(self.cov) / len(self.cov))
        k = np.linalg.solve(a, self.cov[np.ix_(held, rest)]).T
        out = np.repeat(x[:, None, :], max(1, draws), axis=1)
        out[:, :, rest] = (self.mean[rest] + (x[:, held] - self.mean[held]) @ k.T)[:, None, :]
        if draws:
            values, vectors = np.linalg.eigh(self.cov[np.ix_(rest, rest)] - k @ self.cov[np.ix_(held, rest)])
            noise = (rng or np.random.default_rng(0)).standard_normal((len(x), draws, rest.sum()))
            out[:, :, rest] += noise @ (vectors * np.sqrt(np.maximum(values, 0))).T
        return out

    def reconstruction_error(self, df: DataFrame, seed: int = 0) -> float:
        """Mean squared error of the steps that random masks hide, in units of their variance: 0 is perfect, 1 no better than the mean."""
        length, features, own = len(self.mean) // len(self.features), self.features, self
        variance = np.maximum(np.diag(self.cov), 1e-12)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = _flat(f, features)
                masks = training_masks(len(x), len(features), length, seed).reshape(len(x), -1)
                error = [((own.given(x[i : i + 1], m)[0, 0] - x[i]) ** 2 / variance)[~m].mean() if m.any() and not m.all() else np.nan for i, m in enumerate(masks)]
                yield pd.DataFrame({"e": error})

        return float(df.select(*features).mapInPandas(run, "e double").where("NOT isnan(e)").agg(F.avg("e")).first()[0] or 0.0)


def _flat(frame: pd.DataFrame, features: list[str]) -> np.ndarray:
    return np.hstack([np.stack(frame[c].to_numpy()).astype(float) for c in features]) if len(frame) else np.zeros((0, 0))


def conditional_means(df: DataFrame, key: str, model: Callable[[np.ndarray], np.ndarray], generator: GaussianGenerator, patch_size: int, draws: int = 0, seed: int = 0) -> DataFrame:
    """(key, feature, i, j, value): the model's mean with a span of a feature held and its other steps drawn given the span.

    The model takes series as (rows, features, steps).  Rows are independent: nothing is shuffled.
    """
    features = generator.features
    n = validate(df, features, patch_size)
    length = n * patch_size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, rng = _flat(f, features), np.random.default_rng(seed)
            parts = []
            for k, c in enumerate(features):
                own = slice(k * length, (k + 1) * length)
                for i, j in spans(n):
                    held = np.zeros(len(generator.mean), bool)
                    held[k * length + i * patch_size : k * length + (j + 1) * patch_size] = True
                    drawn = generator.given(x, held, draws, rng)
                    spliced = np.repeat(x[:, None, :], drawn.shape[1], axis=1)
                    spliced[:, :, own] = drawn[:, :, own]
                    y = np.asarray(model(spliced.reshape(-1, len(features), length)), float).reshape(len(x), -1).mean(1)
                    parts.append(pd.DataFrame({key: f[key], "feature": c, "i": i, "j": j, "value": y}))
            if parts:
                yield pd.concat(parts)

    return df.select(key, *features).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, feature string, i int, j int, value double")
