"""Feature attribution: Shapley values, integrated gradients and local surrogates.

A model is a function of {feature: Column} to a Column (stays in the JVM), or a function of a
pandas DataFrame to an array (Arrow batches).  Results are columns or long tables by row key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate, Rule
from clarispark.operators.mining import tree_paths

ColumnModel = Callable[[dict[str, Column]], Column]
MAX_EXACT = 12


def background_mean(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    return {c: float(row[c]) for c in features}


def shap_linear(df: DataFrame, coefficients: dict[str, float], baseline: dict[str, float | Column]) -> DataFrame:
    """coef x (value - baseline) in a column ``<feature>__shap``; the baseline is a mean (whole background) or a column (matched row)."""
    of = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    return df.withColumns({f"{c}__shap": F.lit(float(k)) * (F.col(f"`{c}`").cast("double") - of(baseline[c])) for c, k in coefficients.items()})


def shap_exact(df: DataFrame, model: ColumnModel, features: list[str], baseline: dict[str, float | Column], link: str = "identity") -> DataFrame:
    """Exact Shapley values against one baseline per row, over all coalitions (at most MAX_EXACT features), as columns."""
    n = len(features)
    if n > MAX_EXACT:
        raise ValueError(f"{n} features; exact values are for {MAX_EXACT} at most: use shap_sampled")
    of = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    base = {c: of(baseline[c]) for c in features}
    linked = (lambda v: F.log(v / (1 - v))) if link == "logit" else (lambda v: v)
    values = {}
    for size in range(n + 1):
        for s in itertools.combinations(range(n), size):
            values[s] = f"__v{'_'.join(map(str, s))}"
    wide = df.withColumns({name: linked(model({c: F.col(f"`{c}`").cast("double") if i in s else base[c] for i, c in enumerate(features)})) for s, name in values.items()})
    out = {}
    for i, c in enumerate(features):
        terms = []
        for s, name in values.items():
            if i not in s:
                w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                terms.append(F.lit(w) * (F.col(values[tuple(sorted((*s, i)))]) - F.col(name)))
        out[f"{c}__shap"] = sum(terms[1:], terms[0])
    return wide.withColumns(out).drop(*values.values())


def _outputs(y, rows: int) -> np.ndarray:
    """A model's results as (rows, classes)."""
    out = np.asarray(y, float)
    return out.reshape(rows, -1)


def _long(key: str, keys, names: list[str], values: np.ndarray) -> pd.DataFrame:
    """(rows, features, classes) in long form."""
    n, f, k = values.shape
    return pd.DataFrame({key: np.repeat(np.asarray(keys), f * k), "feature": np.tile(np.repeat(names, k), n), "class": np.tile(np.arange(k), n * f), "value": values.ravel()})


def _distinct(x: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of doubles, the place of each row among them, and how often each is there."""
    place = np.zeros(len(x), np.int64)
    for j in range(x.shape[1]):
        own = np.unique(np.ascontiguousarray(x[:, j]).view(np.int64), return_inverse=True)[1]
        place = np.unique(place * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return x[np.unique(place, return_index=True)[1]], place, np.bincount(place, times)


def shap_sampled(df: DataFrame, key: str, model: Callable[[pd.DataFrame], np.ndarray], features: list[str], background: DataFrame | pd.DataFrame, permutations: int = 32, seed: int = 0, link: str = "identity", cells: int = 2_000_000) -> DataFrame:
    """(key, feature, class, value) by sampled permutations against a background table, for any number of features and classes.

    Each permutation is taken with its reverse, so effects of single features and of pairs are
    exact.  The model is asked for each coalition about the distinct values that a part of the rows
    has in it, beside the distinct values that a block of the background has in the other features,
    in calls of about ``cells`` cells at most.  A pandas background travels with the tasks.  One of
    Spark has any size: rows are dealt to groups, and each group reads the background as a stream.
    """
    m = len(features)
    rng = np.random.default_rng(seed)
    orders = [o for _ in range(max(1, -(-permutations // 2))) for p in (rng.permutation(m),) for o in (p, p[::-1])]
    gains: dict[tuple, np.ndarray] = {}  # how often a coalition's value is added to each feature's, or taken from it
    for order in orders:
        for i, j in enumerate(order):
            for coalition, sign in ((order[:i], -1), (order[: i + 1], 1)):
                gains.setdefault(tuple(np.isin(range(m), coalition).tolist()), np.zeros(m))[j] += sign
    whole = gains.pop((True,) * m)
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, feature string, class int, value double"

    def f(x: np.ndarray) -> np.ndarray:
        out = _outputs(model(pd.DataFrame(x, columns=features)), len(x))
        return np.log(out / (1 - out)) if link == "logit" else out

    def plus(total: np.ndarray | None, values: np.ndarray, gain: np.ndarray) -> np.ndarray:
        total = np.zeros((len(values), m, values.shape[1])) if total is None else total
        for j in np.flatnonzero(gain):
            total[:, j] += gain[j] * values
        return total

    def met(total: np.ndarray | None, x: np.ndarray, z: np.ndarray, times: np.ndarray) -> np.ndarray:
        """total and what a block of the background adds to it, by all coalitions but the whole."""
        for coalition, gain in gains.items():
            own = np.array(coalition, bool)
            xs, place, _ = _distinct(x[:, own])
            zs, _, n = _distinct(z[:, ~own], times)
            wide = min(len(zs), max(1, cells // m))
            tall = max(1, cells // (wide * m))
            sums = []
            for at in range(0, len(xs), tall):
                mine, v = xs[at : at + tall], 0.0
                for to in range(0, len(zs), wide):
                    theirs = zs[to : to + wide]
                    mixed = np.empty((len(mine), len(theirs), m))
                    mixed[:, :, own], mixed[:, :, ~own] = mine[:, None], theirs
                    v = v + n[to : to + wide] @ f(mixed.reshape(-1, m)).reshape(len(mine), len(theirs), -1)
                sums.append(v)
            total = plus(total, np.concatenate(sums)[place], gain)
        return total

    def ended(total: np.ndarray, x: np.ndarray, size: float) -> np.ndarray:
        step = max(1, cells // m)
        own = np.concatenate([f(x[at : at + step]) for at in range(0, len(x), step)])
        return plus(total, own, whole * size) / (size * len(orders))

    def numbers(batches: list[pa.RecordBatch], first: int) -> np.ndarray:
        """All columns from the first one on."""
        return np.concatenate([np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[first:]]) for b in batches])

    def long(keys: pa.Array, times: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, rows = values.shape[2], np.repeat(np.arange(len(values)), times.astype(int))
        step = max(1, 100_000 // (m * k))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            each = np.tile(np.repeat(np.arange(m), k), len(part))
            columns = [keys.take(pa.array(np.repeat(part, m * k))), pa.array(features).take(pa.array(each)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(part) * m)), pa.array(values[part].ravel())]
            yield pa.RecordBatch.from_arrays(columns, [key, "feature", "class", "value"])

    names = [f"__f{i}" for i in range(m)]
    doubles = [F.col(f"`{c}`").cast("double").alias(a) for c, a in zip(features, names, strict=True)]
    keyed = df.select(F.col(f"`{key}`").alias("__key"), *doubles)
    if isinstance(background, pd.DataFrame):
        rows = background[features].to_numpy(float)
        if not len(rows):
            raise ValueError("the background has no rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, cells // (200 * m))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = numbers([part], 1)
                    yield from long(part.column(0), np.ones(len(x)), ended(met(None, x, rows, np.ones(len(rows))), x, len(rows)))

        return keyed.mapInArrow(run, schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each group come before its background."""
        group, mine, block, waiting, size, x, total = None, [], [], 0, 0.0, None, None

        def read() -> None:
            nonlocal block, waiting, size, x, total
            x = numbers(mine, 3) if x is None else x
            z = numbers(block, 3)
            total, size = met(total, x[:, :m], z[:, :m], z[:, m]), size + z[:, m].sum()
            block, waiting = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if block:
                read()
            if mine and not size:
                raise ValueError("the background has no rows")
            if mine:
                yield from long(pa.concat_arrays([b.column(2) for b in mine]), x[:, m], ended(total, x[:, :m], size))

        for batch in batches:
            of, second = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(second) != 0)) + 1).tolist(), len(of)]
            for a, b in itertools.pairwise(cuts):
                if a < b and of[a] != group:
                    yield from close()
                    group, mine, block, waiting, size, x, total = of[a], [], [], 0, 0.0, None, None
                if a < b and not second[a]:
                    mine.append(batch.slice(a, b - a))
                elif a < b and mine:
                    block.append(batch.slice(a, b - a))
                    waiting += b - a
                    if waiting * m >= cells:
                        read()
        yield from close()

    groups = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-20 * m * df.count() // cells))
    ours = keyed.groupBy("__key", *names).agg(F.count(F.lit(1)).alias("__n"))
    ours = ours.select(F.pmod(F.xxhash64("__key", *names), F.lit(groups)).cast("int").alias("__group"), F.lit(0).alias("__second"), "__key", *names, "__n")
    theirs = background.select(*doubles).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    theirs = theirs.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"), F.lit(1).alias("__second"), F.lit(None).cast(kind).alias("__key"), *names, "__n")
    return ours.unionByName(theirs).repartition(groups, "__group").sortWithinPartitions("__group", "__second", *names).mapInArrow(stream, schema)


def shap_tree(df: DataFrame, key: str, ensemble: TreeEnsemble, features: list[str], background: DataFrame | pd.DataFrame | None = None, matched: dict[str, str] | None = None) -> DataFrame:
    """(key, feature, class, value): exact Shapley values of fitted trees, whatever the number of features.

    A leaf is reached by a mixture of a row and a baseline row only if each feature on its path
    suits one of the two.  With a features that only the row suits and b that only the baseline
    does, the leaf's weight is shared by (a - 1)! b! / (a + b)! among the first and taken by
    a! (b - 1)! / (a + b)! from the second.  Baselines: every row of ``background`` in turn (the
    mean counts), or for each row its own, in the columns that ``matched`` names by feature.  A
    background of any size is counted where it lies: a leaf needs only how many of its rows suit
    which of the features on its path.
    """
    if (background is None) == (matched is None):
        raise ValueError("give a background table or matched columns")
    place = {c: i for i, c in enumerate(features)}
    leaves = []
    for conditions, weight in ensemble.leaves:
        own = sorted({p.feature for p in conditions})
        leaves.append(([place[c] for c in own], [[(p.op, float(p.value)) for p in conditions if p.feature == c] for c in own], weight))
    deepest = max((len(own) for own, *_ in leaves), default=0)
    share = np.zeros((deepest + 2, deepest + 2))  # share[a, b]: (a - 1)! b! / (a + b)!
    for i in range(1, deepest + 1):
        for j in range(deepest + 1 - i):
            share[i, j] = math.factorial(i - 1) * math.factorial(j) / math.factorial(i + j)

    def suits(x: np.ndarray, own: list[int], tests: list) -> np.ndarray:
        out = np.ones((len(x), len(own)), bool)
        for k, (j, several) in enumerate(zip(own, tests, strict=True)):
            for op, value in several:
                out[:, k] &= x[:, j] <= value if op == "<=" else x[:, j] > value
        return out

    def kinds_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(leaf, kind, n): baselines that suit alike count together."""
        for frame in frames:
            z = frame[features].to_numpy(float)
            for leaf, (own, tests, _) in enumerate(leaves):
                if own and len(z):
                    kinds, n = np.unique(suits(z, own, tests), axis=0, return_counts=True)
                    yield pd.DataFrame({"leaf": leaf, "kind": [k.tobytes() for k in kinds], "n": n})

    if isinstance(background, DataFrame):
        doubles = background.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features])
        found = doubles.mapInPandas(kinds_of, "leaf int, kind binary, n long").groupBy("leaf", "kind").agg(F.sum("n").alias("n")).collect()
    else:
        found = [] if background is None else [r for f in kinds_of(iter([background])) for r in f.to_dict("records")]
    counted: list[list[tuple[np.ndarray, int]]] = [[] for _ in leaves]
    for r in sorted(found, key=lambda r: (r["leaf"], bytes(r["kind"]))):
        counted[r["leaf"]].append((np.frombuffer(bytes(r["kind"]), bool), r["n"]))
    if background is not None and deepest and not found:
        raise ValueError("the background has no rows")
    size = max((sum(n for _, n in c) for c in counted), default=0)

    def contributions(mine: np.ndarray, theirs: np.ndarray, weight: float) -> np.ndarray:
        """Rows beside their baselines, (rows, own features) each."""
        live = (mine | theirs).all(1)
        a, b = (mine & ~theirs).sum(1), (theirs & ~mine).sum(1)
        return weight * live[:, None] * ((mine & ~theirs) * share[a, b][:, None] - (theirs & ~mine) * share[b, a][:, None])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[features].to_numpy(float)
            total = np.zeros((len(x), len(features), 1))
            for (own, tests, weight), kinds in zip(leaves, counted, strict=True):
                if not own:
                    continue
                mine = suits(x, own, tests)
                if matched is not None:
                    total[:, own, 0] += contributions(mine, suits(frame[[f"__m_{c}" for c in features]].to_numpy(float), own, tests), weight)
                for kind, times in kinds:
                    total[:, own, 0] += contributions(mine, np.broadcast_to(kind, mine.shape), weight * times)
            yield _long(key, frame[key], features, total / (size or 1))

    kind = dict(df.dtypes)[key]
    named = df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in features], *[F.col(f"`{m}`").cast("double").alias(f"__m_{c}") for c, m in (matched or {}).items()])
    return named.mapInPandas(run, f"`{key}` {kind}, feature string, class int, value double")


@dataclass
class TreeEnsemble:
    """The leaves of fitted trees as (conditions, weight); their weights where the conditions hold add up to the prediction."""

    leaves: list[tuple[tuple[Predicate, ...], float]]

    @classmethod
    def of(cls, model, features: list[str]) -> TreeEnsemble:
        """A fitted MLlib tree, forest or boosted regressor over numeric features."""
        trees = list(getattr(model, "trees", [model]))
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        if type(model).__name__.startswith("RandomForest"):
            weights = [1.0 / len(trees)] * len(trees)
        return cls([(path, value * w) for tree, w in zip(trees, weights, strict=True) for path, value in tree_paths(tree, features)])

    def column(self) -> Column:
        """The prediction as a column."""
        return sum((F.when(Rule(path).column(), F.lit(w)).otherwise(F.lit(0.0)) for path, w in self.leaves), F.lit(0.0))


def shap_tree_rules(df: DataFrame, rules: list, features: list[str], baseline: dict[str, float]) -> DataFrame:
    """Exact values of an additive ensemble of (rule, weight): each rule's Shapley value over its own features only, added up."""
    out = df
    for rule, weight in rules:
        own = sorted({p.feature for p in rule.conditions})

        def model(cols: dict[str, Column], rule=rule, weight=weight) -> Column:
            hit = F.lit(True)
            for p in rule.conditions:
                c = cols[p.feature]
                hit = hit & F.coalesce((c <= F.lit(p.value)) if p.op == "<=" else (c > F.lit(p.value)) if p.op == ">" else (c == F.lit(p.value)), F.lit(False))
            return F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))

        part = shap_exact(out, model, own, baseline)
        out = part.withColumns({f"{c}__sum": (F.col(f"{c}__sum") if f"{c}__sum" in out.columns else F.lit(0.0)) + F.col(f"{c}__shap") for c in own}).drop(*[f"{c}__shap" for c in own])
    for c in features:
        out = out.withColumn(f"{c}__shap", F.col(f"{c}__sum") if f"{c}__sum" in out.columns else F.lit(0.0)).drop(f"{c}__sum")
    return out


def quadrature(steps: int = 50, method: str = "gausslegendre") -> list[tuple[float, float]]:
    """(point, weight) on [0, 1]."""
    if method == "gausslegendre":
        x, w = np.polynomial.legendre.leggauss(steps)
        return [((a + 1) / 2, b / 2) for a, b in zip(x.tolist(), w.tolist(), strict=True)]
    if method == "riemann":
        return [(float(a), 1.0 / steps) for a in np.linspace(0, 1, steps)]
    raise ValueError(f"unknown method {method!r}")


def integrated_gradients(df: DataFrame, gradient: Callable[[dict[str, Column]], dict[str, Column]], features: list[str], baseline: dict[str, float | Column] | None = None, steps: int = 50, method: str = "gausslegendre") -> DataFrame:
    """(value - baseline) x mean gradient along the way, in a column ``<feature>__ig``; no baseline: zeros.

    The points are a literal array, and the integral a fold over it within the row: no join, no shuffle.
    """
    of = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    base = {c: of((baseline or {}).get(c, 0.0)) for c in features}
    points = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(w).alias("w")) for a, w in quadrature(steps, method)])
    def mean_gradient(c: str) -> Column:
        def term(acc: Column, p: Column) -> Column:
            at = {k: base[k] + p["a"] * (F.col(f"`{k}`").cast("double") - base[k]) for k in features}
            return acc + p["w"] * gradient(at)[c]

        return F.aggregate(points, F.lit(0.0), term)

    out = {f"{c}__ig": (F.col(f"`{c}`").cast("double") - base[c]) * mean_gradient(c) for c in features}
    return df.withColumns(out)


def completeness(df: DataFrame, model: ColumnModel, features: list[str], baseline: dict[str, float], suffix: str = "__ig") -> float:
    """mean(|sum of attributions - change of the model| / (|change| + 1e-7)) over all rows."""
    change = model({c: F.col(f"`{c}`").cast("double") for c in features}) - model({c: F.lit(float(baseline[c])) for c in features})
    total = sum((F.col(f"`{c}{suffix}`") for c in features), F.lit(0.0))
    return float(df.agg(F.avg(F.abs(total - change) / (F.abs(change) + F.lit(1e-7)))).first()[0])


def lime_tabular(df: DataFrame, key: str, model: Callable[[pd.DataFrame], np.ndarray], features: list[str], background: DataFrame, samples: int = 500, kernel_width: float | None = None, ridge: float = 1e-3, seed: int = 0, cells: int = 2_000_000) -> DataFrame:
    """(key, feature, class, value): weights of a ridge regression fitted around each row.

    Neighbours are drawn with the background's deviations and weighed by distance in those units.
    The draws are the same around each row, so one factorisation serves all rows, and rows of a
    batch go to the model together, about ``cells`` cells at a time.
    """
    stats = background.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in features]).first()
    scale = np.array([float(stats[c] or 0) or 1.0 for c in features])
    width = kernel_width or 0.75 * math.sqrt(len(features))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = np.random.default_rng(seed).standard_normal((samples, len(features)))
        z[0] = 0
        near = np.exp(-(z**2).sum(1) / width**2)
        d = np.hstack([np.ones((samples, 1)), z])
        solve = np.linalg.solve((d * near[:, None]).T @ d + ridge * np.diag([0.0, *[1.0] * len(features)]), (d * near[:, None]).T)[1:]  # (features, samples)
        step = max(1, cells // (samples * len(features)))
        for frame in frames:
            for at in range(0, len(frame), step):
                x = frame[features].iloc[at : at + step].to_numpy(float)
                y = _outputs(model(pd.DataFrame((x[:, None, :] + z * scale).reshape(-1, len(features)), columns=features)), len(x) * samples)
                beta = np.einsum("fs,nsk->nfk", solve, y.reshape(len(x), samples, -1)) / scale[None, :, None]
                yield _long(key, frame[key].iloc[at : at + step], features, beta)

    kind = dict(df.dtypes)[key]
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, f"`{key}` {kind}, feature string, class int, value double")


def lime_text(df: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], samples: int = 200, ridge: float = 1e-2, seed: int = 0) -> DataFrame:
    """(key, token, value): how a text's distinct words move the model when they are left out at random.

    A text of more distinct words than samples is solved in the space of the samples, which gives
    the same weights from a matrix of that size.
    """
    def weights(words: list[str], tokens: list[str]) -> np.ndarray:
        keep = np.random.default_rng(seed).random((samples, len(tokens))) < 0.5
        keep[0] = True
        at = {w: i for i, w in enumerate(tokens)}
        place = np.array([at[w] for w in words])
        own = np.array(words, object)
        y = np.asarray(model([" ".join(own[row[place]]) for row in keep]), float).ravel()
        near = np.sqrt(np.exp(-((1 - keep.mean(1)) ** 2) / 0.25))
        # The constant isn't shrunk: its part is taken out first.
        d, t = keep * near[:, None], y * near
        ones = near / np.sqrt(near @ near)
        d, t = d - np.outer(ones, ones @ d), t - ones * (ones @ t)
        if len(tokens) <= samples:
            return np.linalg.solve(d.T @ d + ridge * np.eye(len(tokens)), d.T @ t)
        return d.T @ np.linalg.solve(d @ d.T + ridge * np.eye(samples), t)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for k, t in zip(frame[key], frame[text], strict=True):
                words = (t or "").split()
                tokens = sorted(set(words))
                if tokens:
                    found.append((k, tokens, weights(words, tokens)))
            if found:
                yield pd.DataFrame({key: np.repeat([k for k, *_ in found], [len(t) for _, t, _ in found]), "token": [w for _, t, _ in found for w in t], "value": np.concatenate([v for *_, v in found])})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, token string, value double")


def of_class(values: DataFrame, k: int) -> DataFrame:
    """One class of a long attribution table; an unknown class is an error."""
    if values.where(F.col("class") == k).isEmpty():
        raise ValueError(f"no class {k}")
    return values.where(F.col("class") == k)


def importance(values: DataFrame, value: str = "value") -> DataFrame:
    """(feature, importance): mean absolute attribution, as a bar plot shows it."""
    return values.groupBy("feature").agg(F.avg(F.abs(value)).alias("importance"))
