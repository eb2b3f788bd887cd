"""Rows compressed to signatures over a pool of predicates: what the rule learners search on.

Rows never reach the driver: they are grouped by the truth of the pool's predicates and the
label, and only the groups, of a checked number, are collected.  Searches are exact: conjunctions
are grown depth first and a branch ends only where no longer conjunction can be better.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate


@dataclass
class Signatures:
    pool: list[Predicate]
    truth: np.ndarray  # (groups, predicates)
    labels: list
    counts: np.ndarray  # (groups, labels)


def best_predicates(df: DataFrame, predicates: list[Predicate], label: str, most: int | None) -> list[Predicate]:
    """The predicates that tell labels apart best, by information gain from one pass of conditional counts; None: all."""
    if most is None or len(predicates) <= most:
        return predicates
    rows: dict[str, dict] = {}
    for at in range(0, len(predicates), 200):
        part = predicates[at : at + 200]
        for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(p.column().cast("int")).alias(f"p{at + i}") for i, p in enumerate(part)]).collect():
            rows.setdefault(str(r[0]), {}).update(r.asDict())
    n = np.array([r["n"] for r in rows.values()], float)
    entropy = lambda c: -(c * np.log(np.maximum(c, 1e-12) / max(c.sum(), 1e-12))).sum()
    gain = []
    for i in range(len(predicates)):
        hit = np.array([r[f"p{i}"] for r in rows.values()], float)
        gain.append(entropy(n) - entropy(hit) - entropy(n - hit))
    order = sorted(range(len(predicates)), key=lambda i: (-round(gain[i], 6), str(predicates[i])))
    return [predicates[i] for i in sorted(order[:most])]


def signatures(df: DataFrame, predicates: list[Predicate], label: str, most_predicates: int | None = None, most_groups: int = 500_000) -> Signatures:
    pool = best_predicates(df, predicates, label, most_predicates)
    bits = [F.when(p.column(), F.lit(1 << (i % 62)).cast("long")).otherwise(F.lit(0).cast("long")) for i, p in enumerate(pool)]
    words = [sum(bits[k : k + 62][1:], bits[k]).alias(f"__s{k // 62}") for k in range(0, len(bits), 62)] or [F.lit(0).cast("long").alias("__s0")]
    grouped = df.where(F.col(label).isNotNull()).select(*words, F.col(label).alias("__l")).groupBy(*[f"__s{k}" for k in range(len(words))], "__l").count()
    rows = grouped.limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"over {most_groups} signatures; use fewer predicates or raise the bound")
    labels = sorted({r["__l"] for r in rows})
    keys = sorted({tuple(r[f"__s{k}"] for k in range(len(words))) for r in rows})
    at = {k: i for i, k in enumerate(keys)}
    counts = np.zeros((len(keys), len(labels)))
    for r in rows:
        counts[at[tuple(r[f"__s{k}"] for k in range(len(words)))], labels.index(r["__l"])] += r["count"]
    truth = np.array([[bool(k[i // 62] >> (i % 62) & 1) for i in range(len(pool))] for k in keys], bool).reshape(len(keys), len(pool))
    return Signatures(pool, truth, labels, counts)


#: Conjunctions that one search may extend; more raise an error.
MAX_NODES = 400_000


def grow(sig: Signatures, vectors: np.ndarray, gain: Callable, bound: Callable, max_len: int | None = None, most_nodes: int = MAX_NODES) -> tuple[tuple[int, ...], float]:
    """The conjunction with the largest gain, of equals the shortest and then the first; ((), 0) if none is above 0.

    ``vectors`` (k, groups) are weights of the groups; of those a conjunction covers, gain(sums, length)
    is made from their sums, and bound(sums, length) is at least the gain of any conjunction that extends
    it to that length or more.  Both take the sums of several conjunctions at once, as (k, n).
    """
    best: tuple[int, tuple[int, ...]] = (0, ())
    value, nodes = 0.0, 0
    truth = sig.truth
    stack = [((), np.arange(len(truth)))]
    while stack:
        items, rows = stack.pop()
        nodes += 1
        if nodes > most_nodes:
            raise ValueError(f"the search extends over {most_nodes} conjunctions; use fewer predicates, a bound on their number (most_predicates) or on the length")
        length = len(items) + 1
        inside = truth[rows]
        sums, held = vectors[:, rows] @ inside, inside.sum(0)
        new = (held > 0) & (held < len(rows)) if items else held > 0
        gains = np.where(new, gain(sums, length), -np.inf)
        for j in np.flatnonzero(gains > value - 1e-9):
            found = (length, tuple(sorted((*items, int(j)))))
            if gains[j] > value + 1e-9 or (gains[j] > 1e-9 and best[1] and found < best):
                best, value = found, max(value, float(gains[j]))
        if max_len is not None and length >= max_len:
            continue
        limit = np.where(new, bound(sums, length + 1), -np.inf)
        after = np.flatnonzero(limit > value + 1e-9)
        after = after[after > items[-1]] if items else after  # each conjunction once, in the order of its predicates
        for j in after[np.argsort(limit[after], kind="stable")]:  # the most promising is popped first
            stack.append(((*items, int(j)), rows[inside[:, j]]))
    return best[1], value


def additive(change: np.ndarray, per_item: float) -> tuple[np.ndarray, Callable, Callable]:
    """vectors, gain and bound for the sum of change over the covered groups, less per_item for each condition."""
    return np.stack([change, np.maximum(change, 0)]), lambda s, n: s[0] - per_item * n, lambda s, n: s[1] - per_item * n


def covered(sig: Signatures, items: tuple[int, ...]) -> np.ndarray:
    return sig.truth[:, list(items)].all(1) if items else np.ones(len(sig.truth), bool)
