"""Scores of a pattern from a (positives covered), b (negatives covered), P and N (positives, all rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = ("risk", "diffScore", "rep", "rep*")


def score(kind: str, a: Column, b: Column, p: Column, n: Column) -> Column:
    """risk: share of positives inside over that outside; diffScore: F1; rep: (a - b) / (a + b); rep*: rep times risk.

    An empty pattern scores NULL.
    """
    a, b, p, n = (x.cast("double") for x in (a, b, p, n))
    c, d = p - a, n - p - b
    risk = F.try_divide(F.try_divide(a, a + b), (c + F.lit(1e-4)) / (c + d + F.lit(1e-4)))
    rep = F.try_divide(a - b, a + b)
    if kind == "risk":
        return risk
    if kind == "diffScore":
        precision, recall = F.try_divide(a, a + b), F.try_divide(a, p)
        return F.try_divide(2 * precision * recall, precision + recall)
    if kind == "rep":
        return rep
    if kind == "rep*":
        return rep * risk
    raise ValueError(f"unknown score {kind!r}; one of {SCORES}")
