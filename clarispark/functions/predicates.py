"""Predicates, rules, ordered rule lists and unordered rule sets as DataFrame columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class Predicate:
    """A test of one feature.  op: '' (is true), 'not', '==', '!=', '<=', '>', 'null', 'notnull'.

    NULL semantics: '' is false and 'not' true; '==' is false and '!=' true; both '<=' and '>'
    are false, so a missing number belongs to neither side of a threshold.
    """

    feature: str
    op: str
    value: object = None

    def column(self) -> Column:
        c = F.col(f"`{self.feature}`")
        if self.op == "null":
            return c.isNull()
        if self.op == "notnull":
            return c.isNotNull()
        if self.op in ("", "not"):
            hit = F.coalesce(c == F.lit(self.value) if self.value is not None else c.cast("boolean"), F.lit(False))
            return hit if self.op == "" else ~hit
        if self.op == "==":
            return F.coalesce(c == F.lit(self.value), F.lit(False))
        if self.op == "!=":
            return ~F.coalesce(c == F.lit(self.value), F.lit(False))
        if self.op == "<=":
            return F.coalesce(c <= F.lit(self.value), F.lit(False))
        if self.op == ">":
            return F.coalesce(c > F.lit(self.value), F.lit(False))
        raise ValueError(f"unknown op {self.op!r}")

    def __str__(self) -> str:
        if self.op == "not":
            return f"NOT {self.feature}"
        if self.op == "":
            return self.feature
        if self.op in ("null", "notnull"):
            return f"{self.feature} {'==' if self.op == 'null' else '!='} NaN"
        return f"{self.feature} {self.op} {self.value:g}" if isinstance(self.value, float) else f"{self.feature} {self.op} {self.value}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; no conditions: matches everything."""

    conditions: tuple[Predicate, ...]
    label: object = 1

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.conditions), F.lit(True))

    def __len__(self) -> int:
        return len(self.conditions)

    def __str__(self) -> str:
        return " AND ".join(sorted(map(str, self.conditions))) or "TRUE"


@dataclass
class RuleList:
    """Ordered rules: the first that matches decides, else the default."""

    rules: list[Rule] = field(default_factory=list)
    default: object = 0

    def predict_column(self) -> Column:
        chain = None
        for r in self.rules:  # one flat chain: short plans for long lists
            chain = F.when(r.column(), F.lit(r.label)) if chain is None else chain.when(r.column(), F.lit(r.label))
        return F.lit(self.default) if chain is None else chain.otherwise(F.lit(self.default))

    def matched_rule(self) -> Column:
        """Number of the rule that fires; -1: the default."""
        chain = None
        for i, r in enumerate(self.rules):
            chain = F.when(r.column(), F.lit(i)) if chain is None else chain.when(r.column(), F.lit(i))
        return F.lit(-1) if chain is None else chain.otherwise(F.lit(-1))

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return df.withColumn(to, self.predict_column())

    def render(self) -> list[str]:
        words = [f"{'IF' if i == 0 else 'ELIF'} {r} THEN {r.label}" for i, r in enumerate(self.rules)]
        return [*words, f"ELSE {self.default}" if words else f"{self.default}"]


@dataclass
class RuleSet:
    """Unordered rules for the positive label: a row is positive if any of them matches."""

    rules: list[Rule] = field(default_factory=list)
    positive: object = 1
    negative: object = 0

    def any_column(self) -> Column:
        return reduce(lambda a, b: a | b, (r.column() for r in self.rules), F.lit(False))

    def predict_column(self) -> Column:
        return F.when(self.any_column(), F.lit(self.positive)).otherwise(F.lit(self.negative))

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return df.withColumn(to, self.predict_column())

    def render(self) -> list[str]:
        return [*[f"IF {r} THEN {self.positive}" for r in self.rules], f"ELSE {self.negative}"]


def save_rules(rules: RuleList | RuleSet, path: str) -> None:
    """Writes the rendered rules to a text file of the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rules.render()) + "\n")
