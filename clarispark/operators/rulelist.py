"""Ordered rule lists for any number of classes, by greedy insertion and local search on signatures."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from clarispark.functions.predicates import Rule, RuleList
from clarispark.operators.binarize import FeatureBinarizer, process_input
from clarispark.operators.prep import check_default
from clarispark.operators.signatures import Signatures, additive, covered, grow, signatures


@dataclass
class RuleListLearner:
    """Maximises rows labelled right, less ``complexity`` per condition; a deterministic search."""

    complexity: float = 1.0
    max_rules: int = 20
    max_len: int | None = None
    max_rounds: int = 30
    num_thresh: int = 9
    negation: bool = True
    categorical: list[str] = field(default_factory=list)
    binarize: bool = True
    most_predicates: int | None = None
    model: RuleList | None = None

    def fit(self, df: DataFrame, features: list[str], label: str, default=None) -> RuleListLearner:
        binarizer = FeatureBinarizer(self.categorical, self.num_thresh, self.negation) if self.binarize else None
        df, predicates = process_input(df, features, label, binarizer, is_fit=True)
        default = check_default(df, label, default)
        self.sig = signatures(df, predicates, label, self.most_predicates)
        rules = self._search(self.sig, self.sig.labels.index(default))
        self.model = RuleList([Rule(tuple(self.sig.pool[j] for j in items), self.sig.labels[k]) for items, k in rules], default)
        return self

    def objective(self, sig: Signatures, rules: list, default: int) -> float:
        free, right = np.ones(len(sig.truth), bool), 0.0
        for items, k in rules:
            hit = free & covered(sig, items)
            right += sig.counts[hit, k].sum()
            free &= ~hit
        return right + sig.counts[free, default].sum() - self.complexity * sum(len(i) for i, _ in rules)

    def _best_insert(self, sig: Signatures, rules: list, default: int) -> tuple[float, list]:
        """For each position and label: A gains rows not covered before; what later rules label right is lost."""
        now, best = self.objective(sig, rules, default), (0.0, rules)
        free = np.ones(len(sig.truth), bool)
        for at in range(len(rules) + 1):
            if at:
                free = free & ~covered(sig, rules[at - 1][0])
            right, rest = np.zeros(len(sig.truth)), free.copy()
            for items, k in rules[at:]:
                hit = rest & covered(sig, items)
                right[hit] = sig.counts[hit, k]
                rest &= ~hit
            right[rest] = sig.counts[rest, default]
            for k in range(len(sig.labels)):
                change = np.where(free, sig.counts[:, k] - right, 0.0)
                items, gain = grow(sig, *additive(change, self.complexity), self.max_len)
                if items and gain > best[0] + 1e-9:
                    new = [*rules[:at], (items, k), *rules[at:]]
                    best = (self.objective(sig, new, default) - now, new)
        return best

    def _search(self, sig: Signatures, default: int) -> list:
        rules: list = []
        for _ in range(self.max_rounds):
            before = self.objective(sig, rules, default)
            if len(rules) < self.max_rules:
                gain, new = self._best_insert(sig, rules, default)
                if gain > 1e-9:
                    rules = new
            for at in range(len(rules)):  # swap neighbours, delete, replace
                for new in ([*rules[:at], *rules[at + 1 :]], [*rules[:at], *reversed(rules[at : at + 2]), *rules[at + 2 :]]):
                    if self.objective(sig, new, default) > self.objective(sig, rules, default) + 1e-9:
                        rules = new
                        break
            if self.objective(sig, rules, default) <= before + 1e-9:
                for at in range(len(rules)):
                    rest = [*rules[:at], *rules[at + 1 :]]
                    gain, new = self._best_insert(sig, rest, default)
                    if self.objective(sig, new, default) > before + 1e-9:
                        rules = new
                        break
                else:
                    break
        return rules

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return self.model.predict(df, to)

    def show(self) -> list[str]:
        return self.model.render()
