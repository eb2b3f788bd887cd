"""Unordered rule sets for two classes: by weighted errors, and for rare positives by F1."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from clarispark.functions.predicates import Rule, RuleSet
from clarispark.operators.binarize import FeatureBinarizer, process_input
from clarispark.operators.prep import binary_labels
from clarispark.operators.signatures import additive, covered, grow, signatures

#: How many times a covered negative counts in the searches that look for exact rules first.
STRICT = (3, 8)


def _times(sig, rules: list[tuple[int, ...]]) -> np.ndarray:
    """How many rules cover each signature."""
    return sum((covered(sig, r).astype(int) for r in rules), np.zeros(len(sig.truth), int))


@dataclass
class RuleSetLearner:
    """Minimises beta_pos x missed positives + beta_neg x covered negatives + beta_diverse x repeated cover + beta_complex x conditions."""

    max_num_rules: int = 16
    beta_pos: float = 1.0
    beta_neg: float = 1.0
    beta_diverse: float = 0.1
    beta_complex: float = 0.1
    max_len: int | None = None
    num_thresh: int = 9
    negation: bool = True
    categorical: list[str] = field(default_factory=list)
    binarize: bool = True
    most_predicates: int | None = None
    model: RuleSet | None = None

    def fit(self, df: DataFrame, features: list[str], label: str) -> RuleSetLearner:
        negative, positive = binary_labels(df, label)
        binarizer = FeatureBinarizer(self.categorical, self.num_thresh, self.negation) if self.binarize else None
        df, predicates = process_input(df, features, label, binarizer, is_fit=True)
        sig = signatures(df, predicates, label, self.most_predicates)
        pos, neg = sig.counts[:, sig.labels.index(positive)], sig.counts[:, sig.labels.index(negative)]
        # Broad rules found first can block the exact ones, so searches that begin with exact rules are run beside the plain one.
        starts = [[], *[self._search(sig, pos, times * neg, []) for times in STRICT]]
        found = [self._search(sig, pos, neg, start) for start in starts]
        chosen = min(found, key=lambda rs: self.value(sig, rs, pos, neg))
        self.model = RuleSet([Rule(tuple(sig.pool[j] for j in items), positive) for items in chosen], positive, negative)
        return self

    def loss(self, times: np.ndarray, length: int, pos: np.ndarray, neg: np.ndarray) -> float:
        """times: how many rules cover each signature."""
        hit = times > 0
        again = np.maximum(times - 1, 0) * (pos + neg)
        return self.beta_pos * pos[~hit].sum() + self.beta_neg * neg[hit].sum() + self.beta_diverse * again.sum() + self.beta_complex * length

    def search(self, times: np.ndarray, length: int, pos: np.ndarray, neg: np.ndarray) -> tuple:
        """vectors, gain and bound of one more rule."""
        free = times == 0
        return additive(np.where(free, self.beta_pos * pos - self.beta_neg * neg, -self.beta_diverse * (pos + neg)), self.beta_complex)

    def value(self, sig, rules: list[tuple[int, ...]], pos: np.ndarray, neg: np.ndarray) -> float:
        return self.loss(_times(sig, rules), sum(map(len, rules)), pos, neg)

    def _search(self, sig, pos: np.ndarray, neg: np.ndarray, start: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """Adds, removes and replaces rules from ``start`` on until nothing improves."""
        rules = list(start)
        value = lambda rs: self.value(sig, rs, pos, neg)

        def added(rs: list) -> list:
            items, _ = grow(sig, *self.search(_times(sig, rs), sum(map(len, rs)), pos, neg), self.max_len)
            return [*rs, items] if items else rs

        while True:
            before = value(rules)
            if len(rules) < self.max_num_rules:
                rules = added(rules)
            for r in list(rules):
                rest = [x for x in rules if x is not r]
                if value(rest) < value(rules) - 1e-9:
                    rules = rest
            if value(rules) >= before - 1e-9:
                for r in list(rules):  # replace one
                    new = added([x for x in rules if x is not r])
                    if value(new) < before - 1e-9:
                        rules = new
                        break
                else:
                    return rules

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return self.model.predict(df, to)

    def show(self) -> list[str]:
        return self.model.render()


@dataclass
class ImbalancedRuleSetLearner(RuleSetLearner):
    """Maximises F1 under the bound on the number of rules; the weights only break ties."""

    def loss(self, times: np.ndarray, length: int, pos: np.ndarray, neg: np.ndarray) -> float:
        hit = times > 0
        tp, fp = pos[hit].sum(), neg[hit].sum()
        f1 = 2 * tp / max(tp + fp + pos.sum(), 1e-12)
        return (1 - f1) * (pos.sum() + neg.sum()) + 0.01 * self.beta_diverse * (np.maximum(times - 1, 0) * (pos + neg)).sum() + 0.01 * self.beta_complex * length

    def search(self, times: np.ndarray, length: int, pos: np.ndarray, neg: np.ndarray) -> tuple:
        free, every = times == 0, pos.sum() + neg.sum()
        tp, fp = pos[~free].sum(), neg[~free].sum()
        share = lambda a, b: 2 * (tp + a) / np.maximum(tp + a + fp + b + pos.sum(), 1e-12)
        now = share(0.0, 0.0)
        vectors = np.stack([pos * free, neg * free, (pos + neg) * ~free])
        gain = lambda s, n: (share(s[0], s[1]) - now) * every - 0.01 * self.beta_diverse * s[2] - 0.01 * self.beta_complex * n
        bound = lambda s, n: (share(s[0], 0.0) - now) * every - 0.01 * self.beta_complex * n
        return vectors, gain, bound
