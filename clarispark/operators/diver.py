"""Diver: a rule set for one label value by a covering linear program and column generation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.linalg import covering_lp, lp_text
from clarispark.functions.predicates import Rule, RuleSet
from clarispark.operators.binarize import FeatureBinarizer, process_input
from clarispark.operators.prep import label_flag
from clarispark.operators.signatures import additive, covered, grow, signatures


@dataclass
class Diver:
    """min sum (pos_beta + overlap_beta) y_i + sum (overlap_beta |pos_j| + |neg_j| + C len_j) x_j, y_i + sum of x_j that cover i >= 1.

    Positives of one signature share a variable, weighted by their number, which leaves the
    program the same.  A pricing step finds the conjunction of least reduced cost, exactly, so the
    program is solved over all conjunctions when the steps end; over max_columns it raises an error.
    """

    label_col: str = "label"
    label_val: object = 1
    pos_beta: float = 1.5
    overlap_beta: float = 0.2
    complexity_cost: float = 1e-5
    max_len: int | None = None
    max_columns: int = 3000
    num_thresh: int = 9
    negation: bool = False
    most_predicates: int | None = None
    max_groups: int = 2000
    write_model: str | None = None  # a folder of the driver for the programs, modelN.lp
    rules: list[Rule] = field(default_factory=list)
    objective: float = 0.0

    def fit(self, df: DataFrame, features: list[str]) -> Diver:
        df, predicates = process_input(df, features, self.label_col, FeatureBinarizer(num_thresh=self.num_thresh, negation=self.negation), is_fit=True)
        flagged = df.withColumn("__flag", label_flag(df, self.label_col, self.label_val))
        sig = signatures(flagged, predicates, "__flag", self.most_predicates)
        pos = sig.counts[:, sig.labels.index(1)] if 1 in sig.labels else np.zeros(len(sig.truth))
        neg = sig.counts[:, sig.labels.index(0)] if 0 in sig.labels else np.zeros(len(sig.truth))
        rows = np.flatnonzero(pos)
        if len(rows) > self.max_groups:
            raise ValueError(f"{len(rows)} positive signatures exceed the program's bound {self.max_groups}; use fewer predicates")
        per_item = self.complexity_cost * (pos.sum() + neg.sum())
        cost = lambda m, n: self.overlap_beta * pos[m].sum() + neg[m].sum() + per_item * n
        columns = [(j,) for j in range(len(sig.pool)) if covered(sig, (j,))[rows].any()]
        last, still, steps = None, 0, 0
        while columns:
            cover = np.array([covered(sig, c)[rows] for c in columns]).T.astype(float)
            # In terms of whole groups: y counts groups, so its cost is the group's weight.
            program = np.array([cost(covered(sig, c), len(c)) for c in columns]), cover, (self.pos_beta + self.overlap_beta) * pos[rows]
            if self.write_model:
                with open(f"{self.write_model}/model{steps}.lp", "w", encoding="utf-8") as f:
                    f.write(lp_text(*program))
            steps += 1
            x, y, dual, self.objective = covering_lp(*program)
            full = np.zeros(len(sig.truth))
            full[rows] = dual
            items, gain = grow(sig, *additive(full - self.overlap_beta * pos - neg, per_item), self.max_len)
            if not items or items in columns or gain < 1e-5 * (pos.sum() + neg.sum()):
                break
            still = still + 1 if last is not None and abs(last - self.objective) < 1e-4 else 0
            if still >= 2:
                break
            last = self.objective
            if len(columns) >= self.max_columns:
                raise ValueError(f"over {self.max_columns} rules; raise the bound")
            columns.append(items)
        self.rules = [Rule(tuple(sig.pool[j] for j in c), self.label_val) for c, v in zip(columns, x if columns else [], strict=True) if v > 1e-9]
        self.duality_gap = abs(self.objective - float(dual.sum())) if columns else 0.0
        return self

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        return df.withColumn(to, F.when(RuleSet(self.rules).any_column(), F.lit(1)).otherwise(F.lit(0)))

    def show(self) -> list[str]:
        return RuleSet(self.rules, self.label_val, "other").render()
