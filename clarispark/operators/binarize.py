"""Binarization: frozen predicates learned from a table, applied as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarispark.functions.predicates import Predicate
from clarispark.functions.ranks import quantiles


@dataclass
class FeatureBinarizer:
    """Learns predicates for each feature.

    Two values or fewer: one indicator of the larger.  Strings, and columns listed as
    categorical: an equality per value (at most max_values, else an error).  Numbers: thresholds,
    all distinct values but the largest if they are num_thresh + 1 at most, else that many
    quantiles.  Columns with NULLs get indicators of that too.  ``negation`` adds complements.
    """

    categorical: list[str] = field(default_factory=list)
    num_thresh: int = 9
    negation: bool = False
    max_values: int = 1000
    return_ordinals: bool = False
    predicates: list[Predicate] = field(default_factory=list)
    thresholds: dict[str, list[float]] = field(default_factory=dict)
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str]) -> FeatureBinarizer:
        kinds = {f.name: f.dataType for f in df.schema}
        numeric = [c for c in features if isinstance(kinds[c], T.NumericType)]
        for c in features:
            if c not in numeric and not isinstance(kinds[c], (T.StringType, T.BooleanType)):
                raise ValueError(f"column {c} has type {kinds[c].simpleString()}: cast it to a number or a string")
        clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in features])
        stats = clean.agg(*[e for c in features for e in (F.approx_count_distinct(c).alias(f"{c}__n"), F.sum(F.col(c).isNull().cast("int")).alias(f"{c}__null"))]).first()
        # Estimates are within a few percent: columns that are surely wide aren't counted exactly.
        most = {c: self.num_thresh + 1 if c in numeric and c not in self.categorical else self.max_values for c in features}
        few = [c for c in features if stats[f"{c}__n"] <= 2 * max(2, most[c]) + 10]
        found = self._values(clean, few)
        count = {c: len(found[c]) if c in found else stats[f"{c}__n"] for c in features}
        wide = [c for c in numeric if c not in self.categorical and count[c] > max(2, self.num_thresh + 1)]
        cuts = quantiles(clean, wide, [i / (self.num_thresh + 1) for i in range(1, self.num_thresh + 1)])
        ordinal = [c for c in numeric if c not in self.categorical and count[c] > 2]
        if self.return_ordinals and ordinal:
            row = clean.agg(*[e for c in ordinal for e in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
            self.scaling = {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in ordinal}
        self.predicates = []
        for c in features:
            n, nulls = count[c], stats[f"{c}__null"]
            if c in wide:
                values = sorted({round(v, 6) for v in cuts[c]})
            else:
                if n > self.max_values:
                    raise ValueError(f"column {c} has {n} values; at most {self.max_values} are turned into predicates")
                values = found[c]
            if n <= 2:
                if values:
                    self.predicates += [Predicate(c, "", values[-1]), *([Predicate(c, "not", values[-1])] if self.negation else [])]
            elif c in ordinal:
                self.thresholds[c] = [float(v) for v in (values if c in wide else values[:-1])]
                self.predicates += [p for v in self.thresholds[c] for p in (Predicate(c, "<=", v), *([Predicate(c, ">", v)] if self.negation else []))]
            else:
                self.predicates += [p for v in values for p in (Predicate(c, "==", v), *([Predicate(c, "!=", v)] if self.negation else []))]
            if nulls:
                self.predicates += [Predicate(c, "null"), *([Predicate(c, "notnull")] if self.negation else [])]
        return self

    @staticmethod
    def _values(clean: DataFrame, columns: list[str]) -> dict[str, list]:
        """Sorted distinct values of columns that have few: one pass for all columns, a row for each value collected."""
        if not columns:
            return {}
        sets = clean.agg(*[F.collect_set(c).alias(str(i)) for i, c in enumerate(columns)]).first()
        return {c: sorted(sets[i]) for i, c in enumerate(columns)}

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """An int column for each predicate, named as it reads; z-scored ordinals beside if asked for."""
        cols = [p.column().cast("int").alias(str(p)) for p in self.predicates]
        extra = [F.coalesce((F.col(c) - m) / (s or 1.0), F.lit(0.0)).alias(c) for c, (m, s) in self.scaling.items()]
        return df.select(*(keep or []), *cols, *extra)


class TabularDataHandler:
    """Fits and applies a binarizer in one call."""

    def __init__(self, **binarizer):
        self.binarizer = FeatureBinarizer(**binarizer)

    def preprocess(self, df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
        return self.binarizer.fit(df, features).transform(df, keep)


def process_input(df: DataFrame, features: list[str], label: str | None = None, binarizer: FeatureBinarizer | None = None, is_fit: bool = False) -> tuple[DataFrame, list[Predicate]]:
    """The front door of the learners: checks columns and gives (table, predicates).

    Without a binarizer every feature must be two-valued, and the larger value counts as true.
    """
    missing = [c for c in [*features, *([label] if label else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if binarizer is None:
        stats = df.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()  # exact for so few
        if wide := [c for c in features if stats[c] > 2]:
            raise ValueError(f"columns with more than two values need a binarizer: {wide}")
        binarizer, is_fit = FeatureBinarizer(), True
    if is_fit:
        binarizer.fit(df, features)
    return df, binarizer.predicates
