"""One way to call every explainer: data, a baseline and target classes are checked, then attributed, in long form."""

from __future__ import annotations

from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.operators import attribution


class Explainer:
    """Template: ``explain(data, baseline, targets)`` gives (key, feature, class, value); an explainer can be called as well.

    data has the key and the features; a baseline is a table of the same features or {feature: value}.
    """

    needs_baseline: ClassVar[bool] = False

    def __init__(self, model, features: list[str], key: str, **options):
        self.model, self.features, self.key, self.options = model, features, key, options

    def __call__(self, data: DataFrame, **kwargs) -> DataFrame:
        return self.explain(data, **kwargs)

    def explain(self, data: DataFrame, baseline: DataFrame | dict[str, float] | None = None, targets: list[int] | None = None, **options) -> DataFrame:
        self._check_columns("data", data, [self.key, *self.features])
        baseline = self._baseline(baseline)
        out = self._attribute(data, baseline, **{**self.options, **options})
        if targets is None:
            return out
        parts = [attribution.of_class(out, k) for k in targets]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    @staticmethod
    def _check_columns(what: str, table: DataFrame, columns: list[str]) -> None:
        if not isinstance(table, DataFrame):
            raise TypeError(f"{what} must be a DataFrame, not {type(table).__name__}")
        if absent := [c for c in columns if c not in table.columns]:
            raise ValueError(f"{what} lacks the columns {absent}")

    def _baseline(self, baseline):
        if baseline is None:
            if self.needs_baseline:
                raise ValueError(f"{type(self).__name__} needs a baseline")
        elif isinstance(baseline, dict):
            if absent := [c for c in self.features if c not in baseline]:
                raise ValueError(f"baseline lacks the features {absent}")
        else:
            self._check_columns("baseline", baseline, self.features)
        return baseline

    def _attribute(self, data: DataFrame, baseline, **options) -> DataFrame:
        raise TypeError("an explainer of its own method is needed")

    def _melted(self, wide: DataFrame, suffix: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(0).alias("class"), F.col(f"`{c}{suffix}`").alias("value")) for c in self.features])
        return wide.select(self.key, F.explode(each).alias("x")).select(self.key, "x.feature", "x.class", "x.value")


class ShapExplainer(Explainer):
    """method: linear ({feature: coefficient}), tree (a fitted MLlib model), exact (a model of columns), kernel (a model of pandas tables), or auto by the model's kind.

    mode origin: against the whole baseline table; match: each row against the baseline row of the same key.
    """

    needs_baseline = True
    METHODS = ("linear", "tree", "exact", "kernel", "auto")

    def __init__(self, model, features: list[str], key: str, method: str = "auto", link: str = "identity", mode: str = "match", **options):
        super().__init__(model, features, key, **options)
        if method not in self.METHODS:
            raise ValueError(f"method must be one of {self.METHODS}")
        if link not in ("identity", "logit"):
            raise ValueError("link must be identity or logit")
        if mode not in ("match", "origin"):
            raise ValueError("mode must be match or origin")
        self.link, self.mode = link, mode
        self.method = method if method != "auto" else "linear" if isinstance(model, dict) else "tree" if hasattr(model, "toDebugString") else "kernel"

    def _attribute(self, data: DataFrame, baseline, **options) -> DataFrame:
        fixed = isinstance(baseline, dict)
        if self.mode == "match" and not fixed:
            own = {c: f"__base_{c}" for c in self.features}
            if self.key not in baseline.columns:
                raise ValueError(f"matched baselines need the key {self.key}")
            data = data.join(baseline.select(self.key, *[F.col(c).alias(b) for c, b in own.items()]), self.key)
            columns = {c: F.col(b).cast("double") for c, b in own.items()}
            if self.method == "tree":
                return attribution.shap_tree(data, self.key, attribution.TreeEnsemble.of(self.model, self.features), self.features, matched=own)
            if self.method == "kernel":
                raise ValueError("matched baselines are for linear, tree and exact; a kernel takes mode origin")
        elif self.method in ("linear", "exact"):
            columns = dict(baseline) if fixed else attribution.background_mean(baseline, self.features)
            if self.method == "exact" and not fixed:
                raise ValueError("exact takes one baseline: {feature: value}, or matched rows")
        if self.method == "linear":
            return self._melted(attribution.shap_linear(data, self.model, columns), "__shap")
        if self.method == "exact":
            return self._melted(attribution.shap_exact(data, self.model, self.features, columns, self.link), "__shap")
        rows = pd.DataFrame([baseline]) if fixed else baseline
        if self.method == "tree":
            return attribution.shap_tree(data, self.key, attribution.TreeEnsemble.of(self.model, self.features), self.features, background=rows)
        return attribution.shap_sampled(data, self.key, self.model, self.features, rows, link=self.link, **options)


class GradientExplainer(Explainer):
    """Integrated gradients; the model gives the gradient's columns, and no baseline means zeros."""

    def _attribute(self, data: DataFrame, baseline, **options) -> DataFrame:
        if baseline is not None and not isinstance(baseline, dict):
            baseline = attribution.background_mean(baseline, self.features)
        return self._melted(attribution.integrated_gradients(data, self.model, self.features, baseline, **options), "__ig")


class LimeExplainer(Explainer):
    """Local surrogates; the baseline table gives the deviations of the neighbours."""

    needs_baseline = True

    def _attribute(self, data: DataFrame, baseline, **options) -> DataFrame:
        if isinstance(baseline, dict):
            raise ValueError("a table is needed as baseline")
        return attribution.lime_tabular(data, self.key, self.model, self.features, baseline, **options)
