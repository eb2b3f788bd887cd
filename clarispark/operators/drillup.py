"""DrillUp: the patterns that describe where a label value gathers, few and different from each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate, Rule, RuleSet
from clarispark.operators import mining, prep, scoring


@dataclass
class DrillUp:
    label_col: str = "label"
    label_val: object = 1
    dims: list[str] | None = None
    min_dim_val_cnt: int = 5
    sup_ratio: float = 0.01
    out_num: int = 100
    jcd_limit: float = 0.75
    min_pat_len: int = 1
    max_pat_len: int | None = None
    score_type: str = "risk"
    rules: list[Rule] = field(default_factory=list)

    def _folded(self, df: DataFrame) -> DataFrame:
        return prep.fold_long_tail(prep.fill_missing(df, self.used), self.used, self.min_dim_val_cnt, kept=self.kept)[0]

    def fit(self, df: DataFrame) -> DrillUp:
        dims = [c for c in (self.dims or df.columns) if c != self.label_col]
        bad = set(prep.bad_columns(df, dims))
        self.used = [d for d in dims if d not in bad]
        flagged = df.withColumn("flag", prep.label_flag(df, self.label_col, self.label_val))
        self.kept = prep.fold_long_tail(prep.fill_missing(flagged, self.used), self.used, self.min_dim_val_cnt)[1]
        groups = prep.compress(self._folded(flagged), self.used, "flag").persist()
        try:
            total, positives = (float(x or 0) for x in groups.agg(F.sum("count"), F.sum(F.col("count") * F.col("flag"))).first())
            sets = mining.frequent_itemsets(mining.itemized(groups, self.used), max(1.0, self.sup_ratio * positives), self.max_pat_len)
            usable = mining.closed(mining.admitted(sets, positives))
            ranked = scoring.score_itemsets(usable, positives, total, self.score_type).collect()  # bounded by the candidates' bound
            ranked.sort(key=lambda r: (-r["score"], len(r["items"]), r["items"]))
            rules = [(Rule(tuple(Predicate(*self._parts(i)) for i in r["items"]), self.label_val), r["score"]) for r in ranked]
            kept = scoring.diverse_top(groups, rules, self.out_num, self.jcd_limit, self.min_pat_len, F.col("count"))
            self.rules = [rules[i][0] for i in kept]
            self.report = scoring.report(groups, self.rules, F.col("flag"), self.score_type, F.col("count"))
        finally:
            groups.unpersist()
        return self

    def report_with_folds(self) -> DataFrame:
        """The report beside the columns whose rare values were folded and the values they kept."""
        return scoring.beside(self.report, self.kept)

    def _parts(self, item: str) -> tuple[str, str, str]:
        dim = next(d for d in sorted(self.used, key=len, reverse=True) if item.startswith(f"{d}="))
        return dim, "==", item[len(dim) + 1 :]

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        """1 where any pattern holds, after the same filling and folding as in the fit."""
        folded = {d: f"__{d}" for d in self.used}
        rules = [Rule(tuple(Predicate(folded[p.feature], p.op, p.value) for p in r.conditions)) for r in self.rules]
        wide = df.withColumns({f: F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(prep.MISSING)) for d, f in folded.items()})
        kept = {folded[d]: v for d, v in self.kept.items()}
        wide = prep.fold_long_tail(wide, list(folded.values()), 0, kept=kept)[0]
        return wide.withColumn(to, RuleSet(rules).predict_column()).drop(*folded.values())

    def rule_score(self, df: DataFrame) -> DataFrame:
        """rules, tot_count, label_count, label_ratio on new data; the ratio of a pattern without rows is NULL."""
        flagged = df.withColumn("flag", prep.label_flag(df, self.label_col, self.label_val))
        counts = scoring.rule_counts(self._folded(flagged), self.rules, F.col("flag"))
        rows = [(str(r), a + b, a) for r, (a, b) in zip(self.rules, counts, strict=True)]
        table = df.sparkSession.createDataFrame(rows, "rules string, tot_count double, label_count double")
        return table.withColumn("label_ratio", F.round(F.try_divide("label_count", "tot_count"), 4))

    def show(self) -> list[str]:
        return RuleSet(self.rules, self.label_val, "other").render()
