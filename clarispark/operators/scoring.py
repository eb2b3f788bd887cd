"""Scores, overlaps and reports of rules: conditional sums in one pass over rows or weighted groups."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Rule
from clarispark.functions.scores import score

#: Rules per aggregate; longer lists take several passes, as wide plans are slow to compile.
WIDE = 200


def score_itemsets(sets: DataFrame, positives: float, total: float, kind: str = "risk", flip: bool = False) -> DataFrame:
    """sets (items, a, b) with c, d and the score; flip turns its sign."""
    s = F.round(score(kind, F.col("a"), F.col("b"), F.lit(positives), F.lit(total)), 4)
    return sets.select("items", "a", "b", (F.lit(positives) - F.col("a")).alias("c"), (F.lit(total - positives) - F.col("b")).alias("d"), (-s if flip else s).alias("score"))


def rule_counts(df: DataFrame, rules: list[Rule], flag: Column, weight: Column | None = None) -> list[tuple[float, float]]:
    """(positives, negatives) covered by each rule."""
    w = F.lit(1) if weight is None else weight
    out = []
    for at in range(0, len(rules), WIDE):
        part = rules[at : at + WIDE]
        row = df.agg(*[F.coalesce(F.sum(F.when(r.column() & (flag == v), w)), F.lit(0)).alias(f"c{i}_{v}") for i, r in enumerate(part) for v in (1, 0)]).first()
        out += [(float(row[f"c{i}_1"]), float(row[f"c{i}_0"])) for i in range(len(part))]
    return out


def shared_weights(df: DataFrame, rules: list[Rule], weight: Column | None = None) -> dict[tuple[int, int], float]:
    """Weight of the rows of both, for each pair of rules (i <= j) that share rows.

    One pass: rows are grouped by the rules they meet, and only groups are spread over pairs.
    What is collected has a row for each pair of rules at most.
    """
    if not rules:
        return {}
    hits = F.array_compact(F.array(*[F.when(r.column(), F.lit(i)) for i, r in enumerate(rules)]))
    groups = df.select(hits.alias("__hits"), (F.lit(1) if weight is None else weight).cast("double").alias("__w")).groupBy("__hits").agg(F.sum("__w").alias("__w"))
    spread = groups.select("__hits", "__w", F.explode("__hits").alias("__i")).select("__i", "__w", F.explode("__hits").alias("__j")).where("__i <= __j")
    return {(r["__i"], r["__j"]): float(r["__w"] or 0) for r in spread.groupBy("__i", "__j").agg(F.sum("__w").alias("__w")).collect()}


def jaccard(df: DataFrame, rules: list[Rule], weight: Column | None = None) -> dict[tuple[int, int], float]:
    """Weight of the rows of both over that of the rows of either, for each pair of rules."""
    both, out = shared_weights(df, rules, weight), {}
    for i, j in itertools.combinations(range(len(rules)), 2):
        shared = both.get((i, j), 0.0)
        either = both.get((i, i), 0.0) + both.get((j, j), 0.0) - shared
        out[i, j] = shared / either if either else 0.0
    return out


def diverse_top(df: DataFrame, ranked: list[tuple[Rule, float]], k: int, limit: float, min_len: int = 1, weight: Column | None = None, block: int = 64) -> list[int]:
    """Numbers of the rules kept: in order of rank, unless one contains a kept rule, is contained in it, or overlaps it above the limit."""
    kept: list[int] = []
    usable = [i for i, (r, _) in enumerate(ranked) if len(r) >= min_len]
    for at in range(0, len(usable), block):
        part = usable[at : at + block]
        own = [*kept, *part]
        near = jaccard(df, [ranked[i][0] for i in own], weight) if len(own) > 1 else {}
        place = {n: i for i, n in enumerate(own)}
        for n in part:
            items = set(ranked[n][0].conditions)
            if any(items <= (o := set(ranked[m][0].conditions)) or o <= items or near[tuple(sorted((place[m], place[n])))] > limit for m in kept):
                continue
            kept.append(n)
            if len(kept) >= k:
                return kept
    return kept


def report(df: DataFrame, rules: list[Rule], flag: Column, kind: str = "risk", weight: Column | None = None) -> DataFrame:
    """rules, count, ratio, a, b, c, d, score for each rule."""
    w = F.lit(1) if weight is None else weight
    n, p = (float(x or 0) for x in df.agg(F.sum(w), F.sum(F.when(flag == 1, w))).first())
    rows = [(str(r), a + b, a, b, p - a, n - p - b) for r, (a, b) in zip(rules, rule_counts(df, rules, flag, weight), strict=True)]
    table = df.sparkSession.createDataFrame(rows, "rules string, count double, a double, b double, c double, d double")
    s = F.round(score(kind, F.col("a"), F.col("b"), F.lit(p), F.lit(n)), 4)
    return table.select("rules", "count", F.round(F.try_divide("a", "count"), 4).alias("ratio"), *[F.round(c, 2).alias(c) for c in "abcd"], s.alias("score"))


def union_coverage(df: DataFrame, rules: list[Rule], flag: Column, weight: Column | None = None) -> float:
    """Weight of the positives that any rule covers."""
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | r.column()
    return float(df.agg(F.sum(F.when(any_rule & (flag == 1), F.lit(1) if weight is None else weight))).first()[0] or 0)


def accuracy(tp: float, fp: float) -> float:
    return tp / (tp + fp) if tp + fp else 0.0


def kl_quality(inside: dict, overall: dict, label) -> float:
    """sqrt(support of the label inside) times the divergence of the label's distribution inside from that overall; 0 unless the label is more frequent inside."""
    n, m = sum(inside.values()), sum(overall.values())
    if not n or not m or not inside.get(label, 0) / n > overall.get(label, 0) / m:
        return 0.0
    kl = sum((q := inside.get(k, 0) / n) and q * math.log(q / max(overall[k] / m, 1e-9)) for k in overall)
    return math.sqrt(inside.get(label, 0)) * kl


def overlap(pairs: dict[tuple[int, int], float], rule: int, others: list[int]) -> float:
    """Sum of Jaccard distances of a rule to others."""
    return sum(1 - pairs[tuple(sorted((rule, o)))] for o in others if o != rule)


def overlap_cards(df: DataFrame, rules: list[Rule], rule: int, weight: Column | None = None) -> list[float]:
    """Weight of the rows that a rule shares with each rule, itself included."""
    both = shared_weights(df, rules, weight)
    return [both.get(tuple(sorted((rule, o))), 0.0) for o in range(len(rules))]


def set_quality(df: DataFrame, rules: list[Rule], label: str, metric: str = "kl") -> float:
    """Sum over the rules of the divergence ('kl') or accuracy ('acc') for the label of each, from one pass over labels."""
    if metric not in ("kl", "acc"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(r.column().cast("int")).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    overall = {r[label]: float(r["n"]) for r in rows}
    total = 0.0
    for i, rule in enumerate(rules):
        inside = {r[label]: float(r[f"r{i}"] or 0) for r in rows}
        hit = inside.get(rule.label, 0.0)
        total += kl_quality(inside, overall, rule.label) if metric == "kl" else accuracy(hit, sum(inside.values()) - hit)
    return total


def item_difference(rule: Rule, other: Rule) -> list:
    """The conditions of a rule that another doesn't have."""
    return sorted(set(rule.conditions) - set(other.conditions))


def covered_rows(df: DataFrame, rule: Rule, label: str, labels: list | None = None) -> DataFrame:
    """The rows that a rule covers, of the labels given or all."""
    hit = df.where(rule.column())
    return hit if labels is None else hit.where(F.col(label).isin(labels))


def beside(rules: DataFrame, folded: dict[str, list[str]]) -> DataFrame:
    """A report with the columns whose rare values were folded beside it, joined by row number; the longer of the two decides the length."""
    from pyspark.sql import Window

    own = rules.withColumn("__link", F.row_number().over(Window.orderBy(F.desc("score"), "rules")))  # a report has as many rows as rules
    notes = rules.sparkSession.createDataFrame([(i + 1, f"{c}: {', '.join(v)}") for i, (c, v) in enumerate(sorted(folded.items()))], "__link int, kept_values string")
    return own.join(notes, "__link", "full_outer").orderBy("__link").drop("__link")


def list_objective(df: DataFrame, rules: list[Rule], default, label: str, penalty: float = 1.0) -> float:
    """Rows that the first matching rule labels right, less the rows it covers or the default misses, less the penalty times all conditions."""
    from clarispark.functions.predicates import RuleList

    which = RuleList(rules, default).matched_rule()
    right = F.lit(False)
    for i, r in enumerate(rules):
        right = right | ((F.col("__which") == i) & (F.col(label) == F.lit(r.label)))
    row = df.withColumn("__which", which).agg(
        F.sum(right.cast("int")), F.sum(((F.col("__which") >= 0) | (F.col(label) != F.lit(default))).cast("int"))
    ).first()
    return float(row[0] or 0) - float(row[1] or 0) - penalty * sum(map(len, rules))
