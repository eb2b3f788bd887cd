"""Frequent patterns over weighted groups, level by level, and rule pools from MLlib."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate, Rule

#: Candidates per level that may be broadcast; more raise an error instead of being dropped.
MAX_CANDIDATES = 200_000


def itemized(groups: DataFrame, dims: list[str], flag: str = "flag", count: str = "count") -> DataFrame:
    """(items, pos, neg): each group's sorted items 'dim=value', and its weight by outcome."""
    items = F.array_sort(F.array(*[F.concat(F.lit(f"{d}="), F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("unknown<"))) for d in dims]))
    return groups.select(items.alias("items"), (F.col(count) * F.col(flag)).alias("pos"), (F.col(count) * (1 - F.col(flag))).alias("neg"))


def _frequent(counted: DataFrame, least: float) -> DataFrame:
    return counted.where(F.col("a") >= least)


def frequent_itemsets(weighted: DataFrame, least: float, max_len: int | None = None, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(items, a, b): itemsets with at least ``least`` positives, and the positives and negatives they cover.

    Level 1 is a grouped sum.  Level k joins frequent sets that share all but their last item and
    counts the candidates by one join with the groups.  Support can only fall with length, so without max_len
    the levels end where no set is frequent.
    """
    spark = weighted.sparkSession
    one = weighted.select(F.explode("items").alias("item"), "pos", "neg").groupBy("item").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    level = _frequent(one, least).select(F.array("item").alias("items"), "a", "b")
    rows = [(r["items"], r["a"], r["b"]) for r in level.collect()]
    schema = "items array<string>, a double, b double"
    every = [(list(i), float(a), float(b)) for i, a, b in rows]
    frequent = sorted(tuple(i) for i, _, _ in rows)
    for k in itertools.count(2) if max_len is None else range(2, max_len + 1):
        known, by_head = set(frequent), {}
        for s in frequent:
            by_head.setdefault(s[:-1], []).append(s[-1])
        candidates = []
        for head, tails in by_head.items():
            for i, x in enumerate(tails):
                for y in tails[i + 1 :]:
                    if x.partition("=")[0] != y.partition("=")[0]:
                        new = (*head, x, y)
                        if all((*new[:j], *new[j + 1 :]) in known for j in range(k - 2)):
                            candidates.append(new)
            if len(candidates) > max_candidates:
                raise ValueError(f"level {k} has over {max_candidates} candidates; raise the support or the bound")
        if not candidates:
            break
        table = F.broadcast(spark.createDataFrame([(list(c), c[0]) for c in candidates], "cand array<string>, head string"))  # at most max_candidates
        heads = weighted.select("items", "pos", "neg", F.explode("items").alias("head"))
        met = heads.join(table, "head").where(F.size(F.array_except("cand", "items")) == 0)
        counted = _frequent(met.groupBy("cand").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")), least).collect()
        every += [(r["cand"], float(r["a"]), float(r["b"])) for r in counted]
        frequent = sorted(tuple(r["cand"]) for r in counted)
    return spark.createDataFrame(every, schema)


def admitted(sets: DataFrame, out_count: float) -> DataFrame:
    """Candidates that are more positive than negative and not larger than 1.05 times the positives."""
    return sets.where((F.col("a") + F.col("b") <= 1.05 * F.lit(out_count)) & (2 * F.col("a") > F.col("a") + F.col("b")))


def closed(sets: DataFrame) -> DataFrame:
    """Itemsets without a superset of equal support (a, b)."""
    o = sets.select(F.col("items").alias("o_items"), F.col("a").alias("o_a"), F.col("b").alias("o_b"))
    larger = (F.col("a") == F.col("o_a")) & (F.col("b") == F.col("o_b")) & (F.size("o_items") > F.size("items")) & (F.size(F.array_except("items", "o_items")) == 0)
    return sets.join(o, larger, "left_anti")


def extract_fpgrowth(df: DataFrame, items: str, min_support: float = 0.1, max_cardinality: int | None = 2) -> DataFrame:
    """(items, freq) by MLlib's FP-growth; items within a row must differ."""
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=0.0).fit(df).freqItemsets
    found = found if max_cardinality is None else found.where(F.size("items") <= max_cardinality)
    return found.select(F.array_sort("items").alias("items"), "freq")


def tree_paths(tree, features: list[str]) -> list[tuple[tuple[Predicate, ...], float]]:
    """(conditions, prediction) of each leaf of a fitted MLlib tree over numeric features, from its printed form."""
    out: list[tuple[tuple[Predicate, ...], float]] = []
    path: list[tuple[int, Predicate]] = []  # with the depth of each condition
    for line in tree.toDebugString.splitlines()[1:]:
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith(("If", "Else")):
            _, number, op, value = body[body.index("(") + 1 : body.rindex(")")].split()
            path = [x for x in path if x[0] < depth]
            path.append((depth, Predicate(features[int(number)], op, float(value))))
        elif body.startswith("Predict:"):
            path = [x for x in path if x[0] < depth]
            out.append((tuple(p for _, p in path), float(body.partition(":")[2])))
    return out


def extract_rf(df: DataFrame, features: list[str], label: str, n_trees: int = 20, max_depth: int = 5, prefix_only: bool = False, seed: int = 0, whole_only: bool = False) -> list[Rule]:
    """Rules of a random forest on two-valued features: the paths to leaves of class 1, and their prefixes.

    ``prefix_only`` leaves out the whole paths, ``whole_only`` the prefixes.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=features, outputCol="__x").transform(df.select(*features, F.col(label).cast("double").alias("__y")))
    model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=n_trees, maxDepth=max_depth, seed=seed).fit(table)
    rules: dict[tuple, None] = {}
    for tree in model.trees:
        for path, value in tree_paths(tree, features):
            if value == 1.0:
                for k in range(len(path) if whole_only else 1, len(path) + (0 if prefix_only else 1)):
                    if k:
                        rules.setdefault(tuple(sorted(set(path[:k]))), None)
    return [Rule(conditions) for conditions in sorted(rules, key=lambda c: (len(c), str(c)))]
