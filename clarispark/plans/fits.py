"""Queries of what is fitted: learners, clusters, additive models, explainers; and of sources and reports.

A fit has SQL where its answer is known beforehand: outcomes are planted so that the optimum of a
learner's objective is the planted rule, models are such that their attributions have a closed form.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate, Rule
from clarispark.operators import attribution, explain, gam, mining, prep, scoring, signatures, temporal, wkmodes
from clarispark.operators.binarize import TabularDataHandler, process_input
from clarispark.operators.diver import Diver
from clarispark.operators.drillup import DrillUp
from clarispark.operators.rulelist import RuleListLearner
from clarispark.operators.ruleset import ImbalancedRuleSetLearner, RuleSetLearner
from clarispark.plans.queries import _PAIRS, _RSQL, _Y, ORACLE_SQL, QUERIES, R1, R2, R3, _flags, _lines, _r, planted, query, series
from clarispark.session import checkpoint_dir, read_table
from clarispark.sources.datasets import DatasetLoader, ensure_dataframe, read_headerless

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- Rule learners: outcomes over columns of few values, so that their thresholds are all candidates ---

_FEW = ["l_linenumber", "l_discount", "l_tax", "l_linestatus"]
_TAXED, _EARLY = "(l_linestatus = 'F' AND l_tax > 0.065)", "(l_linenumber <= 2 AND l_discount > 0.065)"
_THREE = f"CASE WHEN {_TAXED} THEN 'taxed' WHEN {_EARLY} THEN 'early' ELSE 'plain' END"
_EITHER = f"CASE WHEN {_TAXED} OR {_EARLY} THEN 1 ELSE 0 END"


def _ruled(spark, sf_dir, outcome: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", *_FEW, F.expr(outcome).alias("y"))


def _predicted(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "prediction")


def _outcome_sql(outcome: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {outcome} AS prediction FROM lineitem"


@query(_outcome_sql(_THREE))
def rulelist_fit(spark, sf_dir):
    df = _ruled(spark, sf_dir, _THREE)
    return _predicted(RuleListLearner(complexity=10, num_thresh=10).fit(df, _FEW, "y").predict(df))


@query(_outcome_sql(_EITHER))
def ruleset_fit(spark, sf_dir):
    df = _ruled(spark, sf_dir, _EITHER)
    return _predicted(RuleSetLearner(num_thresh=10, beta_complex=10).fit(df, _FEW, "y").predict(df))


@query(_outcome_sql(_EITHER))
def ruleset_imb_fit(spark, sf_dir):
    df = _ruled(spark, sf_dir, _EITHER)
    return _predicted(ImbalancedRuleSetLearner(num_thresh=10, max_num_rules=4).fit(df, _FEW, "y").predict(df))


@query(_outcome_sql(_EITHER))
def diver_fit(spark, sf_dir):
    df = _ruled(spark, sf_dir, _EITHER)
    return _predicted(Diver("y", 1, num_thresh=10, negation=True).fit(df, _FEW).predict(df))


@query(f"SELECT (l_linestatus = 'F') AS f, l_linenumber <= 3 AS few, l_tax > 0.04 AS tax, count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM {_Y} GROUP BY 1, 2, 3")
def signature_counts(spark, sf_dir):
    pool = [Predicate("l_linestatus", "==", "F"), Predicate("l_linenumber", "<=", 3), Predicate("l_tax", ">", 0.04)]
    sig = signatures.signatures(planted(spark, sf_dir), pool, "y")
    return spark.createDataFrame([(*map(bool, t), float(c[0]), float(c[1])) for t, c in zip(sig.truth, sig.counts, strict=True)], "f boolean, few boolean, tax boolean, n0 double, n1 double")


_POOL = [Predicate("l_linestatus", "==", "F"), Predicate("l_linestatus", "!=", "F"), *[Predicate("l_linenumber", op, n) for n in (1, 2, 3, 4, 5, 6) for op in ("<=", ">")], *[Predicate("l_tax", ">", t / 100 + 0.005) for t in range(8)], *[Predicate("l_discount", ">", t / 100 + 0.005) for t in range(9)]]
_POOL_SQL = [f"{p.feature} {p.op.replace('==', '=').replace('!=', '<>')} {p.value!r}" for p in _POOL]
_PRICED = " UNION ALL ".join(
    f"SELECT '{' AND '.join(sorted(str(_POOL[k]) for k in c))}' AS rule, sum(CASE WHEN {' AND '.join(_POOL_SQL[k] for k in c)} THEN w END) - 5.0 * {len(c)} AS gain FROM t" for n in (1, 2) for c in itertools.combinations(range(len(_POOL)), n))


@query(f"WITH t AS (SELECT *, CASE WHEN y = 1 THEN 3 ELSE -1 END AS w FROM {_Y}) SELECT rule, gain::DOUBLE AS gain FROM ({_PRICED}) ORDER BY gain DESC LIMIT 1")
def pricing_step(spark, sf_dir):
    """The conjunction of up to two predicates with the largest dual value, by the exact search that prices columns."""
    sig = signatures.signatures(planted(spark, sf_dir), _POOL, "y")
    items, gain = signatures.grow(sig, *signatures.additive(3.0 * sig.counts[:, sig.labels.index(1)] - sig.counts[:, sig.labels.index(0)], 5.0), max_len=2)
    return spark.createDataFrame([(str(Rule(tuple(sig.pool[j] for j in items))), gain)], "rule string, gain double")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 12 AND l_discount >= 0.07 AND l_tax >= 0.07 THEN 1 ELSE 0 END AS prediction FROM lineitem")
def rf_rules(spark, sf_dir):
    """Whole paths of a forest that cover positives only predict the planted conjunction."""
    t = _flags(spark, sf_dir).withColumns({"status_f": (F.col("l_linestatus") == "F").cast("int"), "both": F.col("l_small") * F.col("l_hightax")})
    found = mining.extract_rf(t, ["l_small", "l_hightax", "status_f"], "both", n_trees=10, max_depth=3, whole_only=True)
    pure = [r for r, (_, b) in zip(found, scoring.rule_counts(t, found, F.col("both")), strict=True) if not b]
    hit = F.lit(False)
    for r in pure:
        hit = hit | r.column()
    return _predicted(t.withColumn("prediction", hit.cast("int")))


# --- Patterns that describe a label ---

_DRILL = ["l_small", "l_linestatus", "l_hightax", "l_returnflag"]
_DRILLED = f"(SELECT *, (l_quantity <= 12 AND l_discount >= 0.07)::INT AS l_small, (l_tax >= 0.07)::INT AS l_hightax FROM {_Y})"


def _drill_sql(k: int, limit: float, least: float, tail: str) -> str:
    """The k best patterns: frequent, admitted, closed, by risk, each unlike those before it."""
    sets = " UNION ALL ".join(
        f"SELECT list_sort([{', '.join(f"'{d}=' || {d}" for d in c)}]) AS items, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM t GROUP BY {', '.join(c)}" for n in range(1, len(_DRILL) + 1) for c in itertools.combinations(_DRILL, n))
    steps = ", ".join(
        f"pick{i} AS (SELECT items, place FROM ranked c WHERE " + (" AND ".join(
            f"NOT EXISTS (SELECT 1 FROM pick{j} p WHERE list_has_all(p.items, c.items) OR list_has_all(c.items, p.items) OR (SELECT sum(n) FILTER (list_has_all(g.items, p.items) AND list_has_all(g.items, c.items)) / sum(n) FILTER (list_has_all(g.items, p.items) OR list_has_all(g.items, c.items)) FROM g) > {limit})"
            for j in range(1, i)) or "true") + " ORDER BY place LIMIT 1)" for i in range(1, k + 1))
    return f"""WITH t AS {_DRILLED}, tot AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM t), s AS ({sets}),
f AS (SELECT s.* FROM s, tot WHERE a >= greatest(1.0, {least} * p)), u AS (SELECT f.* FROM f, tot WHERE a + b <= 1.05 * p AND a > b),
closed AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.a = u.a AND o.b = u.b AND len(o.items) > len(u.items) AND list_has_all(o.items, u.items))),
scored AS (SELECT items, a, b, p - a AS c, n - p - b AS d, round((a / (a + b)) / ((p - a + 1e-4) / (n - a - b + 1e-4)), 4) AS score FROM closed, tot),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, len(items), items) AS place FROM scored),
g AS (SELECT [{', '.join(f"'{d}=' || {d}" for d in _DRILL)}] AS items, count(*)::DOUBLE AS n FROM t GROUP BY {', '.join(_DRILL)}), {steps},
picked AS ({' UNION ALL '.join(f'SELECT * FROM pick{i}' for i in range(1, k + 1))}) {tail}"""


def _drilled(spark, sf_dir) -> tuple[DataFrame, DrillUp]:
    t = _flags(spark, sf_dir)
    return t, DrillUp("y", 1, dims=_DRILL, sup_ratio=0.05, out_num=3, jcd_limit=0.5).fit(t)


@query(_drill_sql(3, 0.5, 0.05, "SELECT array_to_string(list_sort([replace(x, '=', ' == ') for x in r.items]), ' AND ') AS rules, a + b AS count, round(a / (a + b), 4) AS ratio, a, b, c, d, score FROM ranked r JOIN picked USING (place)"))
def drillup_fit(spark, sf_dir):
    return _drilled(spark, sf_dir)[1].report


@query(_drill_sql(3, 0.5, 0.05, f"SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM picked p WHERE list_has_all([{', '.join(f"'{d}=' || {d}" for d in _DRILL)}], p.items))::INT AS prediction FROM t"))
def drillup_predict(spark, sf_dir):
    t, model = _drilled(spark, sf_dir)
    return _predicted(model.predict(t))


_JACCARD = " UNION ALL ".join(f"SELECT '{a}{b}' AS pair, count(*) FILTER ({_RSQL[a]} AND {_RSQL[b]})::DOUBLE / count(*) FILTER ({_RSQL[a]} OR {_RSQL[b]}) AS j FROM lineitem" for a, b in _PAIRS)
_NAMES = {"R1": str(R1).replace("'", "''"), "R2": str(R2).replace("'", "''"), "R3": str(R3).replace("'", "''")}


@query(f"""WITH j AS ({_JACCARD}), v AS (SELECT max(j) FILTER (pair = 'R1R2') AS a, max(j) FILTER (pair = 'R1R3') AS b, max(j) FILTER (pair = 'R2R3') AS c FROM j),
k AS (SELECT true AS k1, a <= 0.06 AS k2, b <= 0.06 AND (a > 0.06 OR c <= 0.06) AS k3 FROM v)
SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS line, text FROM (SELECT 1 AS place, '{_NAMES["R1"]}' AS text FROM k WHERE k1
UNION ALL SELECT 2, '{_NAMES["R2"]}' FROM k WHERE k2 UNION ALL SELECT 3, '{_NAMES["R3"]}' FROM k WHERE k3)""")
def diverse_topk(spark, sf_dir):
    """In order of rank: a rule over the limit with a kept one goes, and so does one that contains a kept one."""
    rules = [R1, R2, R3, Rule((*R1.conditions, *R3.conditions), 1)]
    kept = scoring.diverse_top(planted(spark, sf_dir), [(r, 0.0) for r in rules], 4, 0.06)
    return _lines(spark, [str(rules[i]) for i in kept])


_KL = " UNION ALL ".join(f"""SELECT CASE WHEN a / (a + b) > p / n THEN sqrt(a) * (CASE WHEN a > 0 THEN a / (a + b) * ln(a / (a + b) / greatest(p / n, 1e-9)) ELSE 0 END
+ CASE WHEN b > 0 THEN b / (a + b) * ln(b / (a + b) / greatest(1 - p / n, 1e-9)) ELSE 0 END) ELSE 0 END AS kl, a / (a + b) AS acc
FROM (SELECT (count(*) FILTER ({s} AND y = 1))::DOUBLE AS a, (count(*) FILTER ({s} AND y = 0))::DOUBLE AS b, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM {_Y})""" for s in _RSQL.values())


@query(f"SELECT 'kl' AS metric, round(sum(kl), 4) AS quality FROM ({_KL}) UNION ALL SELECT 'acc', round(sum(acc), 4) FROM ({_KL})")
def ruleset_quality(spark, sf_dir):
    t = planted(spark, sf_dir)
    return spark.createDataFrame([(m, round(scoring.set_quality(t, [R1, R2, R3], "y", m), 4)) for m in ("kl", "acc")], "metric string, quality double")


@query(" UNION ALL ".join(f"SELECT '{a}' AS rule, '{b}' AS other, count(*) FILTER ({_RSQL[a]} AND {_RSQL[b]})::DOUBLE AS card FROM lineitem" for a in _RSQL for b in _RSQL))
def overlap_cards(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    rows = [(f"R{i + 1}", f"R{j + 1}", c) for i in range(3) for j, c in enumerate(scoring.overlap_cards(df, [R1, R2, R3], i))]
    return spark.createDataFrame(rows, "rule string, other string, card double")


@query(f"SELECT l_orderkey, l_linenumber, y FROM {_Y} WHERE {_RSQL['R3']} AND y IN (0)")
def rule_coverage(spark, sf_dir):
    return scoring.covered_rows(planted(spark, sf_dir), R3, "y", [0]).select("l_orderkey", "l_linenumber", "y")


@query(f"SELECT DISTINCT 'l_linenumber <= ' || m AS condition FROM (SELECT max(l_linenumber) - 3 AS m FROM {_Y})")
def item_difference(spark, sf_dir):
    most = read_table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber")).first()[0]
    own = Rule((*R1.conditions, Predicate("l_linenumber", "<=", most - 3)), 1)
    return spark.createDataFrame([(str(p),) for p in scoring.item_difference(own, R1)], "condition string")


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, round(sum(CASE WHEN {s} AND y = 1 THEN l_extendedprice ELSE 0 END), 2) AS a, round(sum(CASE WHEN {s} AND y = 0 THEN l_extendedprice ELSE 0 END), 2) AS b FROM {_Y}" for n, s in _RSQL.items()))
def weighted_counts(spark, sf_dir):
    counts = scoring.rule_counts(planted(spark, sf_dir), [R1, R2, R3], F.col("y"), F.col("l_extendedprice"))
    return spark.createDataFrame([(f"R{i + 1}", round(a, 2), round(b, 2)) for i, (a, b) in enumerate(counts)], "rule string, a double, b double")


_ITEMS1 = " UNION ALL ".join(f"SELECT '{d}=' || {d} AS items, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM t GROUP BY {d}" for d in ("l_linestatus", "l_returnflag", "l_linenumber"))


@query(f"WITH t AS {_Y}, s AS ({_ITEMS1}), n AS (SELECT sum(y)::DOUBLE AS p FROM t) SELECT items, -round(2 * (a / (a + b)) * (a / p) / ((a / (a + b)) + (a / p)), 4) AS score FROM s, n WHERE a >= 20")
def flipped_scores(spark, sf_dir):
    dims = ["l_linestatus", "l_returnflag", "l_linenumber"]
    t = planted(spark, sf_dir)
    n, p = (float(x) for x in t.agg(F.count(F.lit(1)), F.sum("y")).first())
    sets = mining.frequent_itemsets(mining.itemized(prep.compress(t, dims, "y"), dims, flag="y"), 20, 1)
    return scoring.score_itemsets(sets, p, n, "diffScore", flip=True).select(F.array_join("items", " AND ").alias("items"), "score")


@query(f"WITH t AS {_Y}, s AS ({_ITEMS1}), n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM t) SELECT items, round((a / (a + b)) / ((p - a + 1e-4) / (n - a - b + 1e-4)), 4) AS score FROM s, n ORDER BY 2 DESC, 1 LIMIT 3")
def top_items(spark, sf_dir):
    dims = ["l_linestatus", "l_returnflag", "l_linenumber"]
    t = planted(spark, sf_dir)
    n, p = (float(x) for x in t.agg(F.count(F.lit(1)), F.sum("y")).first())
    sets = mining.frequent_itemsets(mining.itemized(prep.compress(t, dims, "y"), dims, flag="y"), 1, 1)
    return scoring.score_itemsets(sets, p, n).select(F.array_join("items", " AND ").alias("items"), "score").orderBy(F.desc("score"), "items").limit(3)


@query(f"""WITH t AS {_Y}, n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM t),
r AS ({" UNION ALL ".join(f"SELECT '{_NAMES[k]}' AS rules, (count(*) FILTER ({s} AND y = 1))::DOUBLE AS a, (count(*) FILTER ({s} AND y = 0))::DOUBLE AS b FROM t" for k, s in _RSQL.items())}),
o AS (SELECT rules, score, row_number() OVER (ORDER BY score DESC, rules) AS link FROM (SELECT rules, round((a / (a + b)) / ((p - a + 1e-4) / (n - a - b + 1e-4)), 4) AS score FROM r, n)),
c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), k AS (SELECT 1 AS link, 'p_name: ' || coalesce(string_agg(p_name, ', ' ORDER BY p_name) FILTER (n >= 32), '') AS kept_values FROM c HAVING count(*) FILTER (n < 32) > 10)
SELECT rules, score, kept_values FROM o FULL JOIN k USING (link)""")
def report_beside_folds(spark, sf_dir):
    report = scoring.report(planted(spark, sf_dir), [R1, R2, R3], F.col("y"))
    return scoring.beside(report, prep.rare_values(read_table(spark, sf_dir, "part"), ["p_name"], 32)).select("rules", "score", "kept_values")


# --- Sources and the front door ---


def _csv(df: DataFrame, name: str, header: bool) -> str:
    path = f"{checkpoint_dir(df.sparkSession)}/{name}"
    df.coalesce(1).write.mode("overwrite").csv(path, header=header)
    return path


@query("SELECT n_nationkey::INT AS key, n_name AS name, n_regionkey::INT AS label FROM nation")
def csv_headerless(spark, sf_dir):
    df = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return read_headerless(spark, _csv(df, "headerless_nation", False), names=["key", "name"])


@query("SELECT o_orderkey::INT AS o_orderkey, (o_orderstatus = 'F')::INT AS label FROM orders")
def csv_dataset(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    base = f"{checkpoint_dir(spark)}/dataset_orders"
    _csv(df, "dataset_orders/orders/data.csv", True)
    meta = spark.createDataFrame([("""{"label": "o_orderstatus", "positive": "o_orderstatus = 'F'"}""",)], "value string")
    meta.coalesce(1).write.mode("overwrite").text(f"{base}/orders/meta.json")
    return DatasetLoader(spark, "orders", base).dataframe.select("o_orderkey", "label")


@query("SELECT r_regionkey::BIGINT AS f0, length(r_name)::BIGINT AS f1, r_regionkey::BIGINT % 2 AS label FROM region")
def ingest_arrays(spark, sf_dir):
    rows = read_table(spark, sf_dir, "region").orderBy("r_regionkey").toPandas()  # the region table has five rows
    data = np.column_stack([rows["r_regionkey"], rows["r_name"].str.len()]).astype("int64")
    return ensure_dataframe(spark, data, data[:, 0] % 2)


@query("""WITH v AS (SELECT DISTINCT n_regionkey AS v FROM nation) SELECT n_nationkey, (n_regionkey <= 0)::INT AS "n_regionkey <= 0", (n_regionkey > 0)::INT AS "n_regionkey > 0",
(n_regionkey <= 1)::INT AS "n_regionkey <= 1", (n_regionkey > 1)::INT AS "n_regionkey > 1", (n_regionkey <= 2)::INT AS "n_regionkey <= 2", (n_regionkey > 2)::INT AS "n_regionkey > 2",
(n_regionkey <= 3)::INT AS "n_regionkey <= 3", (n_regionkey > 3)::INT AS "n_regionkey > 3", round((n_regionkey - (SELECT avg(n_regionkey) FROM nation)) / (SELECT stddev_pop(n_regionkey) FROM nation), 6) AS n_regionkey FROM nation""")
def preprocess_table(spark, sf_dir):
    """Predicates of all thresholds with their complements, and the z-scored ordinal beside them."""
    out = TabularDataHandler(negation=True, return_ordinals=True).preprocess(read_table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"])
    return out.withColumn("n_regionkey", _r("n_regionkey", 6))


@query("""SELECT 'small' AS predicate, count(*) FILTER (l_quantity <= 12) AS n FROM lineitem UNION ALL SELECT 'l_linestatus', count(*) FILTER (l_linestatus = (SELECT max(l_linestatus) FROM lineitem)) FROM lineitem""")
def two_valued_input(spark, sf_dir):
    """Without a binarizer two-valued columns are predicates of their larger value."""
    df, found = process_input(read_table(spark, sf_dir, "lineitem").withColumn("small", (F.col("l_quantity") <= 12).cast("int")), ["small", "l_linestatus"])
    row = df.agg(*[F.sum(p.column().cast("int")).alias(str(p)) for p in found]).first()
    return spark.createDataFrame([(str(p), row[str(p)]) for p in found], "predicate string, n long")


@query("SELECT l_linenumber, (l_linenumber = 3)::INT AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def label_coercion(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    return df.groupBy("l_linenumber", prep.label_flag(df, "l_linenumber", "3.0").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 1 AS flag, count(*) FILTER (c_custkey = 7) AS n FROM customer UNION ALL SELECT 0, count(*) FILTER (c_custkey <> 7) FROM customer HAVING count(*) < 1001")
def downsampled(spark, sf_dir):
    """Positives stay whole; rows are only left out, by a hash, where positives are rarer than one in a thousand."""
    df = read_table(spark, sf_dir, "customer").withColumn("flag", (F.col("c_custkey") == 7).cast("int"))
    kept = prep.downsample_negatives(df, "flag", "c_custkey")
    n = df.count()
    return kept.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).where((F.col("flag") == 1) | F.lit(n < 1001))


# --- Clusters ---

_MODES = 64


def _moded(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").withColumn("g", F.col("label") % 3)
    bit = lambda i: ((F.floor((F.lit(i) + 16 * F.col("g")) / 16) % 3 == 0).cast("int") + ((F.col("vec_id") * 31 + i * 17) % 11 == 0).cast("int")) % 2
    return e.select("vec_id", "g", *[bit(i).cast("double").alias(f"b{i}") for i in range(_MODES)])


@query("SELECT vec_id, min(vec_id) OVER (PARTITION BY label % 3) AS cluster FROM embeddings")
def wkmodes_fit(spark, sf_dir):
    """Three planted patterns over 64 bits, with noise; clusters are named by their first row."""
    found = wkmodes.WKModes(3, init="cao").fit_predict(_moded(spark, sf_dir), [f"b{i}" for i in range(_MODES)])
    first = found.groupBy("cluster").agg(F.min("vec_id").alias("first"))
    return found.join(F.broadcast(first), "cluster").select("vec_id", F.col("first").alias("cluster"))  # three rows


@query("SELECT vec_id, (label % 3 = 0)::INT AS prediction FROM embeddings")
def wkmodes_rules(spark, sf_dir):
    """Contrasting the centres of one pattern with those of the others gives conditions that tell them apart; a majority of them predicts."""
    bits, names = _moded(spark, sf_dir).withColumn("y", (F.col("g") == 0).cast("int")), [f"b{i}" for i in range(_MODES)]
    rules = wkmodes.extract_wkmodes(bits.select("y", *[F.col(c).cast("int").alias(c) for c in names]), names, "y", 1, 2, most=64, all_apart=True)
    conditions = sorted({p for r in rules for p in r.conditions})
    votes = sum((p.column().cast("int") for p in conditions), F.lit(0))
    return bits.select("vec_id", (2 * votes > len(conditions)).cast("int").alias("prediction"))


# --- Additive model: a target that shape functions express, without a penalty ---

_TARGET = "2 * l_quantity - 30 * l_discount + greatest(l_quantity - 30, 0)"
_LOW = "(SELECT min(l_quantity) AS q0, min(l_discount) AS d0 FROM lineitem)"


def _price_model(spark, sf_dir, target: str = _TARGET) -> tuple[DataFrame, gam.GAM]:
    df = read_table(spark, sf_dir, "lineitem").withColumn("target", F.expr(target))
    return df, gam.GAM(max_iter=40, lambda_1=0.0).fit(df, ["l_quantity", "l_discount"], "target")


@query(f"SELECT l_orderkey, l_linenumber, round({_TARGET}, 2) AS prediction FROM lineitem")
def gam_fit(spark, sf_dir):
    df, model = _price_model(spark, sf_dir)
    return model.predict(df).select("l_orderkey", "l_linenumber", (_r("prediction", 2) + F.lit(0.0)).alias("prediction"))


@query(f"SELECT DISTINCT l_quantity AS x, round(2 * (l_quantity - q0) + greatest(l_quantity - 30, 0), 2) AS y, round(count(*) OVER (PARTITION BY l_quantity) / count(*) OVER (), 6) AS density FROM lineitem, {_LOW}")
def gam_shapes(spark, sf_dir):
    df, model = _price_model(spark, sf_dir)
    return model.shape_table(df, "l_quantity").select("x", (_r("y", 2) + F.lit(0.0)).alias("y"), _r("density", 6).alias("density"))


@query(f"""SELECT l_orderkey || '-' || l_linenumber AS id, 'l_quantity' AS feature, l_quantity AS value, round(2 * (l_quantity - q0) + greatest(l_quantity - 30, 0) + (2 * q0 - 30 * d0) / 2, 2) AS effect FROM lineitem, {_LOW}
UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'l_discount', l_discount, round(-30 * (l_discount - d0) + (2 * q0 - 30 * d0) / 2, 2) FROM lineitem, {_LOW}""")
def gam_waterfall(spark, sf_dir):
    df, model = _price_model(spark, sf_dir)
    return model.waterfall(df.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id").withColumn("effect", _r("effect", 2) + F.lit(0.0))


@query(f"SELECT l_orderkey, l_linenumber, round(2 * (l_quantity - q0) + greatest(l_quantity - 30, 0), 2) AS quantity, round(-30 * (l_discount - d0), 2) + 0.0 AS discount FROM lineitem, {_LOW}")
def gam_contributions(spark, sf_dir):
    df, model = _price_model(spark, sf_dir)
    out = model.contributions(df, intercept=True)
    return out.select("l_orderkey", "l_linenumber", (_r("l_quantity__effect", 2) + F.lit(0.0)).alias("quantity"), (_r("l_discount__effect", 2) + F.lit(0.0)).alias("discount"))


@query("SELECT DISTINCT l_quantity AS x, round(greatest((SELECT avg(l_quantity) * -3 + 100 FROM lineitem), -1e9), 2) AS prediction FROM lineitem")
def gam_constrained(spark, sf_dir):
    """A falling target that must not fall: the best shape is flat, at the mean."""
    df = read_table(spark, sf_dir, "lineitem").withColumn("target", F.expr("100 - 3 * l_quantity"))
    model = gam.GAM(max_iter=20, lambda_1=0.0).fit(df, ["l_quantity"], "target").add_constraint(-1, 1000, "Increase", "l_quantity").update(20)
    return model.predict(df).groupBy(F.col("l_quantity").alias("x")).agg((_r(F.first("prediction"), 2) + F.lit(0.0)).alias("prediction"))


@query("SELECT DISTINCT l_quantity AS x, round(CASE WHEN l_quantity <= 25 THEN 2 * l_quantity ELSE 50.0 END, 2) AS prediction FROM lineitem")
def gam_conflict(spark, sf_dir):
    """Rising and falling where both are asked is flat: the target is so already, and stays."""
    df = read_table(spark, sf_dir, "lineitem").withColumn("target", F.expr("least(2 * l_quantity, 50)"))
    model = gam.GAM(max_iter=20, lambda_1=0.0).fit(df, ["l_quantity"], "target").add_constraints([(0, 60, "inc"), (25, 60, "dec")], "l_quantity").update(20)
    return model.predict(df).groupBy(F.col("l_quantity").alias("x")).agg((_r(F.first("prediction"), 2) + F.lit(0.0)).alias("prediction"))


@query(f"SELECT DISTINCT l_quantity AS x, l_discount AS d, round(2 * (l_quantity - q0) + 2 * q0 - 30 * d0 + l_discount * 5 + 1, 2) AS prediction FROM lineitem, {_LOW}")
def gam_edits(spark, sf_dir):
    """The knot at 30 is scaled away, and the other feature's shape replaced by a function."""
    df, model = _price_model(spark, sf_dir)
    model.update_weights(30, 30, 0.0, "l_quantity").set_prediction("l_discount", lambda x: x * 5 + 1)
    return model.predict(df).groupBy(F.col("l_quantity").alias("x"), F.col("l_discount").alias("d")).agg((_r(F.first("prediction"), 2) + F.lit(0.0)).alias("prediction"))


_GROUPED = "(SELECT *, (l_linestatus = 'F')::INT AS f FROM lineitem)"


@query(f"SELECT f AS x, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS prediction FROM {_GROUPED} GROUP BY 1")
def gam_weighted(spark, sf_dir):
    """Over a two-valued category, weighted: the groups' weighted means."""
    df = read_table(spark, sf_dir, "lineitem").withColumn("f", (F.col("l_linestatus") == "F").cast("int"))
    model = gam.GAM(max_iter=5, lambda_1=0.5).fit(df, ["f"], "l_extendedprice", weight="l_quantity", category_features=["f"])
    return model.predict(df).groupBy(F.col("f").alias("x")).agg(_r(F.first("prediction"), 2).alias("prediction"))


#: Student's quantile by its expansion around the normal one, for many degrees of freedom.
_T = "(1.959963984540054 + (power(1.959963984540054, 3) + 1.959963984540054) / (4 * (n0 + n1 - 2)))"
_MEANS = f"(SELECT count(*) FILTER (f = 0) AS n0, count(*) FILTER (f = 1) AS n1, avg(l_extendedprice) FILTER (f = 0) AS m0, avg(l_extendedprice) FILTER (f = 1) AS m1, sum(l_extendedprice * l_extendedprice) AS ss FROM {_GROUPED})"
_SIGMA = "sqrt((ss - n0 * m0 * m0 - n1 * m1 * m1) / (n0 + n1 - 2))"


def _two_groups(spark, sf_dir) -> tuple[DataFrame, gam.GAM]:
    df = read_table(spark, sf_dir, "lineitem").withColumn("f", (F.col("l_linestatus") == "F").cast("int"))
    return df, gam.GAM(max_iter=5, lambda_1=0.0).fit(df, ["f"], "l_extendedprice")


@query(f"SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS half UNION ALL SELECT 1.0, round(m1 - m0, 1), round({_T} * {_SIGMA} * sqrt(1.0 / n0 + 1.0 / n1), 1) FROM {_MEANS}")
def gam_confidence(spark, sf_dir):
    """The step between two groups, and its interval from the residual variance."""
    _, model = _two_groups(spark, sf_dir)
    return spark.createDataFrame([(x, round(y, 1) + 0.0, round((hi - lo) / 2, 1)) for x, y, lo, hi in model.confidence()["f"]], "x double, y double, half double")


@query(f"SELECT 0 AS x, round(m0, 1) AS prediction, round({_T} * {_SIGMA} / sqrt(n0), 1) AS half FROM {_MEANS} UNION ALL SELECT 1, round(m1, 1), round({_T} * {_SIGMA} / sqrt(n1), 1) FROM {_MEANS}")
def gam_pointwise(spark, sf_dir):
    df, model = _two_groups(spark, sf_dir)
    out = model.pointwise_confidence(df.select("f", "l_extendedprice"))
    return out.groupBy(F.col("f").alias("x")).agg(_r(F.avg("prediction"), 1).alias("prediction"), _r(F.avg((F.col("upper") - F.col("lower")) / 2), 1).alias("half"))


@query(f"SELECT round({_SIGMA} * {_SIGMA}, -1) AS variance FROM {_MEANS}")
def gam_residual_variance(spark, sf_dir):
    return spark.createDataFrame([(float(_two_groups(spark, sf_dir)[1].residual_variance()),)], "variance double").select(_r("variance", -1).alias("variance"))


# --- Explainers, through the one template ---

_SUPPLIERS = "(SELECT avg(s_acctbal) AS b, avg(s_nationkey) AS k, avg(s_acctbal * s_nationkey) AS bk FROM supplier)"


def _accounts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers, and all suppliers as their background."""
    own = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("b"), F.col("c_nationkey").cast("double").alias("k"))
    return own, read_table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("b"), F.col("s_nationkey").cast("double").alias("k"))


@query(f"""SELECT c_custkey, 'b' AS feature, round(((c_acctbal - s.b) * c_nationkey + c_acctbal * s.k - s.bk) / 2 + 1e-6, 2) + 0.0 AS value FROM customer, {_SUPPLIERS} s
UNION ALL SELECT c_custkey, 'k', round(((c_nationkey - s.k) * c_acctbal + c_nationkey * s.b - s.bk) / 2 + 1e-6, 2) + 0.0 FROM customer, {_SUPPLIERS} s""")
def shap_sampled(spark, sf_dir):
    """A product of two features against the whole background: permutations with their reverses make pairs exact."""
    own, background = _accounts(spark, sf_dir)
    out = explain.ShapExplainer(lambda x: x["b"] * x["k"], ["b", "k"], "c_custkey", method="kernel", mode="origin", permutations=2)(own, baseline=background)
    return out.select("c_custkey", "feature", (_r(F.col("value") + 1e-6, 2) + F.lit(0.0)).alias("value"))


@query(f"SELECT c_custkey, 'b' AS feature, 1 AS class, round(c_acctbal - s.b, 3) + 0.0 AS value FROM customer, {_SUPPLIERS} s UNION ALL SELECT c_custkey, 'k', 1, round(2 * (c_nationkey - s.k), 3) + 0.0 FROM customer, {_SUPPLIERS} s")
def shap_classes(spark, sf_dir):
    """One class of a model of two."""
    own, background = _accounts(spark, sf_dir)
    model = lambda x: np.column_stack([x["b"] * 0, x["b"] + 2 * x["k"]])
    out = explain.ShapExplainer(model, ["b", "k"], "c_custkey", method="kernel", mode="origin", permutations=2)(own, baseline=background, targets=[1])
    return out.withColumn("value", _r("value", 3) + F.lit(0.0))


@query(f"SELECT 'b' AS feature, round(avg(abs(0.5 * (c_acctbal - s.b))), 4) AS importance FROM customer, {_SUPPLIERS} s UNION ALL SELECT 'k', round(avg(abs(2 * (c_nationkey - s.k))), 4) FROM customer, {_SUPPLIERS} s")
def shap_importance(spark, sf_dir):
    own, background = _accounts(spark, sf_dir)
    out = explain.ShapExplainer({"b": 0.5, "k": -2.0}, ["b", "k"], "c_custkey", mode="origin")(own, baseline=background)
    return attribution.importance(out).withColumn("importance", _r("importance"))


_TREE = "CASE WHEN {p} <= 25 THEN CASE WHEN {q} <= 3 THEN 1.0 ELSE 4.0 END ELSE CASE WHEN {q} <= 2 THEN 10.0 ELSE 2.0 END END"
_TREE_AT = {(a, b): _TREE.format(p=f"{a}.p", q=f"{b}.q") for a in "xz" for b in "xz"}


def _fitted_tree(spark, sf_dir):
    """A regression tree over all parts, whose target is a tree of two features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    own = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p"), (F.col("p_partkey") % 5).cast("double").alias("q"))
    table = VectorAssembler(inputCols=["p", "q"], outputCol="x").transform(own.withColumn("y", F.expr(_TREE.format(p="p", q="q"))))
    return own, DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=5, maxBins=64).fit(table)


@query(f"""WITH x AS (SELECT p_partkey, p_size AS p, p_partkey % 5 AS q FROM part), z AS (SELECT p_partkey, 51 - p_size AS p, (p_partkey + 2) % 5 AS q FROM part)
SELECT x.p_partkey, 'p' AS feature, round((({_TREE_AT['x', 'z']}) - ({_TREE_AT['z', 'z']}) + ({_TREE_AT['x', 'x']}) - ({_TREE_AT['z', 'x']})) / 2, 4) + 0.0 AS value FROM x JOIN z USING (p_partkey)
UNION ALL SELECT x.p_partkey, 'q', round((({_TREE_AT['z', 'x']}) - ({_TREE_AT['z', 'z']}) + ({_TREE_AT['x', 'x']}) - ({_TREE_AT['x', 'z']})) / 2, 4) + 0.0 FROM x JOIN z USING (p_partkey)""")
def shap_tree_match(spark, sf_dir):
    """Each row of a fitted tree against a baseline row of its own."""
    own, tree = _fitted_tree(spark, sf_dir)
    base = own.select("p_partkey", (51 - F.col("p")).alias("p"), ((F.col("p_partkey") + 2) % 5).cast("double").alias("q"))
    out = explain.ShapExplainer(tree, ["p", "q"], "p_partkey", method="tree")(own, baseline=base)
    return out.select("p_partkey", "feature", (_r("value") + F.lit(0.0)).alias("value"))


@query(f"""WITH x AS (SELECT p_partkey, p_size AS p, p_partkey % 5 AS q FROM part), z AS (SELECT s_nationkey * 2 AS p, s_suppkey % 5 AS q, count(*) AS n FROM supplier GROUP BY 1, 2)
SELECT p_partkey, 'p' AS feature, round(sum(n * (({_TREE_AT['x', 'z']}) - ({_TREE_AT['z', 'z']}) + ({_TREE_AT['x', 'x']}) - ({_TREE_AT['z', 'x']})) / 2) / sum(n), 3) + 0.0 AS value FROM x, z GROUP BY 1
UNION ALL SELECT p_partkey, 'q', round(sum(n * (({_TREE_AT['z', 'x']}) - ({_TREE_AT['z', 'z']}) + ({_TREE_AT['x', 'x']}) - ({_TREE_AT['x', 'z']})) / 2) / sum(n), 3) + 0.0 FROM x, z GROUP BY 1""")
def shap_tree_origin(spark, sf_dir):
    """A fitted tree against a whole background table."""
    own, tree = _fitted_tree(spark, sf_dir)
    base = read_table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 2).cast("double").alias("p"), (F.col("s_suppkey") % 5).cast("double").alias("q"))
    out = explain.ShapExplainer(tree, ["p", "q"], "p_partkey", mode="origin")(own, baseline=base)
    return out.select("p_partkey", "feature", (_r("value", 3) + F.lit(0.0)).alias("value"))


@query("""WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM part)
SELECT p_partkey, 'p_size' AS feature, round((p_size - a) * (p_retailprice + b) / 2, 2) + 0.0 AS value FROM part, m UNION ALL SELECT p_partkey, 'p_retailprice', round((p_retailprice - b) * (p_size + a) / 2, 2) + 0.0 FROM part, m""")
def ig_mean_baseline(spark, sf_dir):
    df = read_table(spark, sf_dir, "part")
    gradient = lambda c: {"p_size": c["p_retailprice"], "p_retailprice": c["p_size"]}
    out = explain.GradientExplainer(gradient, ["p_size", "p_retailprice"], "p_partkey", steps=8)(df, baseline=df)
    return out.select("p_partkey", "feature", (_r("value", 2) + F.lit(0.0)).alias("value"))


@query("SELECT p_partkey, 'p_size' AS feature, 3.0::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', -0.5 FROM part")
def lime_linear(spark, sf_dir):
    df = read_table(spark, sf_dir, "part")
    out = explain.LimeExplainer(lambda x: 3 * x["p_size"] - 0.5 * x["p_retailprice"], ["p_size", "p_retailprice"], "p_partkey", ridge=1e-9)(df, baseline=df)
    return out.select("p_partkey", "feature", (_r("value", 3) + F.lit(0.0)).alias("value"))


@query("""WITH w AS (SELECT item_id, unnest(string_split_regex(trim(text), '\\s+')) AS token FROM benchmark)
SELECT item_id, token, round(count(*) * length(token), 2)::DOUBLE AS value FROM w WHERE token <> '' GROUP BY 1, 2""")
def lime_text(spark, sf_dir):
    """A model that counts letters: each word weighs its letters times its occurrences."""
    count = lambda texts: [sum(map(len, t.split())) for t in texts]
    out = attribution.lime_text(read_table(spark, sf_dir, "benchmark"), "item_id", "text", count, samples=1000, ridge=1e-9)
    return out.withColumn("value", _r("value", 2) + F.lit(0.0))


# --- Temporal ---


def _halves(spark, sf_dir) -> DataFrame:
    """Two steps a customer: the sums of the first and of the later half of the events' days."""
    e = read_table(spark, sf_dir, "events").withColumn("late", (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) >= 15).cast("int"))
    sums = e.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(F.col("late") == k, F.col("value"))), F.lit(0.0)).alias(f"s{k}") for k in (0, 1)])
    return sums.select("user_id", F.array("s0", "s1").alias("spend"))


@query("""WITH e AS (SELECT user_id, coalesce(sum(value) FILTER (CAST(ts AS DATE) - DATE '2024-01-01' < 15), 0) AS a, coalesce(sum(value) FILTER (CAST(ts AS DATE) - DATE '2024-01-01' >= 15), 0) AS b FROM events GROUP BY 1),
k AS (SELECT regr_slope(b, a) AS ba, regr_slope(a, b) AS ab, avg(a) AS ma, avg(b) AS mb FROM e)
SELECT user_id, 0 AS i, 0 AS j, round(a + 2 * (mb + ba * (a - ma)), 2) AS value FROM e, k UNION ALL SELECT user_id, 1, 1, round(ma + ab * (b - mb) + 2 * b, 2) FROM e, k UNION ALL SELECT user_id, 0, 1, round(a + 2 * b, 2) FROM e""")
def temporal_conditional(spark, sf_dir):
    """One step held, the other at its conditional mean: a regression on the held one."""
    s = _halves(spark, sf_dir)
    generator = temporal.GaussianGenerator.fit(s, ["spend"])
    generator.ridge = 0.0
    out = temporal.conditional_means(s, "user_id", lambda x: x[:, 0, 0] + 2 * x[:, 0, 1], generator, 1)
    return out.select("user_id", "i", "j", (_r("value", 2) + F.lit(0.0)).alias("value"))


@query("SELECT count(DISTINCT user_id) AS users, (SELECT (max(CAST(ts AS DATE) - DATE '2024-01-01') // 7 + 1)::INT FROM events) AS patches FROM events")
def series_patches(spark, sf_dir):
    s, n = series(spark, sf_dir)
    return spark.createDataFrame([(s.count(), temporal.validate(s, ["spend", "visits"], 7))], "users long, patches int").where(F.col("patches") == n)

