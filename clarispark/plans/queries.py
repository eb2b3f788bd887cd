"""The library's queries over the test tables, and the DuckDB SQL of those that SQL can express.

Learners need an outcome that the columns tell; the tables have none, so it is planted (PLANTED).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispark.functions.predicates import Predicate, Rule, RuleList, RuleSet
from clarispark.functions.scores import score
from clarispark.operators import attribution, gam, mining, prep, scoring, temporal, wkmodes
from clarispark.operators.binarize import FeatureBinarizer
from clarispark.operators.drillup import DrillUp
from clarispark.session import read_table
from clarispark.sources.datasets import tic_tac_toe

PLANTED = "(l_quantity <= 12 AND l_discount >= 0.07) OR (l_linestatus = 'F' AND l_tax >= 0.07)"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").withColumn("y", F.expr(f"CASE WHEN {PLANTED} THEN 1 ELSE 0 END"))


def _r(c, n: int = 4):
    return F.round(c, n)


_Y = f"(SELECT *, CASE WHEN {PLANTED} THEN 1 ELSE 0 END AS y FROM lineitem)"
_DIMS = ["l_linestatus", "l_returnflag", "l_linenumber", "l_discount", "l_tax", "l_quantity"]

# --- Item scores ----------------------------------------------------------------------------------

_ITEMS = " UNION ALL ".join(f"SELECT '{d}=' || {d} AS item, y FROM t" for d in ("l_linestatus", "l_returnflag", "l_linenumber"))
_ITEM_SCORES = f"""
WITH t AS {_Y}, items AS ({_ITEMS}), n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM t),
c AS (SELECT item, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM items GROUP BY item)
SELECT item, a, b,
  round((a / (a + b)) / ((p - a + 1e-4) / (n - a - b + 1e-4)), 4) AS risk,
  round(2 * (a / (a + b)) * (a / p) / ((a / (a + b)) + (a / p)), 4) AS f1,
  round((a - b) / (a + b), 4) AS rep,
  round((a - b) / (a + b) * ((a / (a + b)) / ((p - a + 1e-4) / (n - a - b + 1e-4))), 4) AS repstar
FROM c, n"""


@query(_ITEM_SCORES)
def item_scores(spark, sf_dir):
    t = planted(spark, sf_dir)
    total = t.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("p"))
    counts = prep.unpivoted(t, ["l_linestatus", "l_returnflag", "l_linenumber"], F.col("y")).groupBy(F.concat_ws("=", "dim", "val").alias("item")).agg(
        F.sum("w").cast("double").alias("a"), F.sum(1 - F.col("w")).cast("double").alias("b"))
    s = lambda kind: _r(score(kind, F.col("a"), F.col("b"), F.col("p"), F.col("n")))
    return counts.crossJoin(F.broadcast(total)).select("item", "a", "b", s("risk").alias("risk"), s("diffScore").alias("f1"), s("rep").alias("rep"), s("rep*").alias("repstar"))


def flagship(spark, sf_dir):
    """Predicates of lineitem by how well they tell the planted outcome, best first."""
    t = planted(spark, sf_dir)
    found = FeatureBinarizer(num_thresh=9, negation=True).fit(t, _DIMS).predicates
    return scoring.report(t, [Rule((p,)) for p in found], F.col("y")).orderBy(F.desc("score"), "rules")


# --- Binarization ---------------------------------------------------------------------------------


def _truths(df: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """(predicate, n): rows for which each holds, in one pass and in long form."""
    each = F.array(*[F.struct(F.lit(str(p)).alias("predicate"), p.column().cast("long").alias("hit")) for p in predicates])
    return df.select(F.explode(each).alias("x")).groupBy("x.predicate").agg(F.sum("x.hit").alias("n"))


@query("""
WITH q AS (SELECT unnest(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM lineitem),
t AS (SELECT DISTINCT round(q, 6) AS t FROM q)
SELECT round(t, 4) AS threshold, count(*) FILTER (l_extendedprice <= t) AS n_le, count(*) FILTER (l_extendedprice > t) AS n_gt
FROM t, lineitem GROUP BY t""")
def binarize_ordinal(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_extendedprice")
    cuts = FeatureBinarizer(num_thresh=9).fit(df, ["l_extendedprice"]).thresholds["l_extendedprice"]
    each = F.array(*[F.struct(F.lit(c).alias("t"), Predicate("l_extendedprice", "<=", c).column().cast("long").alias("le"), Predicate("l_extendedprice", ">", c).column().cast("long").alias("gt")) for c in cuts])
    return df.select(F.explode(each).alias("x")).groupBy("x.t").agg(F.sum("x.le").alias("n_le"), F.sum("x.gt").alias("n_gt")).select(_r("t").alias("threshold"), "n_le", "n_gt")


@query("""
WITH v AS (SELECT DISTINCT l_linenumber AS v FROM lineitem), t AS (SELECT v FROM v WHERE v < (SELECT max(v) FROM v))
SELECT 'l_linenumber <= ' || v AS predicate, count(*) FILTER (l_linenumber <= v) AS n FROM t, lineitem GROUP BY v
UNION ALL SELECT 'l_linenumber > ' || v, count(*) FILTER (l_linenumber > v) FROM t, lineitem GROUP BY v""")
def binarize_few_values(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_linenumber")
    return _truths(df, FeatureBinarizer(num_thresh=9, negation=True).fit(df, ["l_linenumber"]).predicates)


@query("""
WITH v AS (SELECT DISTINCT o_orderpriority AS v FROM orders)
SELECT 'o_orderpriority == ' || v AS predicate, count(*) FILTER (o_orderpriority = v) AS n FROM v, orders GROUP BY v
UNION ALL SELECT 'o_orderpriority != ' || v, count(*) FILTER (o_orderpriority <> v) FROM v, orders GROUP BY v""")
def binarize_categorical(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_orderpriority")
    return _truths(df, FeatureBinarizer(negation=True).fit(df, ["o_orderpriority"]).predicates)


@query("""
SELECT 'l_linestatus' AS predicate, count(*) FILTER (l_linestatus = (SELECT max(l_linestatus) FROM lineitem)) AS n FROM lineitem
UNION ALL SELECT 'NOT l_linestatus', count(*) FILTER (l_linestatus <> (SELECT max(l_linestatus) FROM lineitem)) FROM lineitem""")
def binarize_binary(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_linestatus")
    return _truths(df, FeatureBinarizer(negation=True).fit(df, ["l_linestatus"]).predicates)


_NULLED = "(SELECT CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_linenumber END AS x FROM lineitem)"


@query(f"""
WITH s AS {_NULLED}, v AS (SELECT DISTINCT x AS v FROM s WHERE x IS NOT NULL), t AS (SELECT v FROM v WHERE v < (SELECT max(v) FROM v))
SELECT 'x <= ' || v AS predicate, count(*) FILTER (x <= v) AS n FROM t, s GROUP BY v
UNION ALL SELECT 'x > ' || v, count(*) FILTER (x > v) FROM t, s GROUP BY v
UNION ALL SELECT 'x == NaN', count(*) FILTER (x IS NULL) FROM s UNION ALL SELECT 'x != NaN', count(x) FROM s""")
def binarize_nulls(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 7 != 0, F.col("l_linenumber")).alias("x"))
    return _truths(df, FeatureBinarizer(negation=True).fit(df, ["x"]).predicates)


@query("""SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 4) AS z_size,
round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 4) AS z_price FROM part""")
def standardize(spark, sf_dir):
    return prep.standardize(read_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("p_partkey", _r("p_size").alias("z_size"), _r("p_retailprice").alias("z_price"))


# --- Preparation ----------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def default_label(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders")
    top = prep.default_label(df, "o_orderstatus")
    return df.where(F.col("o_orderstatus") == top).groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS mapped, count(*) AS n FROM lineitem GROUP BY 1, 2")
def label_map(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    _, positive = prep.binary_labels(df, "l_linestatus")
    return df.groupBy("l_linestatus", prep.label_flag(df, "l_linestatus", positive).alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


def _profile_sql(dims: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dim, sum(c)::BIGINT AS n, count(v) AS n_values, round(max(c) / sum(c), 4) AS top_share FROM (SELECT {d} AS v, count(*) AS c FROM orders GROUP BY 1)" for d in dims)


_ORDER_DIMS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"]


@query(_profile_sql(_ORDER_DIMS))
def column_profile(spark, sf_dir):
    return prep.column_profile(read_table(spark, sf_dir, "orders"), _ORDER_DIMS).select("dim", "n", "n_values", _r("top_share").alias("top_share"))


@query(f"SELECT dim FROM ({_profile_sql(_ORDER_DIMS)}) WHERE n_values <= 1 OR n_values / n > 0.7 OR top_share > 0.95")
def bad_columns(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in prep.bad_columns(read_table(spark, sf_dir, "orders"), _ORDER_DIMS)], "dim string")


@query("""SELECT coalesce(CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS VARCHAR), 'unknown<') AS x, count(*) AS n FROM lineitem GROUP BY 1""")
def fill_missing(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("x"))
    return prep.fill_missing(df, ["x"]).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), few AS (SELECT count(*) FILTER (n < 32) > 10 AS fold FROM c)
SELECT CASE WHEN fold AND n < 32 THEN 'other<' ELSE p_name END AS p_name, sum(n)::BIGINT AS n FROM c, few GROUP BY 1""")
def longtail_fold(spark, sf_dir):
    return prep.fold_long_tail(read_table(spark, sf_dir, "part"), ["p_name"], 32)[0].groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT l_linestatus, l_returnflag, l_linenumber, y, count(*) AS count, round(sum(l_quantity), 2) AS qty FROM {_Y} GROUP BY 1, 2, 3, 4")
def compress(spark, sf_dir):
    return prep.compress(planted(spark, sf_dir), ["l_linestatus", "l_returnflag", "l_linenumber"], "y", measures=("l_quantity",)).select(
        "l_linestatus", "l_returnflag", "l_linenumber", "y", "count", _r("l_quantity", 2).alias("qty"))


@query("SELECT 'in' AS side, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'out', count(*) FILTER (o_orderstatus <> 'F') FROM orders")
def split_by_label(spark, sf_dir):
    a, b = prep.split_by_label(read_table(spark, sf_dir, "orders"), "o_orderstatus", "F")
    n = lambda d, s: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return n(a, "in").unionByName(n(b, "out"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def filter_by_pattern(spark, sf_dir):
    kept = {"o_orderpriority": ["1-URGENT", "2-HIGH"]}
    df = prep.filter_by_pattern(read_table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": prep.OTHER}, kept)
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


_BOARD_LINES = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6)]


def _won(p: str) -> str:
    return "(" + " OR ".join(f"s{i} = '{p}' AND s{j} = '{p}' AND s{k} = '{p}'" for i, j, k in _BOARD_LINES) + ")"


_MARKS = " + ".join("(s{} = '{{0}}')::INT".format(i) for i in range(9))


@query(f"""WITH b AS (SELECT {", ".join(f"substr('bxo', (range // {3 ** i} % 3 + 1)::INT, 1) AS s{i}" for i in range(9))} FROM range({3 ** 9})),
n AS (SELECT *, {_MARKS.format("x")} AS nx, {_MARKS.format("o")} AS no, {_won("x")} AS wx, {_won("o")} AS wo FROM b)
SELECT {", ".join(f"s{i}" for i in range(9))}, CASE WHEN wx THEN 'positive' ELSE 'negative' END AS label FROM n
WHERE (wx AND NOT wo AND nx = no + 1) OR (wo AND NOT wx AND nx = no) OR (NOT wx AND NOT wo AND nx = 5 AND no = 4)""")
def tic_tac_toe_boards(spark, sf_dir):
    return tic_tac_toe(spark)


# --- Mining ---------------------------------------------------------------------------------------

_SETS = ["l_linestatus", "l_returnflag", "l_linenumber"]


def _itemsets(spark, sf_dir, length: int) -> DataFrame:
    groups = prep.compress(planted(spark, sf_dir), _SETS, "y")
    return mining.frequent_itemsets(mining.itemized(groups, _SETS, flag="y"), 20, length)


def _sets_sql(length: int) -> str:
    name = {"l_linenumber": "CAST(l_linenumber AS VARCHAR)"}
    part = lambda ds: f"SELECT {" || ' AND ' || ".join(f"'{d}=' || {name.get(d, d)}" for d in sorted(ds))} AS items, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b, {len(ds)} AS len FROM t GROUP BY {', '.join(ds)}"
    import itertools

    each = [part(c) for k in range(1, length + 1) for c in itertools.combinations(_SETS, k)]
    return f"WITH t AS {_Y}, s AS ({' UNION ALL '.join(each)}), f AS (SELECT * FROM s WHERE a >= 20)"


def _rendered(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join("items", " AND "))


@query(_sets_sql(2) + " SELECT items, a, b FROM f")
def pair_itemsets(spark, sf_dir):
    return _rendered(_itemsets(spark, sf_dir, 2))


@query(_sets_sql(3) + " SELECT items, a, b FROM f")
def triple_itemsets(spark, sf_dir):
    return _rendered(_itemsets(spark, sf_dir, 3))


@query(_sets_sql(3) + """ SELECT items, a, b FROM f WHERE NOT EXISTS (
  SELECT 1 FROM f AS g WHERE g.a = f.a AND g.b = f.b AND g.len > f.len AND len(list_intersect(string_split(f.items, ' AND '), string_split(g.items, ' AND '))) = f.len)""")
def closed_itemsets(spark, sf_dir):
    return _rendered(mining.closed(_itemsets(spark, sf_dir, 3)))


_ADMIT = ["l_small", "l_linestatus", "l_hightax"]


def _flags(spark, sf_dir) -> DataFrame:
    return planted(spark, sf_dir).withColumns({"l_small": F.expr("l_quantity <= 12 AND l_discount >= 0.07").cast("int"), "l_hightax": F.expr("l_tax >= 0.07").cast("int")})


@query(f"""WITH t AS (SELECT *, (l_quantity <= 12 AND l_discount >= 0.07)::INT AS l_small, (l_tax >= 0.07)::INT AS l_hightax FROM {_Y}),
s AS (SELECT 'l_hightax=' || l_hightax AS items, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM t GROUP BY l_hightax
UNION ALL SELECT 'l_small=' || l_small, sum(y), sum(1 - y) FROM t GROUP BY l_small
UNION ALL SELECT 'l_linestatus=' || l_linestatus, sum(y), sum(1 - y) FROM t GROUP BY l_linestatus
UNION ALL SELECT 'l_hightax=' || l_hightax || ' AND l_linestatus=' || l_linestatus, sum(y), sum(1 - y) FROM t GROUP BY l_hightax, l_linestatus
UNION ALL SELECT 'l_hightax=' || l_hightax || ' AND l_small=' || l_small, sum(y), sum(1 - y) FROM t GROUP BY l_hightax, l_small
UNION ALL SELECT 'l_linestatus=' || l_linestatus || ' AND l_small=' || l_small, sum(y), sum(1 - y) FROM t GROUP BY l_linestatus, l_small)
SELECT items, a, b FROM s WHERE a >= 20 AND a + b <= 1.05 * (SELECT sum(y) FROM t) AND a > b""")
def admission_filter(spark, sf_dir):
    t = _flags(spark, sf_dir)
    sets = mining.frequent_itemsets(mining.itemized(prep.compress(t, _ADMIT, "y"), _ADMIT, flag="y"), 20, 2)
    return _rendered(mining.admitted(sets, float(t.agg(F.sum("y")).first()[0])))


@query("""
WITH b AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type FROM events GROUP BY 1, 2, 3), n AS (SELECT count(DISTINCT (user_id, d)) AS n FROM b),
s AS (SELECT event_type AS items, count(*) AS freq FROM b GROUP BY 1
UNION ALL SELECT x.event_type || ' AND ' || y.event_type, count(*) FROM b x JOIN b y ON x.user_id = y.user_id AND x.d = y.d AND x.event_type < y.event_type GROUP BY 1)
SELECT items, freq FROM s, n WHERE freq >= ceil(0.02 * n)""")
def fpgrowth_itemsets(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    baskets = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_set("event_type").alias("items"))
    return _rendered(mining.extract_fpgrowth(baskets, "items", 0.02, 2))


# --- Rules ----------------------------------------------------------------------------------------

R1 = Rule((Predicate("l_quantity", "<=", 12.0), Predicate("l_discount", ">", 0.065)), 1)
R2 = Rule((Predicate("l_linestatus", "==", "F"), Predicate("l_tax", ">", 0.065)), 1)
R3 = Rule((Predicate("l_returnflag", "==", "R"), Predicate("l_linenumber", "<=", 3)), 1)
_RSQL = {"R1": "(l_quantity <= 12 AND l_discount > 0.065)", "R2": "(l_linestatus = 'F' AND l_tax > 0.065)", "R3": "(l_returnflag = 'R' AND l_linenumber <= 3)"}


def _report_sql(table: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{str(r)}' AS rules, (count(*) FILTER ({s} AND y = 1))::DOUBLE AS a, (count(*) FILTER ({s} AND y = 0))::DOUBLE AS b FROM {table}" for r, s in ((R1, _RSQL["R1"]), (R2, _RSQL["R2"]), (R3, _RSQL["R3"])))
    return rows.replace("'F'' AS", "'F' AS")


@query(f"""WITH t AS {_Y}, n AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM t), r AS ({_report_sql("t")})
SELECT rules, a + b AS count, round(a / (a + b), 4) AS ratio, a, b, p - a AS c, n - p - b AS d, round((a / (a + b)) / ((p - a + 1e-4) / (n - a - b + 1e-4)), 4) AS score FROM r, n""")
def rule_report(spark, sf_dir):
    return scoring.report(planted(spark, sf_dir), [R1, R2, R3], F.col("y"))


@query(f"WITH t AS {_Y}, r AS ({_report_sql('t')}) SELECT rules, a + b AS tot_count, a AS label_count, round(a / (a + b), 4) AS label_ratio FROM r")
def rule_score_new(spark, sf_dir):
    model = DrillUp("y", 1)
    model.used, model.kept, model.rules = [], {}, [R1, R2, R3]
    return model.rule_score(planted(spark, sf_dir))


_PAIRS = (("R1", "R2"), ("R1", "R3"), ("R2", "R3"))


@query(" UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, round(count(*) FILTER ({_RSQL[a]} AND {_RSQL[b]})::DOUBLE / count(*) FILTER ({_RSQL[a]} OR {_RSQL[b]}), 6) AS jaccard FROM lineitem" for a, b in _PAIRS))
def jaccard_pairs(spark, sf_dir):
    near = scoring.jaccard(read_table(spark, sf_dir, "lineitem"), [R1, R2, R3])
    return spark.createDataFrame([(f"R{i + 1}-R{j + 1}", float(v)) for (i, j), v in near.items()], "pair string, jaccard double").withColumn("jaccard", _r("jaccard", 6))


@query("SELECT 'R' || x AS rule, round((SELECT sum(1 - j) FROM (" + " UNION ALL ".join(
    f"SELECT {a[1]} AS a, {b[1]} AS b, count(*) FILTER ({_RSQL[a]} AND {_RSQL[b]})::DOUBLE / count(*) FILTER ({_RSQL[a]} OR {_RSQL[b]}) AS j FROM lineitem" for a, b in _PAIRS)
    + ") p WHERE p.a = x OR p.b = x), 6) AS overlap FROM (VALUES (1), (2), (3)) v(x)")
def rule_overlap(spark, sf_dir):
    near = scoring.jaccard(read_table(spark, sf_dir, "lineitem"), [R1, R2, R3])
    return spark.createDataFrame([(f"R{i + 1}", float(scoring.overlap(near, i, [0, 1, 2]))) for i in range(3)], "rule string, overlap double").withColumn("overlap", _r("overlap", 6))


@query(f"SELECT (count(*) FILTER (y = 1 AND ({_RSQL['R1']} OR {_RSQL['R3']})))::DOUBLE AS covered FROM {_Y}")
def union_coverage(spark, sf_dir):
    return spark.createDataFrame([(scoring.union_coverage(planted(spark, sf_dir), [R1, R3], F.col("y")),)], "covered double")


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, round(avg(y) FILTER ({s}), 6) AS accuracy FROM {_Y}" for n, s in _RSQL.items()))
def rule_accuracy(spark, sf_dir):
    counts = scoring.rule_counts(planted(spark, sf_dir), [R1, R2, R3], F.col("y"))
    return spark.createDataFrame([(f"R{i + 1}", round(scoring.accuracy(a, b), 6)) for i, (a, b) in enumerate(counts)], "rule string, accuracy double")


@query(" UNION ALL ".join(f"""SELECT '{n}' AS rule, round(CASE WHEN a / (a + b) > p / n THEN sqrt(a) * (CASE WHEN a > 0 THEN a / (a + b) * ln(a / (a + b) / greatest(p / n, 1e-9)) ELSE 0 END
+ CASE WHEN b > 0 THEN b / (a + b) * ln(b / (a + b) / greatest(1 - p / n, 1e-9)) ELSE 0 END) ELSE 0 END, 4) AS kl
FROM (SELECT (count(*) FILTER ({s} AND y = 1))::DOUBLE AS a, (count(*) FILTER ({s} AND y = 0))::DOUBLE AS b, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM {_Y})""" for n, s in _RSQL.items()))
def kl_quality(spark, sf_dir):
    t = planted(spark, sf_dir)
    n, p = (float(x) for x in t.agg(F.count(F.lit(1)), F.sum("y")).first())
    rows = [(f"R{i + 1}", round(scoring.kl_quality({1: a, 0: b}, {1: p, 0: n - p}, 1), 4)) for i, (a, b) in enumerate(scoring.rule_counts(t, [R1, R2, R3], F.col("y")))]
    return spark.createDataFrame(rows, "rule string, kl double")


@query(f"""SELECT (count(*) FILTER (w > 0 AND y = 1) - count(*) FILTER (w > 0 OR y <> 0) - 6.0)::DOUBLE AS objective FROM
(SELECT y, CASE WHEN {_RSQL['R1']} THEN 1 WHEN {_RSQL['R2']} THEN 2 WHEN {_RSQL['R3']} THEN 3 ELSE 0 END AS w FROM {_Y})""")
def list_objective(spark, sf_dir):
    return spark.createDataFrame([(scoring.list_objective(planted(spark, sf_dir), [R1, R2, R3], 0, "y"),)], "objective double")


LIST = RuleList([Rule((Predicate("o_totalprice", ">", 200000.0),), "large"), Rule((Predicate("o_orderpriority", "==", "1-URGENT"), Predicate("o_orderstatus", "!=", "F")), "urgent")], "plain")
_WHICH = "CASE WHEN o_totalprice > 200000 THEN {0} WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN {1} ELSE {2} END"


@query(f"SELECT o_orderkey, {_WHICH.format("'large'", "'urgent'", "'plain'")} AS prediction FROM orders")
def rulelist_predict(spark, sf_dir):
    return LIST.predict(read_table(spark, sf_dir, "orders")).select("o_orderkey", "prediction")


@query(f"SELECT {_WHICH.format(0, 1, -1)} AS rule, count(*) AS n FROM orders GROUP BY 1")
def which_rule(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").groupBy(LIST.matched_rule().alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_RSQL['R1']} OR {_RSQL['R2']} THEN 'hit' ELSE 'none' END AS prediction FROM lineitem")
def ruleset_predict(spark, sf_dir):
    return RuleSet([R1, R2], "hit", "none").predict(read_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "prediction")


@query("""WITH s AS (SELECT o_orderstatus AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), p AS (SELECT max(o_orderpriority) AS v FROM orders), k AS (SELECT count(DISTINCT o_custkey) AS v FROM orders)
SELECT 0 AS line, 'IF o_custkey <= ' || k.v || ' AND o_orderpriority == ' || p.v || ' THEN late' AS text FROM p, k
UNION ALL SELECT 1, 'ELIF o_orderstatus != ' || s.v || ' THEN rare' FROM s UNION ALL SELECT 2, 'ELSE ' || s.v FROM s""")
def render_rules(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders")
    top = prep.default_label(df, "o_orderstatus")
    last, keys = df.agg(F.max("o_orderpriority"), F.countDistinct("o_custkey")).first()
    rules = RuleList([Rule((Predicate("o_orderpriority", "==", last), Predicate("o_custkey", "<=", int(keys))), "late"), Rule((Predicate("o_orderstatus", "!=", top),), "rare")], top)
    return _lines(spark, rules.render())


def _lines(spark, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


# --- Clusters -------------------------------------------------------------------------------------

_DIMENSIONS = 64
_BITS = [f"b{i}" for i in range(_DIMENSIONS)]


def _sign_bits(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[(F.element_at("embedding", i + 1) > 0).cast("double").alias(b) for i, b in enumerate(_BITS)])


_C = [[int(i // 4 % 2 == 1) for i in range(_DIMENSIONS)], [int(i < _DIMENSIONS // 2) for i in range(_DIMENSIONS)], [int(i % 2 == 0) for i in range(_DIMENSIONS)]]
_W = [[1 / _DIMENSIONS] * _DIMENSIONS, [(3 if i < 16 else 1) / 96 for i in range(_DIMENSIONS)], [(1 + i % 2 * 2) / 128 for i in range(_DIMENSIONS)]]
_BITS_SQL = "SELECT vec_id, " + ", ".join(f"(embedding[{i + 1}] > 0)::INT AS {b}" for i, b in enumerate(_BITS)) + " FROM embeddings"
_DIST_SQL = ", ".join("round(" + " + ".join(f"{w!r}::DOUBLE * (b{i} <> {c})::INT" for i, (w, c) in enumerate(zip(ws, cs, strict=True))) + f", 9) AS d{k}" for k, (ws, cs) in enumerate(zip(_W, _C, strict=True)))
_NEAR_SQL = f"SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, least(d0, d1, d2) AS distance FROM (SELECT *, {_DIST_SQL} FROM ({_BITS_SQL}))"


def _centers():
    import numpy as np

    return np.array(_C, float), np.array(_W)


@query(f"SELECT vec_id, cluster, round(distance, 6)::DOUBLE AS distance FROM ({_NEAR_SQL})")
def wkmodes_assign(spark, sf_dir):
    return wkmodes.assigned(_sign_bits(spark, sf_dir), _BITS, *_centers()).select("vec_id", "cluster", _r("distance", 6).alias("distance"))


@query(f"SELECT cluster, count(*)::DOUBLE AS n, " + ", ".join(f"floor(avg({b}) + 0.5) AS {b}" for b in _BITS) + f" FROM ({_NEAR_SQL}) GROUP BY cluster")
def wkmodes_update(spark, sf_dir):
    import numpy as np

    n, sums = wkmodes.updated(wkmodes.assigned(_sign_bits(spark, sf_dir), _BITS, *_centers()), _BITS, 3)
    rows = [(k, float(n[k]), *map(float, np.floor(sums[k] / n[k] + 0.5))) for k in range(3) if n[k]]
    return spark.createDataFrame(rows, "cluster int, n double, " + ", ".join(f"{b} double" for b in _BITS))


# --- Additive model -------------------------------------------------------------------------------


@query("SELECT DISTINCT l_discount AS threshold FROM lineitem")
def gam_thresholds(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in gam.thresholds(read_table(spark, sf_dir, "lineitem"), "l_discount", 64)], "threshold double")


_CUTS = [1.0, 10.0, 20.0, 35.0]


@query("SELECT c AS cut, round(sum(1.0) FILTER (l_quantity >= c), 2)::DOUBLE AS w, round(sum(l_quantity) FILTER (l_quantity >= c), 2) AS wx, round(sum(l_quantity * l_quantity) FILTER (l_quantity >= c), 2) AS wxx FROM lineitem, (VALUES (1.0::DOUBLE), (10.0), (20.0), (35.0)) v(c) GROUP BY c")
def gam_suffix_sums(spark, sf_dir):
    rows = gam.suffix_sums(read_table(spark, sf_dir, "lineitem"), "l_quantity", _CUTS)
    return spark.createDataFrame([tuple(round(v, 2) for v in r) for r in rows], "cut double, w double, wx double, wxx double")


@query("""WITH z AS (SELECT 1.0::DOUBLE AS z0, l_quantity - 1.0 AS z1, greatest(l_quantity - 25.0, 0) AS z2, l_discount - 0.0 AS z3, l_extendedprice / 1000 AS y FROM lineitem),
l AS (SELECT unnest([0, 1, 2, 3]) AS i, unnest([z0, z1, z2, z3]) AS a, [z0, z1, z2, z3, y] AS b FROM z)
SELECT i, j, round(sum(a * b[j + 1]), 1) AS v FROM l, (VALUES (0), (1), (2), (3), (4)) t(j) GROUP BY i, j""")
def gam_gram(spark, sf_dir):
    import numpy as np

    df = read_table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    q, r, *_ = gam.gram(df, ["l_quantity", "l_discount"], "y", [[1.0, 25.0], [0.0]], np.zeros(2), np.ones(2))
    rows = [(i, j, float(v)) for i in range(4) for j, v in enumerate([*q[i], r[i]])]
    return spark.createDataFrame(rows, "i int, j int, v double").withColumn("v", _r("v", 1))


_SEGMENTS = [(1.0, 2.0, 0.5), (10.0, 6.5, -0.25), (30.0, 1.5, 1.0)]


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity >= 30 THEN 1.5 + (l_quantity - 30) WHEN l_quantity >= 10 THEN 6.5 - 0.25 * (l_quantity - 10) ELSE 2.0 + 0.5 * (l_quantity - 1) END, 4)::DOUBLE AS effect FROM lineitem")
def gam_predict_fixed(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(gam.piecewise(F.col("l_quantity"), _SEGMENTS)).alias("effect"))


# --- Attribution ----------------------------------------------------------------------------------

_K = {"c_acctbal": 0.5, "c_nationkey": -2.0}


@query("SELECT c_custkey, round(0.5 * (c_acctbal - (SELECT avg(c_acctbal) FROM customer)), 4) AS s_bal, round(-2.0 * (c_nationkey - (SELECT avg(c_nationkey) FROM customer)), 4)::DOUBLE AS s_nation FROM customer")
def shap_linear_origin(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer")
    out = attribution.shap_linear(df, _K, attribution.background_mean(df, list(_K)))
    return out.select("c_custkey", _r("c_acctbal__shap").alias("s_bal"), _r("c_nationkey__shap").alias("s_nation"))


@query("SELECT c_custkey, round(0.5 * (c_acctbal - c_custkey), 4) AS s_bal, round(-2.0 * (c_nationkey - c_custkey % 25), 4)::DOUBLE AS s_nation FROM customer")
def shap_linear_match(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer")
    out = attribution.shap_linear(df, _K, {"c_acctbal": F.col("c_custkey").cast("double"), "c_nationkey": (F.col("c_custkey") % 25).cast("double")})
    return out.select("c_custkey", _r("c_acctbal__shap").alias("s_bal"), _r("c_nationkey__shap").alias("s_nation"))


@query("""SELECT p_partkey, round(((p_size - 10) * 100.0 + (p_size * p_retailprice - 10 * p_retailprice)) / 2 / 100, 4) AS s_size,
round(((p_retailprice - 100) * 10.0 + (p_size * p_retailprice - p_size * 100.0)) / 2 / 100, 4) AS s_price FROM part""")
def shap_exact_small(spark, sf_dir):
    out = attribution.shap_exact(read_table(spark, sf_dir, "part"), lambda c: c["p_size"] * c["p_retailprice"] / 100, ["p_size", "p_retailprice"], {"p_size": 10.0, "p_retailprice": 100.0})
    return out.select("p_partkey", _r("p_size__shap").alias("s_size"), _r("p_retailprice__shap").alias("s_price"))


def _grad(c):
    return {"p_size": 2 * c["p_size"] + c["p_retailprice"], "p_retailprice": c["p_size"]}


@query("SELECT p_partkey, round(p_size * p_size + p_size * p_retailprice / 2, 3) AS ig_size, round(p_size * p_retailprice / 2, 3) AS ig_price FROM part")
def ig_quadratic(spark, sf_dir):
    out = attribution.integrated_gradients(read_table(spark, sf_dir, "part"), _grad, ["p_size", "p_retailprice"], steps=10)
    return out.select("p_partkey", _r("p_size__ig", 3).alias("ig_size"), _r("p_retailprice__ig", 3).alias("ig_price"))


@query("SELECT p_partkey, round(p_size * p_size + p_size * p_retailprice, 2)::DOUBLE AS total, 0.0::DOUBLE AS error FROM part")
def ig_completeness(spark, sf_dir):
    """The attributions of each row add up to what the model gains over the zero baseline."""
    names = ["p_size", "p_retailprice"]
    out = attribution.integrated_gradients(read_table(spark, sf_dir, "part"), _grad, names, steps=10)
    e = attribution.completeness(out, lambda c: c["p_size"] * c["p_size"] + c["p_size"] * c["p_retailprice"], names, {n: 0.0 for n in names})
    return out.select("p_partkey", _r(F.col("p_size__ig") + F.col("p_retailprice__ig"), 2).alias("total"), F.lit(abs(round(e, 6))).alias("error"))


# --- Temporal -------------------------------------------------------------------------------------

_PATCH = 7


def _padded_days(spark, sf_dir) -> int:
    """Days of the whole table from 2024-01-01 on, up to a multiple of the patch; the days added are empty."""
    last = read_table(spark, sf_dir, "events").agg(F.max(F.datediff(F.to_date("ts"), F.lit("2024-01-01")))).first()[0]
    return max(1, -(-((last or 0) + 1) // _PATCH)) * _PATCH


def series(spark, sf_dir) -> tuple[DataFrame, int]:
    """(user_id, spend, visits) with an entry a day of the whole table, and the number of patches."""
    length = _padded_days(spark, sf_dir)
    e = read_table(spark, sf_dir, "events").withColumn("t", F.datediff(F.to_date("ts"), F.lit("2024-01-01")))
    daily = e.groupBy("user_id", "t").agg(F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    maps = daily.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("mv"), F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("mn"))
    days = F.sequence(F.lit(0), F.lit(length - 1))

    def filled(m: str):
        return F.transform(days, lambda t: F.coalesce(F.try_element_at(F.col(m), t), F.lit(0.0)))

    return maps.select("user_id", filled("mv").alias("spend"), filled("mn").alias("visits")), length // _PATCH


def weighted_sum(times: float = 1.0):
    def model(c):
        total = lambda a, k: F.aggregate(F.transform(a, lambda v, t: v * (t + 1) * k * times), F.lit(0.0), lambda x, y: x + y)
        return total(c["spend"], 0.01) + total(c["visits"], 1.0)

    return model


#: A linear model against the mean series: a patch's own share is its weighted distance from the mean, less the mean of these shares.
CLOSED = f"""
WITH e AS (SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS t, value FROM events),
days AS (SELECT unnest(range(0, (SELECT (max(t) // {_PATCH} + 1) * {_PATCH} FROM e))) AS t),
u AS (SELECT DISTINCT user_id FROM e), x AS (
  SELECT u.user_id, d.t, coalesce(sum(e.value), 0) * (d.t + 1) * 0.01 AS spend, count(e.value)::DOUBLE * (d.t + 1) AS visits
  FROM u CROSS JOIN days d LEFT JOIN e ON e.user_id = u.user_id AND e.t = d.t GROUP BY 1, 2),
m AS (SELECT t, avg(spend) AS spend, avg(visits) AS visits FROM x GROUP BY t),
p AS (SELECT x.user_id, 'spend' AS feature, x.t // {_PATCH} AS i, sum(x.spend - m.spend) AS d FROM x JOIN m USING (t) GROUP BY 1, 3
  UNION ALL SELECT x.user_id, 'visits', x.t // {_PATCH}, sum(x.visits - m.visits) FROM x JOIN m USING (t) GROUP BY 1, 3),
b AS (SELECT *, avg(d) OVER (PARTITION BY user_id, feature) AS base FROM p),
inter AS (SELECT a.user_id, a.feature, a.i::INT AS i, c.i::INT AS j, CASE WHEN a.i = c.i THEN a.d - a.base WHEN c.i = a.i + 1 THEN a.base ELSE 0 END AS value
  FROM b a JOIN b c ON a.user_id = c.user_id AND a.feature = c.feature AND a.i <= c.i),
spread AS (SELECT user_id, feature, unnest(range(i, j + 1))::INT AS patch, value / (j - i + 1) AS v FROM inter)
"""


def _found(spark, sf_dir) -> tuple[DataFrame, int]:
    s, n = series(spark, sf_dir)
    return temporal.effects(s, "user_id", ["spend", "visits"], weighted_sum(), temporal.gaussian_mean(s, ["spend", "visits"]), _PATCH), n


@query(CLOSED + " SELECT user_id, feature, i, j, round(value, 3) + 0.0 AS value FROM inter")
def patch_interaction(spark, sf_dir):
    found, n = _found(spark, sf_dir)
    return temporal.by_span(found, "user_id", "inter", n).withColumn("value", _r("value", 3) + F.lit(0.0))


@query(CLOSED + " SELECT user_id, feature, patch, round(sum(v), 3) + 0.0 AS value FROM spread GROUP BY 1, 2, 3")
def patch_main_effect(spark, sf_dir):
    return temporal.by_patch(_found(spark, sf_dir)[0], "user_id").withColumn("value", _r("value", 3) + F.lit(0.0))


@query(CLOSED + " SELECT user_id, feature, patch, t, round(sum(v) * (t + 1), 2) + 0.0 AS value FROM spread, (VALUES (0), (1)) steps(t) GROUP BY 1, 2, 3, 4")
def temporal_explain(spark, sf_dir):
    """Both output steps of a model, the whole table in patches of seven days."""
    s, _ = series(spark, sf_dir)
    names = ["spend", "visits"]
    explainer = temporal.TemporalExplainer({t: weighted_sum(t + 1) for t in range(2)}, names, generator=lambda b: temporal.gaussian_mean(b, names))
    main, _ = explainer.explain(s, "user_id", s, _PATCH, only_last=False)
    return main.withColumn("value", _r("value", 2) + F.lit(0.0))
