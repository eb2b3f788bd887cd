import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clarispark.functions.linalg import covering_lp, nnls, t_quantile
from clarispark.functions.predicates import Predicate, Rule, RuleList, RuleSet, save_rules
from clarispark.functions.ranks import quantiles, values_at
from clarispark.operators import mining, prep, scoring
from clarispark.operators.binarize import FeatureBinarizer, TabularDataHandler, process_input
from clarispark.operators.diver import Diver
from clarispark.operators.drillup import DrillUp
from clarispark.operators.rulelist import RuleListLearner
from clarispark.operators.ruleset import ImbalancedRuleSetLearner, RuleSetLearner
from clarispark.operators.signatures import Signatures, additive, grow
from clarispark.operators.wkmodes import WKModes, extract_wkmodes
from clarispark.sources.datasets import DatasetLoader, ensure_dataframe, read_headerless, tic_tac_toe, write_rules


@pytest.fixture(scope="module")
def boards(spark):
    return tic_tac_toe(spark).persist()


CELLS = [f"s{i}" for i in range(9)]


def accuracy(df, label):
    return df.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0]


def test_boards(boards):
    assert {r["label"]: r["count"] for r in boards.groupBy("label").count().collect()} == {"positive": 626, "negative": 332}


def test_null_semantics(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    hit = lambda p: [r[0] for r in df.select(p.column()).collect()]
    assert hit(Predicate("x", "<=", 2.0)) == [False, True, False]
    assert hit(Predicate("x", ">", 2.0)) == [False, False, True]
    assert hit(Predicate("x", "!=", 1.0)) == [True, False, True]
    assert hit(Predicate("x", "null")) == [True, False, False]


def test_binarizer(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i) if i else None, "xyz"[i % 3]) for i in range(40)], "k int, two string, num double, cat string")
    b = FeatureBinarizer(num_thresh=3, negation=True, return_ordinals=True).fit(df, ["two", "num", "cat"])
    names = [str(p) for p in b.predicates]
    assert names[:2] == ["two", "NOT two"] and "cat == x" in names and "num == NaN" in names and len(b.thresholds["num"]) == 3
    row = b.transform(df, ["k"]).where("k = 0").first()
    assert row["num == NaN"] == 1 and row["num"] == 0.0 and all(row[n] == 0 for n in names if n.startswith("num <"))
    assert TabularDataHandler(num_thresh=2).preprocess(df, ["cat"], ["k"]).count() == 40
    with pytest.raises(ValueError):
        process_input(df, ["cat"])
    with pytest.raises(ValueError):
        process_input(df, ["absent"])
    with pytest.raises(ValueError):
        FeatureBinarizer().fit(df.withColumn("d", F.current_date()), ["d"])


def test_first_match_equals_brute_force(boards):
    rules = [Rule((Predicate("s4", "==", "x"), Predicate("s0", "==", "x")), "a"), Rule((Predicate("s4", "==", "o"),), "b")]
    model = RuleList(rules, "c")
    got = boards.select(*CELLS, model.predict_column().alias("p"), model.matched_rule().alias("m")).toPandas()
    for _, r in got.iterrows():
        want = next(((x.label, i) for i, x in enumerate(rules) if all(r[p.feature] == p.value for p in x.conditions)), ("c", -1))
        assert (r["p"], r["m"]) == want
    assert RuleList([], "c").predict(boards).where("prediction <> 'c'").count() == 0
    assert RuleSet([]).predict(boards).where("prediction <> 0").count() == 0
    assert RuleSet([Rule(())]).predict(boards).where("prediction <> 1").count() == 0


def test_rule_list_learner(boards, tmp_path):
    m = RuleListLearner(complexity=5, num_thresh=2, negation=False).fit(boards, CELLS, "label")
    assert accuracy(m.predict(boards), "label") >= 0.98
    save_rules(m.model, str(tmp_path / "rules.txt"))
    assert (tmp_path / "rules.txt").read_text().startswith("IF ")
    with pytest.raises(ValueError):
        RuleListLearner().fit(boards, CELLS, "label", default="absent")


def test_rule_list_multiclass(spark):
    df = spark.createDataFrame([(20 + 3 * i, 10 * i, "low" if i < 4 else "mid" if i < 8 else "high") for i in range(12)], "age long, income long, risk string")
    m = RuleListLearner(complexity=0.1, num_thresh=9).fit(df, ["age", "income"], "risk")
    assert accuracy(m.predict(df), "risk") == 1.0


def test_rule_sets(boards):
    assert accuracy(RuleSetLearner(max_num_rules=15, negation=False).fit(boards, CELLS, "label").predict(boards), "label") >= 0.91
    assert accuracy(ImbalancedRuleSetLearner(max_num_rules=15, negation=False).fit(boards, CELLS, "label").predict(boards), "label") >= 0.96
    with pytest.raises(ValueError):
        RuleSetLearner().fit(boards, CELLS, "s0")


def test_diver(boards, tmp_path):
    m = Diver("label", "positive", write_model=str(tmp_path)).fit(boards, CELLS)
    assert m.duality_gap < 1e-6 and m.rules
    assert accuracy(m.predict(boards).withColumn("prediction", F.when(F.col("prediction") == 1, "positive").otherwise("negative")), "label") > 0.9
    assert (tmp_path / "model0.lp").read_text().startswith("Minimize")
    with pytest.raises(ValueError):
        Diver("label", "positive", max_columns=10).fit(boards, CELLS)


def test_search_equals_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        truth, change = rng.random((40, 7)) < rng.uniform(0.3, 0.8), rng.normal(size=40)
        sig = Signatures([Predicate(f"p{i}", "") for i in range(7)], truth, [0, 1], np.zeros((40, 2)))
        for most in (2, None):
            each = [(c, change[truth[:, list(c)].all(1)].sum() - 0.1 * n) for n in range(1, (most or 7) + 1) for c in itertools.combinations(range(7), n) if truth[:, list(c)].all(1).any()]
            items, gain = grow(sig, *additive(change, 0.1), most)
            assert gain == pytest.approx(max(0.0, max(g for _, g in each)))
            if items:
                assert dict(each)[items] == pytest.approx(gain)
    with pytest.raises(ValueError):
        grow(sig, *additive(change, 0.0), most_nodes=1)


def test_a_conjunction_without_marginal_gain_is_found(spark):
    """Neither of two columns tells the outcome alone; both together do, among thirty that tell nothing."""
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.integers(0, 2, (400, 8)), columns=[f"c{i}" for i in range(8)])
    data["y"] = data["c3"] ^ data["c6"]
    df = spark.createDataFrame(data)
    m = RuleSetLearner().fit(df, [f"c{i}" for i in range(8)], "y")
    assert accuracy(m.predict(df), "y") == 1.0


def test_drillup(boards):
    m = DrillUp("label", "positive", dims=CELLS, min_dim_val_cnt=1, sup_ratio=0.05, jcd_limit=0.5).fit(boards)
    assert m.rules and m.report.where("ratio <= 0.5").count() == 0
    near = scoring.jaccard(boards, m.rules[:8])
    assert all(v <= 0.5 for v in near.values())
    assert {r[0] for r in m.predict(boards).select("prediction").distinct().collect()} <= {0, 1}
    assert m.rule_score(boards).count() == len(m.rules)


def test_itemsets_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.integers(0, 3, (200, 3)), columns=list("abc"))
    data["flag"] = (data["a"] == 1).astype(int)
    groups = prep.compress(spark.createDataFrame(data), list("abc"), "flag")
    got = {tuple(r["items"]): (r["a"], r["b"]) for r in mining.frequent_itemsets(mining.itemized(groups, list("abc")), 5, 3).collect()}
    want = {}
    for k in (1, 2, 3):
        for cols in itertools.combinations("abc", k):
            for vals, g in data.groupby(list(cols)):
                a = int(g["flag"].sum())
                if a >= 5:
                    want[tuple(f"{c}={v}" for c, v in zip(cols, vals, strict=True))] = (a, len(g) - a)
    assert got == want


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=3000), np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 5, 3000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(7).withColumns({"z": F.when(F.col("x") > 0, F.col("x")), "none": F.lit(None).cast("double"), "n": F.lit(float("nan"))})
    fractions = [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]
    got = quantiles(df, ["x", "y", "z", "none", "n"], fractions)
    for name, values in (("x", x), ("y", y), ("z", x[x > 0])):
        assert np.allclose(got[name], np.quantile(values, fractions), atol=1e-12)
    assert got["none"] == got["n"] == [] and quantiles(df.limit(0), ["x"], [0.5]) == {"x": []}
    assert values_at(df, {"y": [0, 1, 5]}, distinct=True)["y"] == [0.0, 1.0, 7.0]


def test_prep(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"v{i}", "same") for i in range(40)], "id int, many string, one string")
    assert prep.bad_columns(df, ["many", "one"]) == ["many", "one"]
    folded, kept = prep.fold_long_tail(prep.fill_missing(df, ["many"]), ["many"], 2)
    assert {r[0] for r in folded.select("many").distinct().collect()} == {"unknown<", "other<"} and kept == {"many": ["unknown<"]}
    assert prep.filter_by_pattern(df, {"many": prep.MISSING}).count() == 8
    flagged = spark.range(20000).withColumn("y", (F.col("id") == 0).cast("int"))
    assert prep.downsample_negatives(flagged, "y", "id").where("y = 1").count() == 1
    assert prep.downsample_negatives(flagged, "y", "id").count() < 1500


def test_loaders(spark, tmp_path):
    d = tmp_path / "toy"
    d.mkdir()
    (d / "data.csv").write_text("a,cls\n1,good\n2,bad\n")
    (d / "meta.json").write_text(json.dumps({"label": "cls", "positive": "cls = 'good'"}))
    df = DatasetLoader(spark, "toy", str(tmp_path)).dataframe
    assert df.columns == ["a", "label"] and [r["label"] for r in df.orderBy("a").collect()] == [1, 0]
    (tmp_path / "bare.csv").write_bytes(b"\xef\xbb\xbfx,1,yes\no,2,no\n")
    assert [tuple(r) for r in read_headerless(spark, str(tmp_path / "bare.csv")).orderBy("1").collect()] == [("x", 1, "yes"), ("o", 2, "no")]
    with pytest.raises(ValueError):
        read_headerless(spark, str(tmp_path / "bare.csv"), names=["one"])
    assert ensure_dataframe(spark, np.zeros((3, 2)), [0, 1, 0]).columns == ["f0", "f1", "label"]
    with pytest.raises(ValueError):
        ensure_dataframe(spark, np.zeros((3, 2)), [0, 1])
    write_rules(spark, ["IF a THEN b"], str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "IF a THEN b"


def test_rf_and_fpgrowth(spark):
    df = spark.createDataFrame([(i % 2, i // 2 % 2, (i % 2) & (i // 2 % 2)) for i in range(40)], "p int, q int, y int")
    assert any({c.feature for c in r.conditions} == {"p", "q"} for r in mining.extract_rf(df, ["p", "q"], "y", 5, 3))
    items = spark.createDataFrame([(["a", "b"],), (["a"],)], "items array<string>")
    assert {tuple(r["items"]): r["freq"] for r in mining.extract_fpgrowth(items, "items", 0.5).collect()} == {("a",): 2, ("b",): 1, ("a", "b"): 1}


def test_wkmodes(spark):
    df = spark.createDataFrame([((1, 1, 0, 0) if i % 2 else (0, 0, 1, 1)) + (i % 2,) for i in range(40)], "a int, b int, c int, d int, y int")
    for init in ("huang", "random", "cao"):
        m = WKModes(2, init=init).fit(df, list("abcd"))
        assert m.converged and m.predict(df).groupBy("cluster", "y").count().count() == 2
    rules = extract_wkmodes(df, list("abcd"), "y", 1, 1)
    assert df.where(rules[0].column()).where("y = 0").count() == 0


def test_solvers():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=30)
    x = nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g >= -1e-8).all() and abs(x @ g) < 1e-8
    for _ in range(20):
        cover = (rng.random((6, 5)) < 0.5).astype(float)
        cost, slack = rng.random(5) * 3, rng.random(6) * 2
        x, y, dual, value = covering_lp(cost, cover, slack)
        assert (y + cover @ x >= 1 - 1e-7).all() and (dual >= -1e-9).all() and (cover.T @ dual <= cost + 1e-7).all()
        assert abs(value - dual.sum()) < 1e-6
    assert abs(t_quantile(0.975, 10) - 2.228138852) < 1e-6


def test_kl_and_objective(spark):
    assert scoring.kl_quality({1: 1, 0: 3}, {1: 5, 0: 5}, 1) == 0.0
    assert scoring.kl_quality({1: 4, 0: 0}, {1: 5, 0: 5}, 1) == pytest.approx(2 * np.log(2))
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "x int, y int")
    assert scoring.list_objective(df, [Rule((Predicate("x", "==", 1),), 1)], 0, "y", 1.0) == 1 - 2 - 1
