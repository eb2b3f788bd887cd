import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clarispark.operators import attribution as at
from clarispark.operators import gam, temporal


@pytest.fixture(scope="module")
def additive(spark):
    rng = np.random.default_rng(42)
    x1, x2, x3 = rng.uniform(-1, 10, 1000), rng.normal(-10, 1, 1000), rng.uniform(-15, 15, 1000)
    return spark.createDataFrame(pd.DataFrame({"x1": x1, "x2": x2, "x3": x3, "y": x1 + 10 * x2**2 - np.sin(x3) + rng.normal(0, 0.1, 1000)}))


def test_gam_fit_and_contributions(additive):
    m = gam.GAM().fit(additive, ["x1", "x2", "x3"], "y")
    assert m.r2(additive) > 0.999
    both = m.contributions(m.predict(additive)).select((F.col("x1__effect") + F.col("x2__effect") + F.col("x3__effect")).alias("s"), "prediction")
    assert both.where("abs(s - prediction) > 1e-6 * (1 + abs(prediction))").count() == 0
    wide = m.pointwise_confidence(additive)
    assert wide.where("lower > prediction OR upper < prediction").count() == 0
    assert all(lo <= y <= hi for rows in m.confidence().values() for _, y, lo, hi in rows)
    assert m.waterfall(additive.withColumn("id", F.monotonically_increasing_id()), "id").count() == 3000


def test_gam_constraints(additive):
    for kind, test in (("inc", lambda d: (np.diff(d) >= -1e-6).all()), ("dec", lambda d: (np.diff(d) <= 1e-6).all())):
        m = gam.GAM(max_iter=30).fit(additive, ["x1", "x2", "x3"], "y").add_constraint(-100, 100, kind, "x3").update(20)
        assert test([y for _, y, _ in m.segments("x3")])
        assert abs(m.predict(additive).agg(F.avg(F.col("prediction") - F.col("y"))).first()[0]) < 1e-6  # the constant follows the shapes
    m = gam.GAM(max_iter=30).fit(additive, ["x1", "x2", "x3"], "y").add_constraint(-100, 100, "concave", 1).update(20)
    assert (np.diff([s for *_, s in m.segments("x2")][:-1]) <= 1e-6).all()
    with pytest.raises(ValueError):
        m.add_constraint(0, 1, "sideways", "x1")
    assert gam.merged([(0, 2, "Increase"), (1, 3, "Decrease"), (3, 4, "Decrease")]) == [(0, 1, "Increase"), (1, 2, "Flat"), (2, 4, "Decrease")]


def test_gam_edits(additive):
    m = gam.GAM(max_iter=20).fit(additive, ["x1", "x2", "x3"], "y").set_prediction("x1", 0.0).set_prediction("x3", lambda x: x * 0)
    assert m.contributions(additive, True).where("x1__effect <> 0 OR x3__effect <> 0").count() == 0
    before = m.segments("x2")
    assert m.update_weights(-100, 100, 0.0, "x2").segments("x2") != before
    with pytest.raises(ValueError):
        m.predict(additive.drop("x1"))


def test_gram_equals_numpy(additive):
    p = additive.toPandas()
    q, r, yy, sw, sy = gam.gram(additive, ["x1", "x3"], "y", [[-1.0, 3.0], [0.0]], np.zeros(2), np.ones(2))
    z = np.column_stack([np.ones(len(p)), p.x1 + 1, np.maximum(p.x1 - 3, 0), p.x3])
    assert np.allclose(q, z.T @ z) and np.allclose(r, z.T @ p.y) and sw == 1000 and np.isclose(yy, (p.y**2).sum()) and np.isclose(sy, p.y.sum())


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame(pd.DataFrame({"id": range(20), **{c: rng.normal(size=20) for c in "abc"}}))


def test_shap_is_complete(points):
    model = lambda c: c["a"] * c["b"] + F.exp(c["c"])
    base = {"a": 0.5, "b": -1.0, "c": 0.0}
    out = at.shap_exact(points, model, list("abc"), base)
    p = out.toPandas()
    want = p.a * p.b + np.exp(p.c) - (0.5 * -1.0 + 1.0)
    assert np.allclose(p.a__shap + p.b__shap + p.c__shap, want)
    sampled = at.shap_sampled(points, "id", lambda x: x.a * x.b + np.exp(x.c), list("abc"), pd.DataFrame([base]), permutations=64).groupBy("id").agg(F.sum("value").alias("v")).orderBy("id").toPandas()
    assert np.allclose(sampled.v, p.sort_values("id").a * p.sort_values("id").b + np.exp(p.sort_values("id").c) - 0.5)


def test_ig(points):
    grad = lambda c: {"a": c["b"], "b": c["a"], "c": 2 * c["c"]}
    for method, tol in (("gausslegendre", 1e-9), ("riemann", 0.2)):
        p = at.integrated_gradients(points, grad, list("abc"), {"a": 1.0}, steps=50, method=method).toPandas()
        assert np.allclose(p.a__ig + p.b__ig + p.c__ig, p.a * p.b + p.c**2, atol=tol)


def test_lime(points, spark):
    p = at.lime_tabular(points, "id", lambda x: 3 * x.a - x.b, list("abc"), points).where("id = 3").orderBy("feature").toPandas()
    assert np.allclose(p.value, [3, -1, 0], atol=0.01)
    words = spark.createDataFrame([(1, "good bad"), (2, None)], "id int, text string")
    out = {r["token"]: r["value"] for r in at.lime_text(words, "id", "text", lambda ts: ["good" in t.split() for t in ts]).collect()}
    assert out["good"] > 0.8 and abs(out["bad"]) < 0.2


def test_classes(points):
    v = at.shap_sampled(points, "id", lambda x: np.column_stack([x.a, x.b]), list("abc"), pd.DataFrame([dict.fromkeys("abc", 0.0)]), permutations=2)
    assert at.of_class(v, 1).count() == 60 and at.importance(v).count() == 3
    with pytest.raises(ValueError):
        at.of_class(v, 5)


def test_tree_rules(points):
    from clarispark.functions.predicates import Predicate, Rule

    rules = [(Rule((Predicate("a", ">", 0.0), Predicate("b", "<=", 0.0))), 2.0), (Rule((Predicate("a", ">", 1.0),)), -1.0)]
    p = at.shap_tree_rules(points, rules, list("abc"), {"a": -1.0, "b": 1.0, "c": 0.0}).toPandas()
    want = 2.0 * ((p.a > 0) & (p.b <= 0)) - (p.a > 1)
    assert np.allclose(p.a__shap + p.b__shap + p.c__shap, want) and (p.c__shap == 0).all()


def test_long_texts_have_weights_too(spark):
    words = " ".join(f"w{i}" for i in range(5000))
    texts = spark.createDataFrame([(1, words + " good"), (2, "")], "id int, text string")
    out = at.lime_text(texts, "id", "text", lambda ts: [float("good" in t.split()) for t in ts]).toPandas()
    assert len(out) == 5001 and out.sort_values("value").token.iloc[-1] == "good"


def test_trees_equal_exact_values(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(4)
    data = pd.DataFrame(rng.normal(size=(120, 4)), columns=list("abcd"))
    data["y"], data["id"] = data.a * data.b + np.abs(data.c), range(120)
    df = spark.createDataFrame(data)
    names, base = list("abcd"), {"a": 0.1, "b": -0.4, "c": 1.0, "d": 0.0}
    table = VectorAssembler(inputCols=names, outputCol="x").transform(df)
    for kind in (DecisionTreeRegressor(maxDepth=4), RandomForestRegressor(numTrees=3, maxDepth=3, seed=1), GBTRegressor(maxIter=3, maxDepth=2, seed=1)):
        model = kind.setFeaturesCol("x").setLabelCol("y").fit(table)
        ensemble = at.TreeEnsemble.of(model, names)
        assert model.transform(table).withColumn("own", ensemble.column()).where("abs(own - prediction) > 1e-9").count() == 0

        def column(c, ensemble=ensemble):
            test = lambda p: (c[p.feature] <= p.value) if p.op == "<=" else (c[p.feature] > p.value)
            out = F.lit(0.0)
            for path, w in ensemble.leaves:
                hit = F.lit(True)
                for p in path:
                    hit = hit & test(p)
                out = out + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
            return out

        want = at.shap_exact(df, column, names, base).toPandas().sort_values("id")
        got = at.shap_tree(df, "id", ensemble, names, background=pd.DataFrame([base])).toPandas().pivot(index="id", columns="feature", values="value")
        assert np.allclose(got[names].to_numpy(), want[[f"{c}__shap" for c in names]].to_numpy())
        own = df.withColumns({f"m_{c}": F.lit(base[c]) for c in names})
        matched = at.shap_tree(own, "id", ensemble, names, matched={c: f"m_{c}" for c in names}).toPandas().pivot(index="id", columns="feature", values="value")
        assert np.allclose(matched[names].to_numpy(), got[names].to_numpy())


def test_template(points):
    from clarispark.operators import explain

    linear = explain.ShapExplainer({"a": 1.0, "b": 2.0, "c": 0.0}, list("abc"), "id", mode="origin")
    assert linear(points, baseline=points).groupBy("feature").agg(F.sum("value").alias("v")).where("abs(v) > 1e-9").count() == 0
    assert linear.explain(points, baseline=dict.fromkeys("abc", 0.0), targets=[0]).count() == 60
    exact = explain.ShapExplainer(lambda c: c["a"] * c["b"], list("abc"), "id", method="exact")
    assert exact(points, baseline=points).where("abs(value) > 1e-12").count() == 0  # each row is its own baseline
    for bad in (lambda: linear(points), lambda: linear(points.drop("a"), baseline=points), lambda: linear(points, baseline=points.drop("b")), lambda: linear(points, baseline={"a": 1.0}), lambda: linear(points, baseline=points, targets=[3]),
                lambda: explain.ShapExplainer({}, [], "id", method="magic"), lambda: explain.ShapExplainer({}, [], "id", link="probit"), lambda: explain.ShapExplainer({}, [], "id", mode="both"), lambda: explain.LimeExplainer(None, ["a"], "id")(points)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        linear([1, 2])


def test_gaussian_generator(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 1))
    x = np.hstack([base + 0.1 * rng.normal(size=(400, 1)) for _ in range(4)])
    df = spark.createDataFrame([(i, r[:2].tolist(), r[2:].tolist()) for i, r in enumerate(x)], "id long, u array<double>, v array<double>")
    g = temporal.GaussianGenerator.fit(df, ["u", "v"])
    assert np.allclose(g.mean, x.mean(0)) and np.allclose(g.cov, np.cov(x.T, bias=True))
    held = np.array([True, False, False, True])
    drawn = g.given(x, held, 300)
    assert (drawn[:, :, held] == x[:, None, held]).all() and np.allclose(drawn[:, :, ~held].mean(1), g.given(x, held)[:, 0, ~held], atol=0.1)
    assert g.reconstruction_error(df) < 0.3
    masks = temporal.training_masks(200, 5, 6)
    assert all(len({tuple(r) for r in m if r.any()}) <= 1 and m.any(1).sum() in (0, 3) for m in masks) and masks.any()
    out = temporal.conditional_means(df, "id", lambda s: s.sum((1, 2)), g, 1, draws=50)
    assert out.count() == 400 * 2 * 3
    assert temporal.patch_weights(3) == pytest.approx([1 / 3] * 3) and temporal.patch_weights(3, 1.0)[1] < 1 / 3


def test_effects_equal_plain_arrays(spark):
    """Means, interactions and main effects of a product model against a loop over rows, draws and spans."""
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(5, 6)), rng.normal(size=(5, 6))
    df = spark.createDataFrame([(i, u[i].tolist(), v[i].tolist()) for i in range(5)], "id long, u array<double>, v array<double>")
    model = lambda c: F.element_at(c["u"], 1) * F.element_at(c["u"], 4) + F.element_at(c["u"], 6) * F.element_at(c["v"], 2)
    plain = lambda a, b: a[0] * a[3] + a[5] * b[1]
    draws = df.where("id < 3").select(F.col("id").alias("draw"), F.col("u").alias("g_u"), F.col("v").alias("g_v"))
    found = {(r["id"], r["feature"]): r for r in temporal.effects(df, "id", ["u", "v"], model, draws, 2).collect()}
    for i in range(5):
        e = {}
        for a, b in temporal.spans(3):
            own = np.tile(u[:3], 1)
            own[:, 2 * a : 2 * b + 2] = u[i, 2 * a : 2 * b + 2]
            e[a, b] = np.mean([plain(s, v[i]) for s in own])
        base = np.mean([e[k, k] for k in range(3)])
        inter = {(a, b): e[a, b] - base if a == b else e[a, b] - e[a, a] - e[b, b] + base if b == a + 1 else e[a, b] + e[a + 1, b - 1] - e[a, b - 1] - e[a + 1, b] for a, b in e}
        r = found[i, "u"]
        assert np.allclose(r["means"], list(e.values())) and np.allclose(r["inter"], list(inter.values())) and r["plain"] == pytest.approx(plain(u[i], v[i]))
        assert np.allclose(r["main"], [sum(x / (b - a + 1) for (a, b), x in inter.items() if a <= p <= b) for p in range(3)])


def test_temporal(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for i in range(8)], "id long, u array<double>, v array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    models = {t: (lambda c, t=t: total(c["u"]) * (t + 1) + F.element_at(c["u"], 1) * F.element_at(c["u"], 2)) for t in range(4)}
    main, inter = temporal.TemporalExplainer(models, ["u", "v"], draws=4).explain(df, "id", df, 2, only_last=False)
    assert main.count() == 8 * 2 * 3 * 4 and inter.count() == 8 * 2 * 6 * 4
    assert temporal.TemporalExplainer(models, ["u", "v"], draws=4).explain(df, "id", df, 2)[0].count() == 8 * 2 * 3
    with pytest.raises(ValueError):
        temporal.validate(df, ["u"], 4)


def test_streaming(spark, tmp_path):
    from clarispark.functions.predicates import Predicate, Rule, RuleList
    from clarispark.streaming.rules import score_stream, windowed_hits

    spark.range(10).withColumn("ts", F.timestamp_seconds("id")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    model = RuleList([Rule((Predicate("id", ">", 4),), "big")], "small")
    for frame, mode, name in ((score_stream(stream, model), "append", "scored"), (windowed_hits(stream, model, "ts"), "complete", "hits")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT count(*) FROM scored WHERE prediction = 'big'").first()[0] == 5
    assert {(r["rule"], r["hits"]) for r in spark.table("hits").collect()} == {(0, 5), (-1, 5)}
