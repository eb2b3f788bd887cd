import numpy as np
import pytest
from pyspark.errors import PythonException

from clarispark.operators import attribution, explain


def test_trees_take_any_number_of_baseline_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    data = spark.range(300).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST((id % 7) * (id % 11) AS DOUBLE) AS y")
    tree = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=4).fit(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(data))
    base = lambda n: spark.range(n).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "CAST(id % 13 AS DOUBLE) AS b")
    few, many = (explain.ShapExplainer(tree, ["a", "b"], "id", mode="origin")(data, baseline=base(n)).toPandas().sort_values(["id", "feature"]) for n in (65, 184 * 65))
    assert len(many) == 600 and np.allclose(few.value, many.value)


def test_classes_take_any_number_of_baseline_rows(spark):
    data = spark.range(50).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "id / 3 AS b")
    base = spark.range(12001).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 2 AS DOUBLE) AS b")
    model = lambda x: np.column_stack([x["a"] * 0, x["a"] + 2 * x["b"]])
    out = explain.ShapExplainer(model, ["a", "b"], "id", mode="origin", permutations=2)(data, baseline=base, targets=[1])
    assert out.count() == 100 and out.where("class <> 1").count() == 0
    assert out.join(data, "id").where("abs(value - if(feature = 'a', a - 6000, 2 * (b - 6000 / 12001D))) > 1e-6").count() == 0
    with pytest.raises(PythonException, match="no rows"):
        explain.ShapExplainer(model, ["a", "b"], "id", mode="origin")(data, baseline=base.where("a < 0")).count()


def test_streamed_baselines_give_what_tables_at_hand_give(spark):
    big = 2**60 + 1
    rows = [(None if i % 9 == 0 else big + i % 40, float(i % 40), float(i % 3), None if i % 40 == 5 else i % 40 / 7) for i in range(120)]
    data = spark.createDataFrame(rows, "id long, a double, b double, c double")
    base = spark.range(11000).selectExpr("id / 11000 AS a", "CAST(id % 17 AS DOUBLE) AS b", "CAST(id % 5 AS DOUBLE) AS c")
    model = lambda x: np.column_stack([x["a"] * x["b"] * x["c"], x["a"] > x["b"]])
    whole = explain.ShapExplainer(model, list("abc"), "id", mode="origin", permutations=6)(data, baseline=base)
    assert whole.schema["id"].dataType == data.schema["id"].dataType
    blocks = attribution.shap_sampled(data, "id", model, list("abc"), base, permutations=6, cells=3000)  # 11 blocks to a group
    at_hand = attribution.shap_sampled(data, "id", model, list("abc"), base.toPandas(), permutations=6)
    order = ["id", "feature", "class", "value"]
    got, small, want = ([tuple(r) for r in x.orderBy(*order).collect()] for x in (whole, blocks, at_hand))
    assert len(got) == len(small) == len(want) == 120 * 6
    for out in (got, small):
        assert [r[:3] for r in out] == [r[:3] for r in want] and np.allclose([r[3] for r in out], [r[3] for r in want], equal_nan=True)
