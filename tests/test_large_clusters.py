import numpy as np

from clarispark.operators.wkmodes import WKModes
from clarispark.plans import fits


def test_planted_clusters_are_found_in_large_tables_too(spark, tmp_path):
    spark.range(12000).selectExpr("id AS vec_id", "CAST(hash(id) & 7 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = fits.wkmodes_fit(spark, str(tmp_path)).join(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id").selectExpr("cluster", "label % 3 AS g").distinct().collect()
    assert len(rows) == 3 == len({r["cluster"] for r in rows})


def test_a_table_taken_many_times_has_the_same_fit(spark):
    rows = [(float(i % 2), float(i % 2), float(i % 10 == 0), float(i % 2 ^ (i % 7 == 0))) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    once, often = (WKModes(2, init="cao").fit(x, list("abcd")) for x in (df, df.crossJoin(spark.range(50)).drop("id")))
    assert np.allclose(once.centers, often.centers) and np.allclose(once.weights, often.weights)
