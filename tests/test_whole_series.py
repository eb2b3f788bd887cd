import datetime as dt

from clarispark.plans import queries


def test_temporal_explain_reads_the_last_days(spark, tmp_path):
    rows = [(u, u, dt.datetime(2024, 1, d), 10.0 * u) for u, d in ((1, 1), (2, 15), (3, 30), (4, 29))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = queries.temporal_explain(spark, str(tmp_path)).collect()
    assert {r["user_id"] for r in out} == {1, 2, 3, 4} and {r["patch"] for r in out} == set(range(5))
