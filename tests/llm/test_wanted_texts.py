import corpus_pipeline
from clarispark.llm import similar


def test_texts_that_meet_no_other_are_left_out_before_the_shuffle(spark, monkeypatch):
    plans, materialize = [], similar.materialize

    def written(df, name, **kw):
        if name == "shingle_sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = materialize(df, name, **kw)
        if name == "shingle_sets":
            plans.append(out.count())
        return out

    monkeypatch.setattr(similar, "materialize", written)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:50], "x", *words[51:]]), *(" ".join(f"v{d}_{i}" for i in range(80)) for d in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan, sets = plans
    # The filter comes below the join that shuffles texts; the texts of two sets are read.
    assert 0 < plan.find("SortMergeJoin") < plan.find("BroadcastHashJoin")
    assert sets == 2 and kept == [0, *range(2, 62)]
