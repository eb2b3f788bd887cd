import pytest

from clarispark.llm import decontamination

ITEM = "alpha beta gamma delta epsilon zeta eta theta"
ROWS = [(None, f"so {ITEM} it is"), (None, "a clean text of no known id"), (None, None), (7, ITEM), (7, "another clean text of that id"), (7, ""), (8, "clean as well")]


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_SEEDS, 0])
def test_leaks_take_single_rows(spark, bound):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in decontamination.reject_leaked(docs, items, broadcast_seeds=bound).collect()]
    assert sorted(kept, key=repr) == sorted((x for x in ROWS if ITEM not in (x[1] or "")), key=repr)
    found = decontamination.find_leaks(docs, items, broadcast_seeds=bound).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == [7, None]
