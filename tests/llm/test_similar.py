import random

import pytest

import corpus_pipeline
from clarispark.llm import similar


def slow(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def copies():
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        base = [rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randrange(500)) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = str(rng.random())
            rows.append((len(rows), " ".join(words)))
    return rows + [(None, rows[0][1].upper()), (900, None), (901, " ")]


@pytest.mark.parametrize("block", [similar.BLOCK, 3])
def test_components_equal_brute_force(spark, block):
    rows = copies()
    sets, group = [slow(t or "") for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = {d: min(e for (e, _), h in zip(rows, group, strict=True) if h == g and e is not None) for (d, _), g in zip(rows, group, strict=True)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs, block).collect()}
    assert got == want and 40 < len(set(want.values())) < len(want)


def test_stage_drops_copies_beyond_four_bits(spark):
    words = [f"w{i}" for i in range(200)]
    other = [*words[:50], "x", *words[51:120], "y", *words[121:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:150]))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [1, 3]
