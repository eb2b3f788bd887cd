import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clarispark.llm import decontamination, simhash
from tests.llm.test_llm_dedup import cut, slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def prose(rng, n=60):
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "se", "lu", "ko"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng).split()
        if i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(["idiot", "scumbag", "stupid"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    copied = rows[1][1]
    rows += [(1001, copied), (1002, copied.upper()), (1003, f"{prose(rng)} {PASSAGE} {prose(rng)}"), (1004, None), (1005, ""), (1005, "")]
    rows += [(None, prose(rng)), (None, prose(rng)), (1006, prose(rng)), (1006, prose(rng)), (None, None)]
    rows += [(1010 + k, "\n".join([prose(rng), "shared one", "shared two", "shared three", prose(rng)])) for k in range(3)]
    out = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(d, t, None, "s", None if t is None else len(t)) for d, t in rows], SCHEMA)
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    before = pairs(docs)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    insult = [x for x in before if any(w in (x[1] or "").lower().split() for w in ("idiot", "scumbag", "stupid"))]
    assert order(pairs(clean)) == order(x for x in before if x not in insult)

    lines = stages["line_dedup"](spark, docs, folder)
    want = cut(before)
    assert lines.columns == docs.columns and order(pairs(lines)) == order((d, want[d, t]) for d, t in before)
    assert lines.where(~F.col("n_chars").eqNullSafe(F.length("text"))).count() == 0

    fps = [slow_fingerprint(t or "") for _, t in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    single = stages["simhash_near_dedup"](spark, docs, folder)
    got = pairs(single)
    by = {}
    for g, row in zip(group, before, strict=True):
        by.setdefault(g, []).append(row)
    assert single.columns == docs.columns and len(got) == len(by)
    for members in by.values():
        ids = [d for d, _ in members if d is not None]
        assert sum(x in members and x[0] == min(ids, default=None) for x in got) == 1

    words = decontamination.words_of(PASSAGE)
    kept = stages["benchmark_decontamination"](spark, docs, folder)
    assert kept.columns == docs.columns and order(pairs(kept)) == order(x for x in before if " ".join(words) not in " ".join(decontamination.words_of(x[1])))

    assert {r["doc_id"] for r in stages["best_fit_packing"](spark, docs, folder).collect()} == {d for d, _ in before}


def test_run_applies_every_stage(spark, folder):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert 1 in ids and ids.isdisjoint({0, 3, 1001, 1002, 1003}) and {1006, 1010, 1011, 1012, None} <= ids


def test_stages_take_empty_tables_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("z") for c in ("fp", "root", "text_hash", "component_id", "id", "kept")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    rows = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (5, "red blue green black white"), (5, "sun moon star sky cloud"), (5, "sun moon star sky cloud")]
    got = pairs(simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")))
    assert order(got) == order(set(rows))
