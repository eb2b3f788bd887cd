import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clarispark.llm import exact_dedup, graph, line_dedup, simhash

NASTY = [
    (1, "One  two\nthree four five"), (2, "one  TWO\nthree four five"), (3, None), (4, ""), (5, "   "), (6, "É é"), (7, "é é"), (None, "One  two\nthree four five"),
    (9, "a\nb\nc\nd"), (10, "x\na\nb\nc\ny"), (11, "r\nr\nr\nr\nr"), (12, "long " * 5000), (12, "long " * 5000), (13, "a\nb\nc"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(NASTY, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("sha", "row", "fp", "kept", "component_id", "n")})


def test_cuckoo_index():
    rng = random.Random(0)
    index, truth = exact_dedup.CuckooIndex(2), {}
    for i in range(6000):
        key = rng.randbytes(3) * 8
        if rng.random() < 0.3:
            assert index.delete(key) == (truth.pop(key, None) is not None)
        else:
            assert index.insert(key, i) == (key not in truth)
            truth[key] = i
    assert len(index) == len(truth) and dict(index.items()) == truth and index.resizes
    assert all(k in index for k in truth) and b"\0" * 24 not in index


def test_exact_dedup_equals_brute_force(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(NASTY)
    low = lambda t: (t or "").encode().lower()
    groups = {}
    for d, t in NASTY:
        groups.setdefault(exact_dedup.hashlib.sha256(low(t)).hexdigest(), []).append(d)
    for r in got:
        own = groups[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == max((d for d in own if d is not None), default=None)
    for sha in groups:
        assert sum(r["kept"] for r in got if r["text_sha256"] == sha) == 1
    removed = docs.where("doc_id = 2").select("doc_id")
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(docs, removed).where("doc_id = 1").collect()} == {1}
    gone = docs.where("doc_id in (1, 2, 3, 4, 12) or doc_id is null").select("doc_id", "text")
    left = exact_dedup.exact_dedup(docs, gone, flush=2).collect()  # the first text loses all its rows, the empty one too
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in left) == [(d, d, 1, True) for d, t in NASTY if d not in (1, 2, 3, 4, 12, None)]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("flush", [1, 3, 50, exact_dedup.FLUSH_KEYS])
def test_full_indexes_are_handed_on(spark, flush):
    rng = random.Random(flush)
    rows = [(i, "t" * rng.randint(0, 40)) for i in range(400)]
    gone = {i for i, _ in rows if rng.random() < 0.4}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, spark.createDataFrame([(i,) for i in gone], "doc_id long"), flush).collect()}
    live = [(i, t) for i, t in rows if i not in gone]
    want = {i: (max(j for j, u in live if u == t), sum(u == t for _, u in live), i == max(j for j, u in live if u == t)) for i, t in live}
    assert got == want


def cut(rows):
    """Brute force: later windows in the order of (doc_id, position) cover their lines."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: -(2**63) if r[0] is None else r[0]):
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d, t] = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_equals_brute_force(docs, spark):
    want = cut(NASTY)
    got = line_dedup.dedup_lines(docs.withColumn("orig", F.col("text"))).collect()
    assert len(got) == len(NASTY) and all(r["text"] == want[r["doc_id"], r["orig"]] for r in got)
    assert "kept" in got[0].asDict() and got[0]["__ld_removed"] >= 0
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(200)]
    want = cut(rows)
    many = spark.createDataFrame(rows, "doc_id long, text string").withColumn("orig", F.col("text")).repartition(7)
    assert all(r["text"] == want[r["doc_id"], r["orig"]] for r in line_dedup.dedup_lines(many).collect())
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_one_of_tied_windows_stays(spark, tmp_path):
    rows = [(None, "a\nb\nc\nd")] * 3 + [(7, "p\nq\nr\nx"), (7, "p\nq\nr\ny"), (8, "z\n" * 5000)] + [(9, "s\nt\nu")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    for table in (docs, spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/docs").withColumn("_metadata", F.lit(1))):
        got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(table).collect()]
        assert sorted(t for d, t in got if d is None) == ["", "", "a\nb\nc\nd"] and sorted(t for d, t in got if d == 9) == ["", "s\nt\nu"]
        assert sorted(t for d, t in got if d == 7) in (["p\nq\nr\nx", "y"], ["p\nq\nr\ny", "x"]) and [t for d, t in got if d == 8] == ["z\n"]


def slow_fingerprint(text):
    words = text.lower().split() if text.isascii() else [w for w in "".join(c.lower() if c.isascii() else c for c in text).split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(0)
    for n in (0, 1, 3, 4, 5, 40):
        text = " ".join(rng.choice(["The", "cat", "é", "sat"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


@pytest.mark.parametrize(("leaf", "block"), [(1 << 15, 1 << 16), (32, 1 << 16), (64, 7)])
def test_links_equal_brute_force(spark, leaf, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(8):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {0xFFFF << 40 | int(x) for x in rng.integers(0, 1 << 12, 60)}  # one crowded node
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r["u"]: r["root"] for r in graph.connected_components(simhash.links(df, leaf, block)).collect()}
    mine = {f: roots.get(signed(f), signed(f)) for f in fps}
    want = components(fps)
    assert len({(mine[f], want[f]) for f in fps}) == len(set(want.values())) == len(set(mine.values()))


def test_near_duplicates_edges(docs):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {v for (d, _), v in got.items() if d in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
