import numpy as np
import pytest

import corpus_pipeline
from clarispark.llm import graph, simhash, similar


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def slow_majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_links_by_the_self_join_of_fingerprints_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(1500)]
    close = [*words[:700], "x", *words[701:]]
    apart = [w if i % 80 else "y" for i, w in enumerate(words)]
    texts = {1: words, 2: close, 3: apart, 4: [f"v{i}" for i in range(300)]}
    prints = {d: slow_majority(similar.shingles(" ".join(t).encode()).tolist()) for d, t in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 11 < min((prints[1] ^ prints[3]).bit_count(), (prints[2] ^ prints[3]).bit_count())

    joined, linked, links, compare = [], [], simhash.links, similar._links

    def trie(distinct, **bounds):
        joined.append({r["fp"] for r in distinct.collect()})
        return links(distinct, **bounds)

    def compared(*args):
        out = compare(*args)
        linked.append(out.count())
        return out

    monkeypatch.setattr(simhash, "links", trie)
    monkeypatch.setattr(similar, "_links", compared)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = sorted(r["doc_id"] for r in stage(spark, docs, "").collect())
    # One link is the tries', from all fingerprints; the copy beyond their bits is found among the sets still apart.
    assert joined == [{signed(p) for p in prints.values()}]
    assert linked[0] == 1 and kept == [1, 4]


@pytest.mark.parametrize("block", [simhash.BLOCK, 20])
@pytest.mark.parametrize("bits", [7, 9, 11])
def test_wider_budgets_equal_brute_force(spark, bits, block):
    rng = np.random.default_rng(bits)
    fps = rng.integers(0, 2**64, 60, np.uint64)
    for _ in range(6):  # copies of copies with up to a dozen bits turned
        turned = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 13), False).astype(np.uint64)) for _ in range(60)], np.uint64)
        fps = np.concatenate([fps, rng.choice(fps, 60) ^ turned])
    fps = np.unique(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    least = np.arange(len(fps))
    for _ in fps:
        least = np.where(near, least[None, :], len(fps)).min(1)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r["u"]: r["root"] for r in graph.connected_components(simhash.links(df, 32, block, bits, 4)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    groups = {}
    for g, h in zip(got, least.tolist(), strict=True):
        assert groups.setdefault(g, h) == h
    assert len(groups) == len(set(least.tolist())) < 0.7 * len(fps)
