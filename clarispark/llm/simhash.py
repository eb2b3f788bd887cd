"""SimHash near-duplicates, linked by a self-join of a binary trie over the fingerprints.

Fingerprint: A-Z are lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, shingles are 4
words joined by a space, repeats included (fewer words: the whole sequence); h is a shingle's
XXH64 of its UTF-8 bytes with seed 42; a bit is 1 if set in over half the h.  No word: zero.

Linking: distinct fingerprints only, so exact copies never meet.  Two tries hold the bits in
two orders (halves swapped).  Of two fingerprints within 4 bits, one half differs in at most 2,
so it is enough to traverse pairs of nodes whose first 32 levels differ in 2 bits at most and
whose 64 levels differ in 4 at most.  ``links`` takes other budgets of bits too, and as many tries as
the bits have parts, each of which begins with a part of its own.  The upper levels of a trie are dealt over tasks: a task
owns a node of depth d and meets the nodes of that depth that differ in at most 2 bits; below,
the task walks node pairs level by level, adds up differing bits, and prunes beyond the budget.
A task returns a spanning forest of the links it finds, never all pairs of a dense group; nodes
that hold more fingerprints than a block are split in blocks, each pair of which is a task.

Edge cases: null and empty texts and texts of white space have fingerprint zero and are linked
like any other; texts of any length are hashed whole; a null doc_id is ignored by component_id (a
component of null ids only has null); repeated rows share a fingerprint and a component; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm.common import arrow_map, batch_of, numbered, slices
from clarispark.llm.graph import connected_components
from clarispark.session import materialize, release

SHINGLE, SEED, MAX_BITS, PARTS = 4, 42, 4, 2
#: Upper levels dealt over tasks: as many as leave about LEAF fingerprints to a node.
LEAF, LEAST_DEPTH, MOST_DEPTH = 1 << 15, 4, 16
#: Fingerprints in a block of a node that is split.
BLOCK = 1 << 16
#: Node pairs walked at a time, and the product of sizes at which a node pair is compared bit by bit.
FRONTIER, DIRECT = 1 << 18, 64

#: Columns that tell rows apart.
ROW = ("__sh_f", "__sh_r")
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ROW), ("fp", pa.int64())])


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them; zero of none."""
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # on bytes: A-Z only; the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        fps = np.array([fingerprint(t or b"") for t in texts], np.uint64)
        yield batch_of(FINGERPRINTS, [b.column("doc_id"), *(b.column(c) for c in ROW), pa.array(fps.view(np.int64))])


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, ROW, text) of docs, numbered unless they are already."""
    own = docs if set(ROW) <= set(docs.columns) else numbered(docs.select("doc_id", "text"), *ROW)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), *ROW, "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    return arrow_map(rows_of(docs), _fingerprints, f"doc_id long, {ROW[0]} long, {ROW[1]} long, fp long")


def near_nodes(depth: int, budget: int) -> list[int]:
    """Differences of two nodes of that depth, within the first part of a trie, that the part's budget allows."""
    return sorted(sum(1 << i for i in at) for n in range(budget + 1) for at in itertools.combinations(range(depth), n))


def _turned(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by % 64 == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


DEALT = pa.schema([("node", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("kind", pa.int32()), ("fp", pa.int64())])
#: What a fingerprint is to a task: at home, a guest, or of the second or first of two blocks of one node.
HOME, GUEST, SECOND, FIRST = 0, 1, 2, 3


def _repeat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k counts[k] times, and the number of each copy."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _dealt(turn: int, depth: int, budget: int, blocks: dict[int, int]):
    """Deals each fingerprint to its own node, and as a guest to those nodes before it that the budget allows.

    ``blocks`` has the number of blocks of each node that is split.  A task is (node, i, j): block
    i at home with j = i (and guests of nodes that aren't split), blocks i < j of the node, or,
    with j < 0, block i at home with one block of guests from a node that is split.
    """
    near = np.array(near_nodes(depth, budget), np.int64)
    tables: dict[tuple[int, int], int] = {}  # (host, guests' node): the number of that node's first block among the host's guests
    visits: dict[int, int] = {}
    for node in sorted(blocks):
        for host in (node ^ int(x) for x in near):
            if host < node:
                tables[host, node] = visits.get(host, 0)
                visits[host] = visits.get(host, 0) + blocks[node]

    def of(nodes: np.ndarray, table: dict, default: int) -> np.ndarray:
        values, back = np.unique(nodes, return_inverse=True)
        return np.array([table.get(int(x), default) for x in values], np.int64)[back]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                raw = whole.slice(at, 8192).column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                fp = _turned(raw, turn)
                node = (fp >> np.uint64(64 - depth)).astype(np.int64)
                own = of(node, blocks, 1)
                block = ((raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % own
                out = []
                # At home, with every block of the node.
                row, other = _repeat(own)
                mine = block[row]
                out.append((node[row], np.minimum(mine, other), np.maximum(mine, other), np.where(mine > other, SECOND, np.where(mine < other, FIRST, HOME)), row))
                # At home again, for each block of guests that comes by itself.
                row, visit = _repeat(of(node, visits, 0))
                out.append((node[row], block[row], -1 - visit, np.full(len(row), HOME), row))
                # As a guest of each block of the nodes before.
                target = node[:, None] ^ near[None, :]
                row, col = np.nonzero(target < node[:, None])
                target = target[row, col]
                again, i = _repeat(of(target, blocks, 1))
                row, target = row[again], target[again]
                j = i.copy()
                if blocks:
                    apart = np.nonzero(own[row] > 1)[0]
                    start = np.array([tables[int(t), int(n)] for t, n in zip(target[apart], node[row[apart]], strict=True)], np.int64)
                    j[apart] = -1 - (start + block[row[apart]])
                out.append((target, i, j, np.full(len(row), GUEST), row))
                t, i, j, kind, row = (np.concatenate([x[k] for x in out]) for k in range(5))
                yield batch_of(DEALT, [pa.array(t), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(fp[row].view(np.int64))])

    return deal


class Forest:
    """Union-find over positions; ``add`` takes arrays of linked positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins by passing minima over the given links until nothing changes."""
        p = self.parent
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        p, r = self.parent, self.parent[x]
        while True:
            up = p[r]
            if np.array_equal(up, r):
                break
            r = up
        p[x] = r
        return r


def _walk(a: np.ndarray, b: np.ndarray | None, depth: int, bits: int, parts: int):
    """Yields arrays (i, j) of linked positions of a and b (None: a with itself), both sorted and unique.

    The stack holds blocks of node pairs as rows of (a from, a to, b from, b to, differing bits)
    with the level they have reached.
    """
    itself = b is None
    b = a if itself else b
    if not len(a) or not len(b):
        return
    first = np.array([[0, len(a), 0, len(b), 0]], np.int64)
    if depth:  # all of a share the first bits, all of b theirs or one of a few
        nodes_a, at_a = np.unique(a >> np.uint64(64 - depth), return_index=True)
        nodes_b, at_b = np.unique(b >> np.uint64(64 - depth), return_index=True)
        ea, eb = np.append(at_a[1:], len(a)), np.append(at_b[1:], len(b))
        x, y = (v.ravel() for v in np.meshgrid(np.arange(len(nodes_a)), np.arange(len(nodes_b)), indexing="ij"))
        apart = np.bitwise_count(nodes_a[x] ^ nodes_b[y]).astype(np.int64)
        ok = apart <= bits // parts
        first = np.stack([at_a[x], ea[x], at_b[y], eb[y], apart], 1)[ok]
    stack = [(depth, first)]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(level, pairs[k : k + FRONTIER]) for k in range(0, len(pairs), FRONTIER)]
            continue
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        small = (na * nb <= DIRECT) | (level == 64)
        if small.any():
            yield from _compare(a, b, pairs[small], itself, bits)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        # One level down: each range splits where its next bit turns to 1.
        mid_a, mid_b = _split(a, pairs[:, 0], pairs[:, 1], level), _split(b, pairs[:, 2], pairs[:, 3], level)
        lo_a, hi_a, lo_b, hi_b, apart = pairs.T
        kids = np.concatenate([
            np.stack(k, 1) for k in ((lo_a, mid_a, lo_b, mid_b, apart), (mid_a, hi_a, mid_b, hi_b, apart), (lo_a, mid_a, mid_b, hi_b, apart + 1), (mid_a, hi_a, lo_b, mid_b, apart + 1))
        ])
        budget = bits // parts if level + 1 <= 64 // parts else bits
        keep = (kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)
        if itself:
            keep &= kids[:, 0] <= kids[:, 2]
        stack.append((level + 1, kids[keep]))


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where in each range [lo, hi) the bit of that level turns to 1; the ranges share all bits above."""
    bit = np.uint64(1) << np.uint64(63 - level)
    base = v[lo] & ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(v, base | bit), lo, hi)


def _compare(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, itself: bool, bits: int):
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    for group in np.array_split(np.arange(len(pairs)), max(1, math.ceil(int(sizes.sum()) / 1_000_000))):
        p, s = pairs[group], sizes[group]
        k = np.repeat(np.arange(len(p)), s)
        off = np.arange(len(k)) - np.repeat(np.cumsum(s) - s, s)
        wide = p[k, 3] - p[k, 2]
        i, j = p[k, 0] + off // wide, p[k, 2] + off % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= bits
        if itself:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def _linked(turn: int, depth: int, bits: int, parts: int):
    """Of a task's fingerprints: a spanning forest of the links it is there to find."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, kind = pdf["fp"].to_numpy().view(np.uint64), pdf["kind"].to_numpy()
        home, guests = np.sort(fp[(kind == HOME) | (kind == FIRST)]), np.sort(fp[(kind == GUEST) | (kind == SECOND)])
        every = np.unique(np.concatenate([home, guests]))
        forest = Forest(len(every))

        def meet(a: np.ndarray, b: np.ndarray | None) -> None:
            at_a, at_b = np.searchsorted(every, a), np.searchsorted(every, a if b is None else b)
            for x, y in _walk(a, b, depth, bits, parts):
                forest.add(at_a[x], at_b[y])

        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            meet(home, None)
        meet(home, guests)
        root = forest.roots(np.arange(len(every)))
        tied = root != np.arange(len(every))
        back = _turned(every, 64 - turn)
        return pd.DataFrame({"u": back[tied].view(np.int64), "v": back[root[tied]].view(np.int64)})

    return link


def links(distinct: DataFrame, leaf: int = LEAF, block: int = BLOCK, bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all that are within so many bits.

    Of two that near, one of ``parts`` equal parts differs in bits // parts at most: each begins a trie.
    """
    n = distinct.count()
    depth = min(MOST_DEPTH, 64 // parts, max(LEAST_DEPTH, math.ceil(math.log2(max(n, 1) / leaf))))
    out = None
    for trie in range(parts):
        turn = trie * (64 // parts)
        top = F.shiftrightunsigned(F.shiftleft("fp", turn), 64 - depth)
        # Counts of nodes above a block: at most n / block rows, and never more than 2^MOST_DEPTH.
        large = distinct.groupBy(top.alias("node")).count().where(F.col("count") > block).collect()
        blocks = {r["node"]: math.ceil(r["count"] / block) for r in large}
        dealt = arrow_map(distinct.select("fp"), _dealt(turn, depth, bits // parts, blocks), "node long, i int, j int, kind int, fp long")
        found = dealt.groupBy("node", "i", "j").applyInPandas(_linked(turn, depth, bits, parts), "u long, v long")
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, ROW, fp (long), component_id and root (a fingerprint of the component) for every row of docs."""
    prints = materialize(fingerprints(docs), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    roots = connected_components(links(firsts.select("fp")))
    grouped = firsts.join(roots, firsts["fp"] == roots["u"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    grouped = materialize(grouped, "grouped_fingerprints")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = materialize(grouped.join(least, "root").select("fp", "component_id", "root"), "components")
    release(firsts, roots, grouped)
    return prints.join(component, "fp").select("doc_id", *ROW, "fp", "component_id", "root")


def keep_one(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each component that ``near`` finds: that of its smallest doc_id.

    Of several rows with that doc_id, or of a component without any, the first by its place in the
    table stays.  All columns pass through; internal columns begin with ``__sh_``.
    """
    own = numbered(docs, *ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW)).alias("x")
    kept = materialize(near(own).groupBy("root").agg(first).select(*[f"x.{c}" for c in ROW]), "kept")
    return own.join(kept.hint("merge"), list(ROW), "left_semi").select(*docs.columns)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
