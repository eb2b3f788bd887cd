"""Near duplicates of the pipeline: texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

A-Z are lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, shingles are 5 words joined by a
space, as a set (fewer words: the whole sequence).  Texts of one set of shingles are one from the
start.  Each set has a SimHash fingerprint, and near fingerprints are found by the self-join of
simhash's tries: sets whose fingerprints are tied that way are a bucket.  Near means within MOST_BITS
bits, or as many fewer as keep chance links below CHANCE to a fingerprint.  Some pairs at 0.8 differ
in more bits, so the sets that are still apart meet in further buckets, of sets that agree in one of
BANDS bands of ROWS MinHash values: of pairs at 0.8, (1 - 0.8^4)^32 = 5e-8 meet in no band, of more
similar ones fewer.  Each pair that meets is compared exactly on the sets, and components are of the
pairs that reach 0.8.

Fingerprints come first, then the first bands, then the others; of the bands only buckets whose
members are not yet in one component are read.  Only texts of sets that meet another are read again:
FILTER_BITS bits that are sent to all tasks leave out most of the others before texts are shuffled, and
an exact join the rest.  A bucket of more than BLOCK sets is split in blocks,
each pair of which is a task, which returns a spanning forest of the links it finds, never all pairs
of a dense group.

Edge cases: null and empty texts and texts of white space have no shingles and are near duplicates
of each other; a null doc_id is ignored by component_id (a component of null ids only has null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm import simhash
from clarispark.llm.common import arrow_map, batch_of, forget_tables, slices
from clarispark.llm.graph import connected_components
from clarispark.llm.simhash import ROW, Forest, rows_of
from clarispark.session import materialize, release

SHINGLE, SEED = 5, 42
ROWS, BANDS, FIRST_BANDS = 4, 32, 4
#: Bits that near fingerprints differ in at most, tries that find them, and links by chance to a fingerprint.
MOST_BITS, TRIES, CHANCE = 11, 4, 0.05
#: Sets in a block of a bucket that is split, and shingles compared at a time.
BLOCK, WIDE = 512, 8192
#: Bits of the filter of rows whose texts are read again: 64 to a row, so a quarter of a million rows of two numbers at most.
FILTER_BITS = 1 << 24

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**64, ROWS * BANDS, np.uint64)

PRINTS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ROW), ("key", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def bands_of(found: np.ndarray) -> list[int]:
    """A hash of each band's MinHash values; none without shingles."""
    if not len(found):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # bounds the products of a very long text
        least = np.minimum(least, ((found[at : at + 1024, None] ^ _FLIP) * _TIMES).min(0))
    raw = least.tobytes()
    return [_signed(xxhash.xxh64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b)) for b in range(BANDS)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables()
    for b in slices(batches):
        keys, fps, bands = [], [], []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            found = shingles(t or b"")
            keys.append(_signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)))
            fps.append(_signed(simhash.majority(found)))
            bands.append(bands_of(found))
        yield batch_of(PRINTS, [b.column("doc_id"), *(b.column(c) for c in ROW), keys, fps, bands])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables()
    for b in slices(batches):
        found = [pa.array(shingles(t or b"").view(np.int64)) for t in b.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield batch_of(SETS, [b.column("key"), pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(found))])


def common(rows: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left x right; (rows, words): the sets' elements, numbered from 0 and sorted by words."""
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(words[-1]) + 1 if len(words) else 0, WIDE):
        a, b = np.searchsorted(words, (lo, lo + WIDE))
        holds = np.zeros((int(rows.max()) + 1, WIDE), np.float32)
        holds[rows[a:b], words[a:b] - lo] = 1
        holds = np.concatenate([holds, np.zeros((max(0, max(left.max(), right.max()) + 1 - len(holds)), WIDE), np.float32)])
        out += holds[left] @ holds[right].T
    return out


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a task's sets: a spanning forest of the pairs that reach 0.8; pairs of one component already are left out."""
    key, root, side = (pdf[c].to_numpy() for c in ("key", "root", "side"))
    sizes = np.array([len(x) for x in pdf["shingles"]], np.int64)
    values, roots = np.unique(root, return_inverse=True)
    forest = Forest(len(key))
    if len(values) > 1:
        _, word, n = np.unique(np.concatenate(list(pdf["shingles"])), return_inverse=True, return_counts=True)
        shared = n[word] > 1
        rows, word = np.repeat(np.arange(len(key)), sizes)[shared], (np.cumsum(n > 1) - 1)[word[shared]]
        order = np.argsort(word, kind="stable")
        rows, word = rows[order], word[order]
        most = roots == np.bincount(roots).argmax()  # pairs inside the largest component need no comparison
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        home, guest = (np.ones(len(key), bool),) * 2 if one else (side == pdf["i"].iloc[0], side == pdf["j"].iloc[0])
        for a, b in ((home & ~most, guest), (home & most, guest & ~most))[: 1 if one else 2]:
            left, right = np.flatnonzero(a), np.flatnonzero(b)
            if len(left) and len(right) and len(word):
                both = common(rows, word, left, right).astype(np.int64)
                x, y = np.nonzero((9 * both >= 4 * (sizes[left][:, None] + sizes[right][None, :])) & (left[:, None] != right[None, :]))
                forest.add(left[x], right[y])
    top = forest.roots(np.arange(len(key)))
    tied = top != np.arange(len(key))
    return pd.DataFrame({"u": key[tied], "v": key[top[tied]]})


def _links(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(u, v): links within the buckets of members (bucket, n, key, root)."""
    full = members.join(sets, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    full = full.withColumn("side", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = full.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "key", "root", "shingles")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(_linked, "u long, v long")


def near_bits(n: int) -> int:
    """Bits that near ones of n fingerprints differ in at most."""
    chance = lambda bits: n * sum(math.comb(64, k) for k in range(bits + 1)) / 2**64
    return max([simhash.MAX_BITS, *(b for b in range(MOST_BITS + 1) if chance(b) <= CHANCE)])


def _near_fingerprints(firsts: DataFrame) -> DataFrame:
    """(bucket, n, key): sets whose fingerprints are tied by links of simhash's tries, in buckets of two and more."""
    fps = materialize(firsts.select("fp").distinct(), "set_fingerprints")
    roots = connected_components(simhash.links(fps, bits=near_bits(fps.count()), parts=TRIES))
    placed = materialize(firsts.join(roots, firsts["fp"] == roots["u"], "left").select("key", F.coalesce("root", "fp").alias("bucket")), "placed_sets")
    tied = materialize(placed.join(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket").select("bucket", "n", "key"), "tied_sets")
    release(fps, placed)
    return tied


def _texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the rows of named that wanted (key, ROW) holds; few other texts are shuffled."""
    at = F.pmod(F.xxhash64(*ROW), F.lit(FILTER_BITS))
    word, bit = F.shiftrightunsigned(at, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    held = wanted.select(word, bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    maybe = named.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(held), "__word").where(F.col("__bits").bitwiseAND(F.col("__bit")) != 0)
    return maybe.select(*ROW, "text").join(wanted.hint("merge"), list(ROW)).select("key", "text")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, ROW, component_id and root (the key of a set of the component) for every row of docs."""
    named = rows_of(docs)
    prints = materialize(arrow_map(named, _prints, f"doc_id long, {ROW[0]} long, {ROW[1]} long, key long, fp long, bands array<long>"), "shingle_prints")
    firsts = materialize(prints.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(*ROW)).alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct_sets")
    tied = _near_fingerprints(firsts.select("key", "fp"))

    # Buckets of two sets and more; of those with the same sets, the one of the first band.
    spread = firsts.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("band").alias("band"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.expr("bit_xor(xxhash64(key))").alias("mix")).where("n > 1")
    buckets = buckets.groupBy("n", "lo", "hi", "mix").agg(F.min(F.struct("band", "bucket")).alias("b")).select("n", "b.band", "b.bucket")
    buckets = materialize(buckets, "buckets")
    members = materialize(spread.drop("band").join(buckets, "bucket").select("bucket", "band", "n", "key"), "bucket_members")
    wanted = materialize(firsts.join(members.select("key").unionByName(tied.select("key")).distinct(), "key", "left_semi").select("key", "row.*"), "wanted_sets")
    sets = materialize(arrow_map(_texts_of(named, wanted), _sets, "key long, shingles array<long>"), "shingle_sets")

    found = materialize(_links(tied.withColumn("root", F.col("key")), sets, block), "simhash_links")
    done = [found]
    for name, own in (("first", F.col("band") < FIRST_BANDS), ("later", F.col("band") >= FIRST_BANDS)):
        roots = connected_components(found)
        met = members.where(own).join(roots.withColumnRenamed("u", "key"), "key", "left")
        met = materialize(met.select("bucket", "n", "key", F.coalesce("root", "key").alias("root")), f"{name}_members")
        mixed = materialize(met.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket"), f"{name}_mixed_buckets")
        more = materialize(_links(met.join(mixed, "bucket", "left_semi"), sets, block), f"{name}_links")
        release(met, mixed)
        done.append(more)
        found = found.unionByName(more)
    roots = connected_components(found)

    grouped = firsts.join(roots, firsts["key"] == roots["u"], "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))
    grouped = materialize(grouped, "grouped_sets")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = materialize(grouped.join(least, "root").select("key", "component_id", "root"), "components")
    release(firsts, tied, buckets, members, wanted, sets, *done, grouped)
    return prints.join(component, "key").select("doc_id", *ROW, "component_id", "root")
