"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case (runs of letters or digits).  Seeds are runs of MIN_MATCH words.
A document meets an item only if they share a seed.  Greedy string tiling then covers the
item: by running Karp-Rabin hashes the longest matches of words that neither side has used yet
are found and marked, again and again, down to MIN_MATCH words.  Tiles may lie in any order, so
a passage whose sentences were moved is covered as well as one in place.  An item is leaked
into a document when the tiles cover at least COVERAGE of its words.

While all items' seeds fit the bound ``broadcast_seeds``, they travel with the tasks and
documents are only read; beyond it, the seeds of documents and items are joined by their hash.

Edge cases: null and empty texts have no words and leak nothing; an item of fewer than
MIN_MATCH words has one seed, all its words, and is leaked only when they occur in a row; items
of equal texts are all reported; of equal matches the first in the item, then in the document, is
marked; texts of any length are read whole; a null doc_id is kept, a null item_id too; repeated rows
are reported each, and decided one by one; without items or documents the result is empty; other
columns, whatever their names, are ignored by ``find_leaks`` and pass through ``reject_leaked``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm.common import arrow_map, batch_of
from clarispark.session import materialize

MIN_MATCH, COVERAGE = 5, 0.6
BROADCAST_SEEDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def running_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin: the hash of each run of width ids, from prefix sums modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(ids), _BASE, np.uint64))))
    back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _INVERSE, np.uint64))))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    return (prefix[width:] - prefix[:-width]) * back[:n]  # as if each run began at the first place


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word ids: (item position, doc position, length) of the tiles.

    Longest matches of unmarked words first, of equal ones the first in the item, then in doc.
    The hashed width falls from the item's length by half steps to ``least``; a match is always
    extended to its whole length, and when that exceeds twice the width, the width rises to it.
    """
    least = max(1, min(least, len(item)))
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    width = max(least, len(item))
    while len(item) and len(doc):
        matches = _matches(item, doc, free_item, free_doc, width)
        longest = max((n for _, _, n in matches), default=0)
        if longest > 2 * width:
            width = longest
            continue
        for p, t, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if free_item[p : p + n].all() and free_doc[t : t + n].all():
                free_item[p : p + n] = free_doc[t : t + n] = False
                found.append((p, t, n))
        if matches:
            continue  # what an overlap cut short may still be there at this width
        if width == least:
            break
        width = max(least, width // 2)
    return found


def _matches(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal matches of unmarked words of at least that width."""
    def runs(ids: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = running_hashes(ids, width)
        used = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(used[width:] == used[:-width]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    at_item, h_item = runs(item, free_item)
    at_doc, h_doc = runs(doc, free_doc)
    if not len(at_item) or not len(at_doc):
        return []
    order = np.argsort(h_doc, kind="stable")
    lo, hi = np.searchsorted(h_doc[order], h_item, "left"), np.searchsorted(h_doc[order], h_item, "right")
    out, ends = [], {}
    for k in np.flatnonzero(hi > lo):
        p = int(at_item[k])
        for t in at_doc[order[lo[k] : hi[k]]].tolist():
            if ends.get(p - t, -1) >= p + width:
                continue  # inside a match already extended on this diagonal
            if not np.array_equal(item[p : p + width], doc[t : t + width]):
                continue
            n = width
            while p + n < len(item) and t + n < len(doc) and free_item[p + n] and free_doc[t + n] and item[p + n] == doc[t + n]:
                n += 1
            ends[p - t] = p + n
            out.append((p, t, n))
    return out


@dataclass
class Benchmark:
    """Items as word ids, and the hashes of their seeds; word 0 is any word that no item has."""

    vocabulary: dict[str, int]
    items: list[tuple[object, np.ndarray]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # by seed width: sorted hashes, and the item of each
    least: int
    coverage: float

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], least: int = MIN_MATCH, coverage: float = COVERAGE) -> Benchmark:
        vocabulary: dict[str, int] = {}
        items = [(key, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)) for key, text in rows]
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, (_, ids) in enumerate(items):
            if len(ids):
                width = min(least, len(ids))
                h = np.unique(seed_hashes(ids, width))
                by.setdefault(width, []).append((h, np.full(len(h), n)))
        seeds = {}
        for width, parts in by.items():
            h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(h, kind="stable")
            seeds[width] = h[order], n[order]
        return cls(vocabulary, items, seeds, least, coverage)

    def leaks(self, docs: list[list[str]]) -> Iterator[tuple[int, object, float, int, int]]:
        """(number of the document, item, coverage, tiles, longest tile) for each leak; one pass for all documents' seeds."""
        get = self.vocabulary.get
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter((get(w, 0) for d in docs for w in (*d, "")), np.int64, int(sizes.sum()))
        met: dict[tuple[int, int], list[int]] = {}
        for width, (hashes, owner) in self.seeds.items():
            used = np.concatenate(([0], np.cumsum(ids == 0)))
            at = np.flatnonzero(used[width:] == used[:-width])
            if not len(at):
                continue
            h = seed_hashes(ids, width, at)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo):
                doc = int(np.searchsorted(starts, at[k], "right")) - 1
                for n in owner[lo[k] : hi[k]].tolist():
                    met.setdefault((doc, n), []).append(int(at[k]))
        for (doc, n), places in sorted(met.items()):
            key, item = self.items[n]
            width = min(self.least, len(item))
            if len(item) and self._reach(places, width) < self.coverage * len(item):
                continue  # tiles lie on seeds: these can't cover enough
            found = tiles(item, self._stretches(ids, places, width), self.least)
            share = sum(t[2] for t in found) / len(item)
            if share >= self.coverage:
                yield doc, key, share, len(found), max(t[2] for t in found)

    @staticmethod
    def _reach(places: list[int], width: int) -> int:
        p = np.array(places)
        return int(np.minimum(np.diff(p, append=p[-1] + width), width).sum())

    @staticmethod
    def _stretches(ids: np.ndarray, places: list[int], width: int) -> np.ndarray:
        """The words that seeds cover, with a word that never matches between stretches; tiles lie inside them."""
        p = np.array(places)
        cut = np.flatnonzero(np.diff(p) > 1) + 1
        parts = []
        for run in np.split(p, cut):
            parts += [ids[run[0] : run[-1] + width], np.array([-1])]
        return np.concatenate(parts)


def seed_hashes(ids: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of runs that don't depend on where a run lies; at: only of the runs that begin there."""
    at = np.arange(len(ids) - width + 1) if at is None else at
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = (h + ids[at + k].astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())])
ROW_LEAKS = pa.schema([("row", pa.int64()), *LEAKS])
LEAKS_SQL = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"


def bounded_benchmark(items: DataFrame, least: int, coverage: float, most_seeds: int) -> Benchmark | None:
    """The items for the tasks, or None if they have more words than the bound."""
    size = items.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    if size > most_seeds:
        return None
    rows = [(r["item_id"], r["text"]) for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()]
    return Benchmark.of(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), least, coverage)


def find_leaks(docs: DataFrame, items: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile for each item that leaked into a document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = bounded_benchmark(items, least, coverage, broadcast_seeds)
    if bench is None:
        return _joined_leaks(_numbered(named), items, least, coverage).drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], *rest) for d, *rest in bench.leaks([words_of(t) for t in b.column("text").to_pylist()])]
                if rows:
                    yield batch_of(LEAKS, [list(x) for x in zip(*rows, strict=True)])

    return arrow_map(named, run, LEAKS_SQL)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs, written with a number of each row (``__dc_row``), so that each plan that reads it sees the same numbers."""
    return materialize(docs.withColumn("__dc_row", F.monotonically_increasing_id()), "decontamination_docs")


def _joined_leaks(numbered: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """The way for a benchmark too large to travel: seeds are exploded and joined by hash; leaks with the ``row`` they are in.

    Candidates are pairs of a document and an item with a common seed; their texts are joined to
    them for the tiling.
    """
    schema = pa.schema([("row", pa.int64()), ("width", pa.int32()), ("seed", pa.int64())])

    def seeds(df: DataFrame, widths: list[int] | None) -> DataFrame:
        """(row, width, seed); widths None: of each text its own, which is less than ``least`` for shorter ones."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    b = whole.slice(at, 64)
                    out = []
                    for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                        words = words_of(text)
                        for width in widths or [min(least, len(words))]:
                            runs = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else ()
                            out += [(row, width, xxhash.xxh64_intdigest(x) - 2**63) for x in sorted(runs)]
                    if out:
                        yield batch_of(schema, [list(x) for x in zip(*out, strict=True)])

        return arrow_map(df.select("row", "text"), run, "row long, width int, seed long")

    docs = numbered.select(F.col("__dc_row").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = materialize(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text"), "decontamination_items")
    wanted = materialize(seeds(own, None), "item_seeds")
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())  # at most ``least`` of them
    own = own.select(F.col("row").alias("__item"), "item_id", F.col("text").alias("item_text"))
    met = seeds(docs.withColumnRenamed("__row", "row"), widths).join(wanted.withColumnRenamed("row", "__item"), ["width", "seed"])
    pairs = met.select(F.col("row").alias("__row"), "__item").distinct()
    full = pairs.join(docs, "__row").join(own, "__item").select(F.col("__row").alias("row"), "doc_id", "text", "item_id", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, doc, text, key, item_text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text", "item_id", "item_text")), strict=True):
                rows += [(row, doc, *rest) for _, *rest in Benchmark.of([(key, item_text)], least, coverage).leaks([words_of(text)])]
            if rows:
                yield batch_of(ROW_LEAKS, [list(x) for x in zip(*rows, strict=True)])

    return arrow_map(full, run, f"row long, {LEAKS_SQL}")


def reject_leaked(docs: DataFrame, items: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """docs without the rows into which an item leaked; all columns pass through."""
    bench = bounded_benchmark(items, least, coverage, broadcast_seeds)
    if bench is None:
        numbered = _numbered(docs)
        gone = _joined_leaks(numbered, items, least, coverage).select(F.col("row").alias("__dc_row")).distinct()
        return numbered.join(gone, "__dc_row", "left_anti").select(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                leaked = {d for d, *_ in bench.leaks([words_of(t) for t in b.column("text").to_pylist()])}
                yield b.filter(pa.array([i not in leaked for i in range(b.num_rows)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
