"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` tokens.  Pieces of one length are alike,
so a packing is a list of bin patterns with a multiplicity each, over the counts of the at most
``capacity`` lengths.  Best-fit leaves about three patterns a length at most and each child adds as
many, so with corpus size patterns grow up to that bound and not beyond.  Every island is a Spark
task that evolves a small population.  Crossover injects whole well-filled bins of one parent into
the other, bins that now hold pieces twice are removed, and their displaced pieces are put back
best-fit, largest first; mutation empties badly filled bins.  Between epochs each island's elite
moves to the next island.  The islands stop early where a packing meets the lower bound: it can't
be bettered then.  Packings travel between tasks as written tables and never through the driver.
The best is spread into slots, ranges of ranks within a length, and joined with the pieces.

Edge cases: a null text counts as empty and is one piece of the end id alone; a very long text is
cut into pieces, none of them dropped; repeated rows are packed once each, and pieces of equal
length are dealt out by task and order; a null doc_id is kept; an empty table gives an empty
result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarispark.llm.common import WORKER_TABLES, arrow_map, batch_of
from clarispark.session import materialize, release

CAPACITY, END_ID = 2048, 0
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 3, 4, 4
#: Words whose ids a table of a Python worker remembers, and bytes of the longest word that is remembered.
CACHED_WORDS, LONGEST_WORD = 1_000_000, 64

# --- Documents to pieces --------------------------------------------------------------------------

#: str.split() takes these for white space and the tokenizer doesn't: such texts are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: These and the white space of str.split() beyond ASCII.
_WIDE_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Fixed value: the vocabulary's split of normalised text.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin letters whose lower case doesn't depend on their neighbours; words of others go to the tokenizer as they are.
_PLAIN = re.compile("[\x21-\u012f\u0131-\u024f]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Column:
    """Words with their hashes, and where their UTF-8 lies."""

    def __init__(self, words: list[str], column: pa.Array | None = None):
        column = pa.array(words, pa.string()) if column is None else column
        _, ends, data = column.buffers()
        self.hashes = np.fromiter(map(hash, words), np.int64, len(words))
        self.data = np.frombuffer(data or b"", np.uint8)
        ends = np.frombuffer(ends or bytes(4), np.int32)[column.offset : column.offset + len(words) + 1].astype(np.int64)
        self.starts, self.sizes = ends[:-1], np.diff(ends)


class Words:
    """At most ``most`` words and their ids, in flat arrays that are touched as they fill.

    A word takes about 50 bytes (a dict of str and bytes takes 140), and never more than 64 on
    average: a table is also full when its text or its ids are.  Words longer than LONGEST_WORD
    aren't remembered.  Hashes only find candidates: the words themselves are compared.
    """

    def __init__(self, most: int):
        self.n, self.most = 0, most
        self.slots = np.zeros(1 << (2 * most).bit_length(), np.uint32)  # the word's number and 1; 0: free
        self.hashes = np.empty(most, np.int64)
        self.text, self.text_ends = np.empty(16 * most, np.uint8), np.zeros(most + 1, np.uint32)
        self.ids, self.id_ends = np.empty(4 * most, "<u4"), np.zeros(most + 1, np.uint32)

    def __len__(self) -> int:
        return self.n

    def clear(self) -> None:
        self.n = 0
        self.slots[:] = 0

    def place(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the words of these numbers begin, and how many they are."""
        starts = self.id_ends[numbers].astype(np.int64)
        return starts, self.id_ends[numbers + 1] - starts

    def _equal(self, numbers: np.ndarray, column: Column, at: np.ndarray) -> np.ndarray:
        starts, sizes = self.text_ends[numbers].astype(np.int64), column.sizes[at]
        equal = self.text_ends[numbers + 1] - starts == sizes
        for lo in range(0, len(at), 65_536):  # bounds the places
            k = lo + np.flatnonzero(equal[lo : lo + 65_536])
            differs = self.text[_ranges(starts[k], sizes[k])] != column.data[_ranges(column.starts[at[k]], sizes[k])]
            if differs.any():
                equal[np.repeat(k, sizes[k])[differs]] = False
        return equal

    def find(self, column: Column, left: np.ndarray) -> np.ndarray:
        """Numbers of the column's words at left, -1 for words that aren't here."""
        out = np.full(len(left), -1, np.int64)
        if not self.n:
            return out
        row, at = np.arange(len(left)), column.hashes[left] & (len(self.slots) - 1)
        while len(row):
            numbers = self.slots[at].astype(np.int64) - 1
            used = numbers >= 0
            row, at, numbers = row[used], at[used], numbers[used]
            same = self.hashes[numbers] == column.hashes[left[row]]
            same[same] = self._equal(numbers[same], column, left[row[same]])
            out[row[same]] = numbers[same]
            row, at = row[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out

    def room(self, text_sizes: np.ndarray, id_sizes: np.ndarray) -> int:
        """How many of the words, from the first on, there is room for."""
        free = ((text_sizes, len(self.text) - int(self.text_ends[self.n])), (id_sizes, len(self.ids) - int(self.id_ends[self.n])))
        return min(self.most - self.n, *(int(np.searchsorted(np.cumsum(x), space, "right")) for x, space in free))

    def add(self, column: Column, own: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Takes the column's words at own, which aren't here, with their ranges of ids; there is room."""
        n, self.n = self.n, self.n + len(own)
        numbers = np.arange(n, self.n)
        self.hashes[n : self.n] = column.hashes[own]
        for pool, ends, data, begin, size in ((self.text, self.text_ends, column.data, column.starts[own], column.sizes[own]), (self.ids, self.id_ends, ids, starts, sizes)):
            first = int(ends[n])
            ends[n + 1 : self.n + 1] = first + np.cumsum(size)
            pool[first : int(ends[self.n])] = data[_ranges(begin, size)]
        at = column.hashes[own] & (len(self.slots) - 1)
        while len(numbers):
            free = self.slots[at] == 0
            self.slots[at[free]] = numbers[free] + 1
            lost = self.slots[at] != numbers + 1  # taken before, or by another of these
            numbers, at = numbers[lost], (at[lost] + 1) & (len(self.slots) - 1)


class Encoder:
    """Ids of whole texts, 32-bit little-endian.

    This vocabulary never joins characters across white space, so the ids of a text are those
    of its words in turn, and words and their parts (runs of letters, digits, other signs) are
    remembered.  New parts are encoded together; the last token of each ends in ``</w>``.  A part is
    a word itself, so one table holds both.  A full table becomes the older one, from which words
    that are met again come back, so frequent words are never learned again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.older = Words(CACHED_WORDS), Words(CACHED_WORDS)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _remember(self, column: Column, own: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        short = column.sizes[own] <= LONGEST_WORD
        own, starts, sizes = own[short], starts[short], sizes[short]
        if self.words.room(column.sizes[own], sizes) < len(own):
            self.older, self.words = self.words, self.older
            self.words.clear()
        n = self.words.room(column.sizes[own], sizes)
        self.words.add(column, own[:n], ids, starts[:n], sizes[:n])

    def _known(self, column: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words that are remembered, where each word's begin and how many they are, and the places of the other words."""
        numbers = self.words.find(column, np.arange(len(column.hashes)))
        here, missed = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        before = self.older.find(column, missed)
        back, new = missed[before >= 0], missed[before < 0]
        starts, sizes, pools = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64), []
        first = 0
        for table, at, own in ((self.words, here, numbers[here]), (self.older, back, before[before >= 0])):
            begin, sizes[at] = table.place(own)
            pools.append(table.ids[_ranges(begin, sizes[at])])
            starts[at] = first + np.cumsum(sizes[at]) - sizes[at]
            first += len(pools[-1])
        ids = np.concatenate(pools)
        if len(back):
            self._remember(column, back, ids, starts[back], sizes[back])
        return ids, starts, sizes, new

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                out.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                out.update((x, self._whole(x)) for x in some)
        return out

    def _learned(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't remembered; they are now."""
        out, cut, parts = {}, {}, set()
        plain = _PLAIN.fullmatch
        for w in new:
            if not plain(w) or "<|" in w:
                out[w] = self._whole(w)
                continue
            low = (w if w.isascii() else unicodedata.normalize("NFC", w)).lower()
            if low.isalpha():
                parts.add(low)
                if low != w:
                    cut[w] = (low,)
            else:
                cut[w] = found = (low[:-1], low[-1]) if low[:-1].isalpha() else _SPLIT.findall(low)
                parts.update(found)
        some = list(parts)
        pool, starts, sizes, unknown = self._known(Column(some))
        raw, starts, ends = pool.tobytes(), 4 * starts, 4 * (starts + sizes)
        ids = dict(zip(some, map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist())), strict=True))
        encoded = self._encoded([some[k] for k in unknown.tolist()])
        ids.update(encoded)
        part = ids.__getitem__
        out.update((w, part(own[0]) if len(own) == 1 else b"".join(map(part, own))) for w, own in cut.items())
        encoded.update(out)
        if encoded:
            sizes = np.fromiter(map(len, encoded.values()), np.int64, len(encoded)) // 4
            column, pool = Column(list(encoded)), np.frombuffer(b"".join(encoded.values()), "<u4")
            self._remember(column, np.arange(len(sizes)), pool, np.cumsum(sizes) - sizes, sizes)
        ids.update(out)
        return ids

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Words are split and numbered by Arrow, so that Python sees each of these texts' words once."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        whole: dict[int, bytes] = {}
        wide = np.flatnonzero(pc.match_substring_regex(column, _WIDE_SPACE).to_numpy(zero_copy_only=False))
        if len(wide):
            some = column.to_pylist()
            for k in wide.tolist():
                odd = _ODD_SPACE.search(some[k])
                if odd:
                    whole[k] = self._whole(some[k])
                some[k] = "" if odd else " ".join(some[k].split())
            column = pa.array(some, pa.string())
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        pool, starts, sizes, new = self._known(Column(own, coded.dictionary))
        if len(new):
            words = [own[k] for k in new.tolist()]
            held = list(map(self._learned(words).__getitem__, words))
            sizes[new] = np.fromiter(map(len, held), np.int64, len(held)) // 4
            starts[new] = len(pool) + np.cumsum(sizes[new]) - sizes[new]
            pool = np.concatenate((pool, np.frombuffer(b"".join(held), "<u4")))
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        raw = pool[_ranges(starts[at], lengths)].tobytes()
        edges = (4 * np.concatenate(([0], np.cumsum(lengths)))[split.offsets.to_numpy()]).tolist()
        out = list(map(raw.__getitem__, map(slice, edges[:-1], edges[1:])))
        for k, i in whole.items():
            out[k] = i
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary; other operators' tasks may free it."""
    if ("packing", path) not in WORKER_TABLES:
        WORKER_TABLES["packing", path] = Encoder(path)
    return WORKER_TABLES["packing", path]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def _cut(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seen, part = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text")), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cell = ids[start : start + 4 * capacity]
                        n = len(cell) // 4
                        for column, value in zip(out, (doc, piece, start // 4, n, zlib.crc32(cell), int(seen[n])), strict=True):
                            column.append(value)
                        seen[n] += 1
                yield batch_of(PIECES, [*out[:5], [part] * len(out[0]), out[5]])
                pa.default_memory_pool().release_unused()  # what these texts' words took

    return cut


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece, with its task (part) and its number among that task's pieces of its length (nth)."""
    path = tokenizer or default_tokenizer()
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _cut(path, capacity, end_id), PIECES_SQL)


# --- Packings of length counts --------------------------------------------------------------------
# A pattern is a tuple of (length, count) pairs, longest first; a packing is {pattern: multiplicity}.


def fill(pattern: tuple) -> int:
    return sum(n * k for n, k in pattern)


def _joined(pattern: tuple, length: int, count: int) -> tuple:
    held = dict(pattern)
    held[length] = held.get(length, 0) + count
    return tuple(sorted(held.items(), reverse=True))


def best_fit(packing: dict, counts: dict[int, int], capacity: int) -> dict:
    """The packing with counts put in, longest first, each into the fullest bin that takes it.

    Bins of one pattern are handled together, and so are pieces of one length: the work grows
    with the number of different lengths and patterns only.
    """
    room: dict[int, dict] = {}
    for pattern, times in packing.items():
        group = room.setdefault(capacity - fill(pattern), {})
        group[pattern] = group.get(pattern, 0) + times
    gaps = sorted(room)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, left)
                bins = left // each if each == capacity // length else 1
                made, free = ((length, each),), capacity - each * length
                left -= bins * each
                times = bins
            else:
                gap = gaps[at]
                group = room[gap]
                pattern = next(iter(group))
                there = group.pop(pattern)
                each = min(gap // length, left)
                times = min(there, left // each)
                if there > times:
                    group[pattern] = there - times
                elif not group:
                    del room[gap], gaps[at]
                made, free = _joined(pattern, length, each), gap - each * length
                left -= times * each
            if free not in room:
                room[free] = {}
                bisect.insort(gaps, free)
            room[free][made] = room[free].get(made, 0) + times
    return {p: n for group in room.values() for p, n in group.items()}


def bins(packing: dict) -> int:
    return sum(packing.values())


def fitness(packing: dict, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenness: full bins beside empty ones leave more to gain."""
    return -bins(packing), sum(n * (fill(p) / capacity) ** 2 for p, n in packing.items()) / max(1, bins(packing))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """At least the tokens over the capacity, and at least a bin for each of the pieces that can't share one (Martello and Toth)."""
    total = sum(n * k for n, k in counts.items())
    best = -(-total // capacity)
    for small in [0, *[n for n in counts if n <= capacity // 2]]:
        alone = sum(k for n, k in counts.items() if n > capacity - small)
        middle = {n: k for n, k in counts.items() if capacity // 2 < n <= capacity - small}
        rest = sum(n * k for n, k in counts.items() if small <= n <= capacity // 2)
        space = sum(k * (capacity - n) for n, k in middle.items())
        best = max(best, alone + sum(middle.values()) + max(0, -(-(rest - space) // capacity)))
    return best


def _demand(packing: dict) -> dict[int, int]:
    out: dict[int, int] = {}
    for pattern, times in packing.items():
        for n, k in pattern:
            out[n] = out.get(n, 0) + k * times
    return out


def crossover(into: dict, source: dict, counts: dict[int, int], capacity: int, rng: random.Random) -> dict:
    """Well-filled bins of source are injected whole into ``into``.

    Bins of ``into`` that hold pieces which the injected bins hold too are removed, worst filled
    first, until no length is used more often than it is there; what they held besides is
    displaced and goes back best-fit.
    """
    full = [p for p in source if fill(p) >= capacity * 0.97]
    chosen = {p: rng.randint(1, source[p]) for p in full if rng.random() < 0.4}
    if not chosen:
        return dict(into)
    child = dict(into)
    over = {n: k - counts.get(n, 0) for n, k in _demand(child).items()}
    for n, k in _demand(chosen).items():
        over[n] = over.get(n, -counts.get(n, 0)) + k
    displaced: dict[int, int] = {}
    for pattern in sorted(child, key=lambda p: (fill(p), p)):
        need = max((-(-over.get(n, 0) // k) for n, k in pattern), default=0)
        out = min(child[pattern], need)
        if out <= 0:
            continue
        child[pattern] -= out
        if not child[pattern]:
            del child[pattern]
        for n, k in pattern:
            again = min(max(over.get(n, 0), 0), k * out)  # held twice: simply gone
            over[n] = over.get(n, 0) - k * out
            displaced[n] = displaced.get(n, 0) + k * out - again
    # A length may now be short because more bins went than it needed: those pieces are displaced too.
    for p, k in chosen.items():
        child[p] = child.get(p, 0) + k
    held = _demand(child)
    short = {n: k - held.get(n, 0) for n, k in counts.items() if k > held.get(n, 0)}
    return best_fit(child, short, capacity)


def mutate(packing: dict, counts: dict[int, int], capacity: int, rng: random.Random) -> dict:
    """Empties badly filled bins, and a few at random, and puts their pieces back best-fit."""
    kept: dict = {}
    for p, n in packing.items():
        gone = n if fill(p) < capacity * 0.95 and rng.random() < 0.7 else (rng.randint(0, n) if rng.random() < 0.05 else 0)
        if n > gone:
            kept[p] = n - gone
    held = _demand(kept)
    return best_fit(kept, {n: k - held.get(n, 0) for n, k in counts.items() if k > held.get(n, 0)}, capacity)


def _dump(packing: dict) -> str:
    return json.dumps([[list(map(list, p)), n] for p, n in sorted(packing.items())], separators=(",", ":"))


def _load(text: str) -> dict:
    return {tuple((n, k) for n, k in p): times for p, times in json.loads(text)}


def evolve(island: int, epoch: int, counts: dict[int, int], capacity: int, incoming: list[str], generations: int, population: int, least: int) -> list[str]:
    """The island's population after some generations, best first."""
    rng = random.Random(f"{island}/{epoch}")
    pool = [_load(x) for x in incoming]
    while len(pool) < population:
        if not pool:
            pool.append(best_fit({}, counts, capacity))
            continue
        pool.append(mutate(pool[0], counts, capacity, rng))
    score = {id(x): fitness(x, capacity) for x in pool}
    for generation in range(generations):
        if generation and max(score[id(x)] for x in pool)[0] == -least:
            break
        mother, father = rng.sample(pool, 2)
        child = crossover(mother, father, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, counts, capacity, rng)
        score[id(child)] = fitness(child, capacity)
        pool.append(child)
        pool.remove(min(pool, key=lambda x: score[id(x)]))
    return [_dump(x) for x in sorted(pool, key=lambda x: score[id(x)], reverse=True)]


ISLAND_SQL = "island int, nth int, bins long, evenness double, packing string"


def _living(epoch: int, counts: dict[int, int], capacity: int, generations: int, population: int, least: int):
    def live(pdf: pd.DataFrame) -> pd.DataFrame:
        island, incoming = int(pdf["island"].iloc[0]), pdf.sort_values(["place", "nth"])["packing"].dropna().tolist()
        after = evolve(island, epoch, counts, capacity, incoming[:population], generations, population, least)
        scores = [fitness(_load(x), capacity) for x in after]
        return pd.DataFrame({"island": island, "nth": range(len(after)), "bins": [-n for n, _ in scores], "evenness": [e for _, e in scores], "packing": after})

    return live


def evolved(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """The islands' packings after their last epoch, as a written table of ISLAND_SQL; nth 0 is an island's best."""
    least = lower_bound(counts, capacity)
    state = None
    for epoch in range(epochs):
        if state is None:
            homes = spark.range(0, islands, 1, islands).select(F.col("id").cast("int").alias("island"), F.lit(0).alias("place"), F.lit(0).alias("nth"), F.lit(None).cast("string").alias("packing"))
        else:
            moves = F.col("nth") == 0  # the elite moves to the next island and comes first there
            homes = state.select(F.when(moves, (F.col("island") + 1) % islands).otherwise(F.col("island")).alias("island"), F.when(moves, 0).otherwise(1).alias("place"), "nth", "packing")
        before, state = state, materialize(homes.groupBy("island").applyInPandas(_living(epoch, counts, capacity, generations, population, least), ISLAND_SQL), "islands")
        if before is not None:
            release(before)
        if state.agg(F.min("bins")).first()[0] == least:
            break
    return state


def best_of(state: DataFrame) -> DataFrame:
    """The one row with the fewest bins, of equals the most uneven."""
    return state.orderBy("bins", F.desc("evenness"), "island", "nth").limit(1)


def pack_counts(spark, counts: dict[int, int], capacity: int = CAPACITY, **search) -> dict:
    """The best packing that the islands find, on the driver: for counts of few lengths."""
    return _load(best_of(evolved(spark, counts, capacity, **search)).first()["packing"]) if counts else {}


# --- The packing dealt out ------------------------------------------------------------------------


#: Ranks of a length that are looked up together: a piece meets as many slots at most.
BLOCK = 8
SLOTS_SQL = "length long, first long, ranks long, each long, base long, place long"


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where pieces of a length go by rank: from ``first`` on, ``each`` to a bin, bins numbered from ``base``, at ``place`` in them."""
    for frame in frames:
        for text in frame["packing"]:
            used: dict[int, int] = {}
            rows, base = [], 0
            for pattern, times in sorted(_load(text).items(), reverse=True):
                place = 0
                for n, k in pattern:
                    rows.append((n, used.get(n, 0), k * times, k, base, place))
                    used[n] = used.get(n, 0) + k * times
                    place += n * k
                base += times
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["length", "first", "ranks", "each", "base", "place"])
                    rows = []
            yield pd.DataFrame(rows, columns=["length", "first", "ranks", "each", "base", "place"])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    by_task = materialize(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    state = evolved(spark, counts, capacity) if counts else spark.createDataFrame([], ISLAND_SQL)
    slots = materialize(best_of(state).select("packing").mapInPandas(_slots, SLOTS_SQL), "slots")
    release(state)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece_starts")
    release(by_task)
    ranked = cut.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    block = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("ranks") - 1) / BLOCK)))
    met = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(slots.withColumn("block", block).hint("merge"), ["length", "block"])  # slots grow with the corpus up to their bound
    held = met.where("rank >= first AND rank < first + ranks").withColumn("rank", F.col("rank") - F.col("first"))
    sequence, offset = F.col("base") + F.floor(F.col("rank") / F.col("each")), F.col("place") + F.col("rank") % F.col("each") * F.col("length")
    return held.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
