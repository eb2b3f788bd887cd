"""Exact dedup on a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z.  Each map task keeps a
``CuckooIndex`` of the digests it meets and hands on one row per digest (largest live row key, rows
inserted, rows deleted), so a digest that a third of all rows share leaves a task once.  The second
pass keeps an index per shuffle partition of digests and merges those rows; a digest whose last
live row is deleted leaves the index.  A hit on a tag is verified against the whole SHA-256 digest of
the content in its bucket.

Edge cases: a null text counts as empty, and empty texts are equal to each other; a null
doc_id sorts before every number; rows that repeat a doc_id and a text are separate rows, of
which one stays (ties are decided by the row number in the written digest table); a text of any
length is hashed whole; an empty table gives an empty result; further columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm.common import arrow_map, batch_of, slices
from clarispark.session import materialize

MIN_ID = -(2**63)


class CuckooIndex:
    """A cuckoo filter of 16-bit tags whose hits are verified against the keys of the bucket.

    ``insert``/``delete``/``get`` work on live digests (bytes of 16 or more).  Each bucket has
    four tag slots; beside each tag lies its full key, so a tag hit that is not the same key is
    told apart, and a deletion removes exactly its own key.  When a key can't be placed after
    ``max_kicks`` moves, the table doubles and is filled again from the stored keys: nothing is lost.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 1024, max_kicks: int = 64):
        self.max_kicks, self.count, self.resizes = max_kicks, 0, 0
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.tags = bytearray(2 * self.SLOTS * buckets)  # little-endian pairs; 0: free
        self.keys: list = [None] * (self.SLOTS * buckets)
        self.values: list = [None] * (self.SLOTS * buckets)

    @staticmethod
    def _tag(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        tag, mask = self._tag(key), self.buckets - 1
        first = int.from_bytes(key[:8], "little") & mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995) & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        tag, a, b = self._places(key)
        low, high = tag & 255, tag >> 8
        for bucket in (a,) if a == b else (a, b):
            for slot in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
                if self.tags[2 * slot] == low and self.tags[2 * slot + 1] == high and self.keys[slot] == key:
                    return slot
        return -1

    def _put(self, slot: int, tag: int, key, value) -> None:
        self.tags[2 * slot], self.tags[2 * slot + 1] = tag & 255, tag >> 8
        self.keys[slot], self.values[slot] = key, value

    def _free(self, bucket: int) -> int:
        for slot in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
            if self.keys[slot] is None:
                return slot
        return -1

    def _place(self, key: bytes, value) -> tuple[bytes, object] | None:
        """None, or the entry that found no place."""
        tag, a, b = self._places(key)
        for bucket in (a, b):
            if (slot := self._free(bucket)) >= 0:
                self._put(slot, tag, key, value)
                return None
        bucket = b
        for kick in range(self.max_kicks):
            slot = bucket * self.SLOTS + (kick + tag) % self.SLOTS
            out = self.keys[slot], self.values[slot]
            self._put(slot, tag, key, value)
            key, value = out
            tag = self._tag(key)
            bucket = self._other(bucket, tag)
            if (free := self._free(bucket)) >= 0:
                self._put(free, tag, key, value)
                return None
        return key, value

    def _grow(self, homeless: tuple[bytes, object]) -> None:
        entries = [*self.items(), homeless]
        size = self.buckets
        while True:
            size *= 2
            self.resizes += 1
            self._clear(size)
            if all(self._place(k, v) is None for k, v in entries):
                return

    def get(self, key: bytes, default=None):
        slot = self._slot(key)
        return default if slot < 0 else self.values[slot]

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) >= 0

    def insert(self, key: bytes, value=True) -> bool:
        """True if the key is new; a live key gets the new value."""
        slot = self._slot(key)
        if slot >= 0:
            self.values[slot] = value
            return False
        if (homeless := self._place(key, value)) is not None:
            self._grow(homeless)
        self.count += 1
        return True

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self._put(slot, 0, None, None)
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)

    def __len__(self) -> int:
        return self.count


DIGESTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("gone", pa.bool_()), ("sha", pa.binary())])
GROUPS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("inserted", pa.int64()), ("deleted", pa.int64())])
GROUPS_SQL = "sha binary, keep_id long, keep_row long, inserted long, deleted long"
#: A task hands on what its index holds when it has this many keys, so its memory is bounded.
FLUSH_KEYS = 100_000
#: Entries handed on in a batch.
OUT_ROWS = 8192


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        sha = [hashlib.sha256((t or b"").lower()).digest() for t in texts]  # bytes.lower() changes A-Z only
        yield batch_of(DIGESTS, [b.column("doc_id"), b.column("row"), b.column("gone"), sha])


def _merge(rows: Iterator[tuple[bytes, int | None, int | None, int, int]], last_pass: bool, flush: int) -> Iterator[pa.RecordBatch]:
    """Merges rows (digest, largest live doc_id, its row, inserted, deleted) of one digest in an index.

    The index hands on its entries when it is full.  In a map task a key may come again after
    that and is then merged in the last pass, whose partitions are sorted by key: there it is only
    emptied between two keys, and an entry whose rows are all deleted is deleted from it.
    """
    index, last = CuckooIndex(), None

    def out() -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        for key, ((doc, row), inserted, deleted) in index.items():
            for column, value in zip(columns, (key, None if doc == MIN_ID else doc, None if row < 0 else row, inserted, deleted), strict=True):
                column.append(value)
            if len(columns[0]) == OUT_ROWS:
                yield batch_of(GROUPS, columns)
                columns = [[], [], [], [], []]
        if columns[0]:
            yield batch_of(GROUPS, columns)

    def settle() -> None:
        if last_pass and last is not None and (live := index.get(last)) is not None and live[1] == live[2]:
            index.delete(last)

    for key, doc, row, inserted, deleted in rows:
        if key != last:
            settle()
            if len(index) >= flush:
                yield from out()
                index = CuckooIndex()
            last = key
        best = (MIN_ID if doc is None else doc, -1 if row is None else row)
        live = index.get(key)
        index.insert(key, (best, inserted, deleted) if live is None else (max(live[0], best), live[1] + inserted, live[2] + deleted))
    settle()
    yield from out()


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for b in slices(batches, OUT_ROWS):
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A row is inserted; if it is gone it is deleted as well, and no candidate to stay."""
    return ((s, None, None, 1, 1) if gone else (s, d, r, 1, 0) for s, d, r, gone in _rows(batches, ("sha", "doc_id", "row", "gone")))


def digests(docs: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, gone, sha) per row of docs; ``row`` numbers the rows of this table."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    gone = F.lit(False)
    if removed is not None:
        ids = removed.select(F.col("doc_id").cast("long").alias("__gone")).distinct().withColumn("__is", F.lit(True))
        named, gone = named.join(ids, F.col("doc_id").eqNullSafe(F.col("__gone")), "left"), F.coalesce("__is", F.lit(False))
    return arrow_map(named.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), gone.alias("gone")), _digest, "doc_id long, row long, gone boolean, sha binary")


def live_groups(table: DataFrame, flush: int = FLUSH_KEYS) -> DataFrame:
    """(sha, keep_id, keep_row, inserted, deleted): one row per live digest."""
    partial = arrow_map(table, lambda b: _merge(_events(b), False, flush), GROUPS_SQL)
    names = tuple(GROUPS.names)
    return arrow_map(partial.repartition(F.col("sha")).sortWithinPartitions("sha"), lambda b: _merge(_rows(b, names), True, flush), GROUPS_SQL)


def exact_dedup(docs: DataFrame, removed: DataFrame | None = None, flush: int = FLUSH_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``removed`` (doc_id) names documents that are deleted: they are no candidates to stay and not
    in the result, and their digests leave the index unless another live document has the same text.
    """
    table = materialize(digests(docs, removed), "digests")
    groups = materialize(live_groups(table, flush), "digest_groups")
    return table.where(~F.col("gone")).join(groups, "sha").select(
        "doc_id", "keep_id", (F.col("inserted") - F.col("deleted")).alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
