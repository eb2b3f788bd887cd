"""What the text operators share: Arrow passes over rows, held-out split, label samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarispark.session import materialize

#: Rows whose crc32(doc_id as text) leaves this remainder modulo 4 are held out from every fit.
HELD_OUT_REMAINDER = 2

#: What a Python worker remembers between tasks, by operator.
WORKER_TABLES: dict = {}


def forget_tables() -> None:
    """Frees what earlier operators left in this worker, so that their tables don't add up."""
    WORKER_TABLES.clear()
    pa.default_memory_pool().release_unused()


def id_text_crc(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def held_out(col: str = "doc_id"):
    """True where the row may not lend its label to a fit; a null id counts as empty text."""
    return (id_text_crc(col) % 4) == HELD_OUT_REMAINDER


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow; empty input yields empty output of the same schema.

    Rows here are whole texts, so Spark's default batch of rows can take hundreds of MB on either
    side of the pipe.  Unless the session sets a bound of its own, a batch is at most 8 MB.
    """
    if df.sparkSession.conf.get(_BATCH_BYTES, None) in (None, "64MB", str(64 << 20), f"{64 << 20}b"):
        df.sparkSession.conf.set(_BATCH_BYTES, str(8 << 20))
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most so many rows, so that few texts are Python objects at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _one_row_each(docs: DataFrame) -> bool:
    """True if docs is a scan of files, filtered and projected at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and "_metadata" in plan.metadataOutput().mkString(" ")


def numbered(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with two long columns that tell its rows apart, the same in each plan that reads it.

    Of a scan they are a hash of the file's path and the row's place in it, which cost nothing.
    Anything else is written first: a join may repeat a scan's rows, and a number that is made
    while a plan runs may differ when the plan runs again or a lost task is repeated.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")})

    if "_metadata" in docs.columns:  # it hides the scan's own: it steps aside while the table is written
        aside = materialize(docs.withColumnRenamed("_metadata", "__metadata_aside"), "numbered")
        return keyed(aside).withColumnRenamed("__metadata_aside", "_metadata")
    return keyed(docs if _one_row_each(docs) else materialize(docs, "numbered"))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, __label): a row for each doc_id that is not held out and has a label; 1 if any of several labels is."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__label"))
        .where(~held_out())
    )


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` rows of each class that are not held out.

    A class is sampled by the order of a hash of doc_id, so the sample is the same on any
    partitioning.  A doc_id with several labels counts as 1 if any of them is 1; null ids and
    null labels are left out.  The sampled ids are bounded by 2 x per_class and are broadcast.
    """
    one = usable_labels(labels, label)
    picked = None
    for value in (0, 1):
        part = one.where(F.col("__label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = [(r["doc_id"], r["__label"]) for r in picked.collect()]  # bounded: 2 x per_class
    ids = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", labels.schema["doc_id"].dataType), T.StructField("__label", T.IntegerType())]))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
