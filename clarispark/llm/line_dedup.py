"""Line dedup on overlapping windows of three lines, in DataFrame functions only.

A window is three consecutive lines.  Windows that occur more than once anywhere are found by
a 128-bit hash; the first occurrence, by (doc_id, position), stays, and the positions that
later occurrences cover are merged per row and removed.  Every line that goes has an
equal line that stays: it lies in an earlier occurrence of its window.

Windows are hashed once and written; texts move once, to be joined with the positions to cut.
All joins are sort-merge joins at every size: their small sides grow with the corpus, so they
are not broadcast where they happen to be small.

Edge cases: a null text stays null and an empty one is a single empty line; texts of fewer
than three lines have no window and stay as they are; texts of any length are read whole; a null
doc_id sorts before every number.  Rows are told apart by their place in the table: where rows of
one doc_id hold a window at the same position, and where rows are repeated or have no id, one row
(that of the smallest hash of its place) keeps it and the others lose it.  Within a document that
repeats itself the later windows go too.  An empty table gives an empty result.  Other columns pass
through whatever their names; internal columns begin with ``__ld_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm.common import numbered
from clarispark.session import materialize, release

WINDOW = 3
_ROW = ("__ld_f", "__ld_r")
_POSITIONS, _TIES = 1 << 32, 1 << 29  # positions in a document are below the first; hashes that break ties below the second


def line_windows(docs: DataFrame) -> DataFrame:
    """(__ld_w1, __ld_w2, __ld_f, __ld_r, __ld_id, __ld_pos): a row for each window of each row of numbered docs."""
    hashed = docs.select(
        *_ROW, F.col("doc_id").cast("long").alias("__ld_id"),
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))).alias("__ld_h"),
    ).where(F.size("__ld_h") >= WINDOW)
    n = F.size("__ld_h") - (WINDOW - 1)
    zipped = hashed.select(
        *_ROW, "__ld_id", F.arrays_zip(F.slice("__ld_h", 1, n).alias("p"), F.slice("__ld_h", 2, n).alias("q"), F.slice("__ld_h", 3, n).alias("r")).alias("__ld_z"),
    )
    return zipped.select(*_ROW, "__ld_id", F.posexplode("__ld_z").alias("__ld_pos", "__ld_x")).select(
        F.xxhash64("__ld_x.p.a", "__ld_x.q.a", "__ld_x.r.a").alias("__ld_w1"),
        F.xxhash64(F.lit(7), "__ld_x.p.b", "__ld_x.q.b", "__ld_x.r.b").alias("__ld_w2"),
        *_ROW, "__ld_id", "__ld_pos",
    )


def _ordered(windows: DataFrame) -> DataFrame:
    """With __ld_tie, a hash of the row, and __ld_ord, which orders by (doc_id, position, hash) as one number."""
    big = lambda x, digits: F.lit(x).cast(f"decimal({digits},0)")
    tie = F.xxhash64(*_ROW)
    at = F.coalesce("__ld_id", F.lit(-(2**63))).cast("decimal(19,0)") * big(_POSITIONS, 10) + F.col("__ld_pos")
    return windows.withColumns({"__ld_tie": tie, "__ld_ord": (at * big(_TIES, 9) + F.pmod(tie, F.lit(_TIES))).cast("decimal(38,0)")})


def removed_positions(docs: DataFrame) -> DataFrame:
    """(__ld_f, __ld_r, __ld_starts): per row of numbered docs, the sorted starts of its later occurrences."""
    windows = materialize(line_windows(docs), "line_windows")
    repeated = materialize(
        _ordered(windows).groupBy("__ld_w1", "__ld_w2").agg(F.count(F.lit(1)).alias("__ld_n"), F.min("__ld_ord").alias("__ld_first"), F.min_by("__ld_tie", "__ld_ord").alias("__ld_keeper"))
        .where("__ld_n > 1").select("__ld_w1", "__ld_w2", "__ld_first", "__ld_keeper"),
        "repeated_windows",
    )
    later = _ordered(windows).join(repeated.hint("merge"), ["__ld_w1", "__ld_w2"]).where("__ld_ord <> __ld_first OR __ld_tie <> __ld_keeper")
    out = materialize(later.groupBy(*_ROW).agg(F.sort_array(F.collect_set("__ld_pos")).alias("__ld_starts")), "removed_windows")
    release(windows, repeated)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with its text cut, and the columns ``__ld_lines`` and ``__ld_removed`` (line counts)."""
    own = numbered(docs, *_ROW)
    joined = own.join(removed_positions(own).hint("merge"), list(_ROW), "left").withColumn("__ld_l", F.split("text", "\n", -1))
    n = F.size("__ld_l")
    # The gaps between covered stretches: each ends where a later occurrence starts and begins WINDOW lines after the one before.
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("__ld_starts", lambda p: p + WINDOW)).alias("lo"),
        F.concat(F.col("__ld_starts"), F.array(n)).alias("hi"),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("__ld_l"), g["lo"] + 1, F.greatest(g["hi"] - g["lo"], F.lit(0)))))
    cut_text = joined.withColumn("__ld_kept", F.when(F.col("__ld_starts").isNotNull(), kept))
    return cut_text.withColumns({
        "text": F.when(F.col("__ld_kept").isNull(), F.col("text")).otherwise(F.array_join("__ld_kept", "\n")),
        "__ld_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(n),
        "__ld_removed": F.when(F.col("__ld_kept").isNull(), F.lit(0)).otherwise(n - F.size("__ld_kept")),
    }).drop(*_ROW, "__ld_l", "__ld_kept", "__ld_starts")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "text", F.col("__ld_lines").cast("long").alias("n_lines"), F.col("__ld_removed").cast("long").alias("n_removed")
    )


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows WHERE win IS NOT NULL
  ) WHERE nth > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS steps(k)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text,
         count(*) AS n_lines, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
