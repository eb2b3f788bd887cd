"""Preparation of feature tables: labels, missing values, long tails, weighted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, OTHER = "unknown<", "other<"
#: Values that a folded column may keep; more raise an error, as they travel with every plan that folds.
MAX_KEPT = 20_000


def default_label(df: DataFrame, label: str):
    """The most frequent label; of equals the smallest."""
    row = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()
    if row is None:
        raise ValueError("no labels")
    return row[0]


def check_default(df: DataFrame, label: str, value):
    if value is None:
        return default_label(df, label)
    if df.where(F.col(label) == F.lit(value)).limit(1).count() == 0:
        raise ValueError(f"default label {value!r} isn't among the labels")
    return value


def binary_labels(df: DataFrame, label: str) -> tuple[object, object]:
    """(negative, positive) of a two-valued label, in sorted order."""
    found = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"two label values are needed, found {found}")
    return found[0], found[1]


def label_flag(df: DataFrame, label: str, value) -> Column:
    """1 where the label is value, which is read as the label's type ('1.0' for an int column is 1)."""
    kind = df.schema[label].dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        value = int(float(value))
    elif isinstance(kind, T.StringType):
        value = str(value)
    return F.when(F.col(label) == F.lit(value), 1).otherwise(0)


def split_by_label(df: DataFrame, label: str, value) -> tuple[DataFrame, DataFrame]:
    flag = label_flag(df, label, value)
    return df.where(flag == 1), df.where(flag == 0)


def unpivoted(df: DataFrame, dims: list[str], weight: Column | None = None) -> DataFrame:
    """(dim, val, w) in long form, without a shuffle."""
    items = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"`{d}`").cast("string").alias("val")) for d in dims])
    return df.select((F.lit(1) if weight is None else weight).alias("w"), F.explode(items).alias("i")).select("i.dim", "i.val", "w")


def value_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    return unpivoted(df, dims).groupBy("dim", "val").agg(F.sum("w").alias("cnt"))


def column_profile(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, n, n_values, top_share): rows, distinct values but NULL, and the share of the most frequent value."""
    return value_counts(df, dims).groupBy("dim").agg(
        F.sum("cnt").alias("n"), F.count("val").alias("n_values"), (F.max("cnt") / F.sum("cnt")).alias("top_share")
    )


def bad_columns(df: DataFrame, dims: list[str], most_distinct: float = 0.7, most_top: float = 0.95) -> list[str]:
    """Columns with one value, nearly as many values as rows, or one value nearly everywhere."""
    bad = column_profile(df, dims).where((F.col("n_values") <= 1) | (F.col("n_values") / F.col("n") > most_distinct) | (F.col("top_share") > most_top))
    return sorted(r["dim"] for r in bad.collect())


def fill_missing(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.withColumns({d: F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(MISSING)) for d in dims})


def rare_values(df: DataFrame, dims: list[str], least: int, many: int = 10) -> dict[str, list[str]]:
    """For columns with more than ``many`` values below ``least`` rows: the values that stay, at most MAX_KEPT a column."""
    counts = value_counts(df, dims)
    rare = counts.groupBy("dim").agg(F.sum((F.col("cnt") < least).cast("int")).alias("rare"), F.sum((F.col("cnt") >= least).cast("int")).alias("stay")).where(F.col("rare") > many)
    if wide := [r["dim"] for r in rare.where(F.col("stay") > MAX_KEPT).collect()]:
        raise ValueError(f"columns {wide} keep over {MAX_KEPT} values; raise the count below which a value is rare")
    kept = counts.join(rare, "dim", "left_semi").where(F.col("cnt") >= least).groupBy("dim").agg(F.sort_array(F.collect_list("val")).alias("vals"))
    out = {r["dim"]: [] for r in rare.collect()}
    return out | {r["dim"]: r["vals"] for r in kept.collect()}


def fold_long_tail(df: DataFrame, dims: list[str], least: int, many: int = 10, kept: dict[str, list[str]] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rare values become OTHER; (folded, values that stay by column).  ``kept`` of a fit folds new data alike."""
    kept = rare_values(df, dims, least, many) if kept is None else kept
    return df.withColumns({d: F.when(F.col(f"`{d}`").cast("string").isin(v) | (F.col(f"`{d}`") == MISSING), F.col(f"`{d}`")).otherwise(F.lit(OTHER)) for d, v in kept.items()}), kept


def compress(df: DataFrame, dims: list[str], label: str, count: str | None = None, measures: tuple[str, ...] = ()) -> DataFrame:
    """Weighted groups: dims, label, count and the sums of measures."""
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    return df.groupBy(*dims, label).agg(n.alias("count"), *[F.sum(m).alias(m) for m in measures])


def downsample_negatives(df: DataFrame, flag: str, key: str, below: float = 0.001, ratio: int = 1000) -> DataFrame:
    """If positives are rarer than ``below``: all of them and about ratio times as many negatives, chosen by a hash of key."""
    n, p = df.agg(F.count(F.lit(1)), F.sum(flag)).first()
    if not n or not p or p / n >= below:
        return df
    share = min(1.0, ratio * p / (n - p))
    return df.where((F.col(flag) == 1) | (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / (population deviation + 1e-15), from one aggregate over all rows."""
    stats = df.agg(*[f(c).alias(f"{c}__{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"{c}__m"])) / F.lit((stats[f"{c}__s"] or 0.0) + 1e-15) for c in columns})


def filter_by_pattern(df: DataFrame, pattern: dict[str, str], kept: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of the original data that a pattern {dim: value} describes; MISSING means NULL and OTHER a value that was folded."""
    cond = F.lit(True)
    for d, v in pattern.items():
        c = F.col(f"`{d}`").cast("string")
        own = c.isNull() if v == MISSING else (c.isNotNull() & ~c.isin((kept or {}).get(d, []))) if v == OTHER else F.coalesce(c == v, F.lit(False))
        cond = cond & own
    return df.where(cond)
