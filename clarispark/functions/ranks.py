"""Exact quantiles and ranks of many columns at once, without bringing a column into one task.

Distinct values are counted per column, sorted over all tasks by (column, value), and written with
running counts within each task.  The tasks' totals, a row per task and column, place every task's
counts among all; the values at the wanted ranks are then read off, two rows a quantile at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.session import materialize, release


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), {}
    for frame in frames:
        upto = frame.groupby("c")["n"].cumsum() + frame["c"].map(done).fillna(0).astype("int64")
        done |= dict(zip(frame["c"], upto, strict=True))  # the last of each column counts
        yield pd.DataFrame({"c": frame["c"], "v": frame["v"], "n": frame["n"], "upto": upto, "part": part})


def values_at(df: DataFrame, ranks: dict[str, list[int]] | None, fractions: dict[str, list[float]] | None = None, distinct: bool = False) -> dict[str, list[float]]:
    """Of each column (numbers but NULL and NaN), the values at ranks from 0 on, or, interpolated, at fractions of the last rank.

    ``distinct``: ranks are among distinct values.  ``ranks`` may depend on the number of values:
    a function of it instead of a list.  Columns without values give empty lists.
    """
    wanted = ranks if ranks is not None else fractions
    names = list(wanted)
    if not names:
        return {}
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(names)])
    long = df.select(F.explode(items).alias("x")).select("x.c", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    counted = long.groupBy("c", "v").agg(F.lit(1).cast("long").alias("n") if distinct else F.count(F.lit(1)).alias("n"))
    table = materialize(counted.orderBy("c", "v").mapInPandas(_running, "c int, v double, n long, upto long, part int"), "sorted_values")
    try:
        bases: dict[tuple[int, int], int] = {}
        sizes = dict.fromkeys(range(len(names)), 0)
        for r in table.groupBy("c", "part").agg(F.max("upto").alias("n")).orderBy("c", "part").collect():  # a row per task and column
            bases[r["c"], r["part"]] = sizes[r["c"]]
            sizes[r["c"]] += r["n"]
        places: dict[int, list[tuple[int, int, float]]] = {}
        for i, c in enumerate(names):
            own = wanted[c](sizes[i]) if callable(wanted[c]) else wanted[c]
            at = [(int(r), int(r), 0.0) for r in own] if ranks is not None else [(int(p), min(int(p) + 1, sizes[i] - 1), p - int(p)) for p in (q * (sizes[i] - 1) for q in own)]
            places[i] = at if sizes[i] else []
        asked = sorted({(i, r) for i, at in places.items() for lo, hi, _ in at for r in (lo, hi)})
        rows = []
        for i, r in asked:
            part = max(p for (c, p), base in bases.items() if c == i and base <= r)
            rows.append((i, part, r - bases[i, part], r))
        spark = df.sparkSession
        targets = spark.createDataFrame(rows or [(-1, -1, 0, 0)], "c int, part int, within long, rank long")  # two rows a quantile at most
        hit = table.join(F.broadcast(targets), ["c", "part"]).where("within < upto AND within >= upto - n")
        found = {(r["c"], r["rank"]): r["v"] for r in hit.select("c", "rank", "v").collect()}
    finally:
        release(table)
    return {c: [found[i, lo] + (found[i, hi] - found[i, lo]) * t if t else found[i, lo] for lo, hi, t in places[i]] for i, c in enumerate(names)}


def quantiles(df: DataFrame, columns: list[str], fractions: list[float]) -> dict[str, list[float]]:
    """Exact quantiles, interpolated between neighbours."""
    return values_at(df, None, dict.fromkeys(columns, fractions))
