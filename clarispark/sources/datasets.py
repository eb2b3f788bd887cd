"""Where feature tables come from: CSV with a description, in-memory data, enumerated boards."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DatasetLoader:
    """<basedir>/<name>/data.csv and meta.json {"label": column, "positive": SQL expression}.

    ``dataframe`` has the label as int column ``label`` and not the source column it came from.
    """

    def __init__(self, spark: SparkSession, name: str, basedir: str = "datasets"):
        self.spark, self.name, self.path = spark, name, f"{basedir}/{name}"
        text = "\n".join(r["value"] for r in spark.read.text(f"{self.path}/meta.json").collect())
        self.meta = json.loads(text)

    @property
    def dataframe(self) -> DataFrame:
        raw = self.spark.read.csv(f"{self.path}/data.csv", header=True, inferSchema=True)
        label = F.coalesce(F.expr(self.meta["positive"]).cast("int"), F.lit(0))
        return raw.withColumn("__label", label).drop(self.meta["label"]).withColumnRenamed("__label", "label")


def read_headerless(spark: SparkSession, path: str, label: str = "label", names: list[str] | None = None) -> DataFrame:
    """A CSV file without a header, its last column the label; other columns are named '0', '1', ... unless names are given."""
    raw = spark.read.csv(path, header=False, inferSchema=True)
    own = names or [str(i) for i in range(len(raw.columns) - 1)]
    if len(own) != len(raw.columns) - 1:
        raise ValueError(f"{len(own)} names for {len(raw.columns) - 1} columns beside the label")
    return raw.toDF(*own, label)


def tic_tac_toe(spark: SparkSession) -> DataFrame:
    """All boards on which a game of noughts and crosses, x first, can end: columns s0..s8 (x, o, b) and label, x wins or not."""
    lines = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6)]
    won = lambda b, p: any(b[i] == b[j] == b[k] == p for i, j, k in lines)
    ends, todo, seen = set(), [("b" * 9, "x")], set()
    while todo:
        board, turn = todo.pop()
        if board in seen:
            continue
        seen.add(board)
        if won(board, "x") or won(board, "o") or "b" not in board:
            ends.add(board)
            continue
        todo += [(board[:i] + turn + board[i + 1 :], "o" if turn == "x" else "x") for i in range(9) if board[i] == "b"]
    rows = [(*b, "positive" if won(b, "x") else "negative") for b in sorted(ends)]
    return spark.createDataFrame(rows, [*(f"s{i}" for i in range(9)), "label"])


def ensure_dataframe(spark: SparkSession, data, label=None, prefix: str = "f", label_name: str = "label") -> DataFrame:
    """A DataFrame of Spark, pandas or numpy data (columns prefix0..), with the label column joined by position at ingest."""
    if isinstance(data, DataFrame):
        return data
    frame = data.copy() if isinstance(data, pd.DataFrame) else pd.DataFrame(np.asarray(data))
    frame.columns = [c if isinstance(c, str) else f"{prefix}{c}" for c in frame.columns]
    if label is not None:
        own = np.asarray(label)
        own = own[:, 0] if own.ndim == 2 else own
        if len(own) != len(frame):
            raise ValueError(f"{len(frame)} rows but {len(own)} labels")
        frame[label_name] = own
    return spark.createDataFrame(frame)


def write_rules(spark: SparkSession, lines: list[str], path: str) -> None:
    """Rendered rules as a text table on any file system that Spark writes to."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
