"""Session helpers: table loading and tables written to the shared folder.

``materialize`` cuts lineage by writing a Parquet table below the folder that
the session names in ``spark.checkpoint.dir``.  Every executor and the driver
must see that folder, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR = "/tmp/checkpoints/clarispark"
_SCRATCH: list[list[DataFrame]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only for a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _LOCAL_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame, name: str = "table", kept: bool = False) -> DataFrame:
    """Writes df to the shared folder and returns a scan of what was written; kept: beyond the scratch around it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_path = path
    if _SCRATCH and not kept:
        _SCRATCH[-1].append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end: for steps whose result is written by then to a table of its own."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        release(*_SCRATCH.pop())


def release(*frames: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and that no plan still reads."""
    for df in frames:
        path = getattr(df, "_materialized_path", None)
        if path:
            spark = df.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
