"""Durable intermediate tables.

`durable(df)` cuts lineage by writing Parquet under the folder the cluster
names in spark.checkpoint.dir, which driver and executors share, so a lost
executor never loses an intermediate result.  Only where that setting is
absent (tests, local mode) a folder of this session is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="winnow-")
    return _LOCAL[key]


class Durable:
    """A written table; `df` reads it, `drop()` removes it once superseded."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_OPEN: list[list[Durable]] = []  # tables written inside each open `scratch`


def materialise(df: DataFrame) -> Durable:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Durable(spark, path, df.schema)


def durable(df: DataFrame) -> DataFrame:
    """df as a written table.  Inside a `scratch` block it lasts to its end,
    else until the folder is cleaned."""
    return held(materialise(df))


def held(table: Durable) -> DataFrame:
    """A written table that the innermost `scratch` block is to remove."""
    if _OPEN:
        _OPEN[-1].append(table)
    return table.df


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables written by `durable` inside the block at its end;
    what is used later must be written by `lasting`."""
    _OPEN.append([])
    try:
        yield
    finally:
        for table in _OPEN.pop():
            table.drop()


def lasting(df: DataFrame) -> DataFrame:
    """df as a written table that outlives the innermost `scratch` block."""
    table = materialise(df)
    if len(_OPEN) > 1:
        _OPEN[-2].append(table)
    return table.df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many tasks as there are cores, for work that costs
    more than moving the rows; only where df is a scan of fewer splits (a few
    row groups).  Rows and results are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
