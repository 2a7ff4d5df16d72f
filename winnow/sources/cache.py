"""The persistent hash cache: JSON lines in a folder, one row per path."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.hashing import cache_entries
from winnow.schemas import HASH_CACHE


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored entries; none where there is no cache yet, and rows that are
    not JSON count as no entry."""
    try:
        return spark.read.schema(HASH_CACHE).option("mode", "DROPMALFORMED").json(path).where("path is not null")
    except AnalysisException:
        return spark.createDataFrame([], HASH_CACHE)


def save_cache(files: DataFrame, path: str) -> None:
    """Adds the fully hashed rows of files; a path's new entry replaces its old
    one.  The new folder is complete before the old one goes."""
    spark = files.sparkSession
    new = cache_entries(files)
    old = load_cache(spark, path).join(new.select("path"), "path", "left_anti")
    old.select(*new.columns).unionByName(new).dropDuplicates(["path"]).write.mode("overwrite").json(f"{path}.new")
    here, fs = _files(spark, path)
    fs.delete(here, True)
    fs.rename(_files(spark, f"{path}.new")[0], here)


def cache_size(spark: SparkSession, path: str) -> int:
    return load_cache(spark, path).agg(F.count("*")).first()[0]
