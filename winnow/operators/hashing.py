"""Size reduction, staged hashing and the hash cache.

Each reduction is an aggregation joined back, so that a size that a third of
all files share is pre-aggregated and its join partition can be split; content
is read only for rows that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.scalars import partial_sha


def size_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("size").agg(F.count("*").alias("n"))


def colliding(files: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key values occur more than once."""
    many = files.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys)
    return files.join(many, keys, "left_semi")


def staged_hash(files: DataFrame, content: str, chunk: int, quick: bool = False) -> DataFrame:
    """Rows of colliding sizes with partial_hash and, where (size, partial)
    collides, sha256; quick takes the partial hash for the whole."""
    partial = colliding(files, ["size"]).withColumn("partial_hash", partial_sha(F.col(content), chunk))
    if quick:
        return partial.withColumn("sha256", F.col("partial_hash"))
    many = partial.groupBy("size", "partial_hash").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n").withColumn("__full", F.lit(True))
    full = F.when(F.col("__full"), F.sha2(F.col(content).cast("binary"), 256))
    return partial.join(many, ["size", "partial_hash"], "left").withColumn("sha256", full).drop("__full")


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds the cached hash where path, size and mtime are the same and the
    entry is a verified full hash; null elsewhere."""
    good = cache.where("verified and sha256 is not null and sha256 <> ''").dropDuplicates(["path"])
    return files.join(good.select("path", "size", "mtime", F.col("sha256").alias("cached_sha")), ["path", "size", "mtime"], "left")


def cache_entries(files: DataFrame) -> DataFrame:
    """What to store: rows with a full hash only."""
    return files.where("sha256 is not null").select("path", "size", "mtime", "sha256", "duration", F.lit(True).alias("verified"))


def scan_counters(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache hits, rows skipped for a size of their own, rows to hash, empty."""
    known = cache_lookup(files, cache)
    many = size_histogram(files).where("n > 1").select("size", F.lit(True).alias("many"))
    full, hit = F.col("size") > 0, F.col("cached_sha").isNotNull()
    return known.join(many, "size", "left").agg(
        F.count_if(full & hit).alias("cache_hits"), F.count_if(full & ~hit & F.col("many").isNull()).alias("skipped_unique"),
        F.count_if(full & ~hit & F.col("many").isNotNull()).alias("hashed"), F.count_if(F.col("size") == 0).alias("skipped_empty"),
    )


def stale_check(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """status per recorded path: ok, missing, or changed."""
    now = current.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    same = (F.col("size") == F.col("size_now")) & (F.col("mtime") == F.col("mtime_now"))
    status = F.when(F.col("size_now").isNull(), "missing").when(same, "ok").otherwise("changed")
    return recorded.join(now, "path", "left").withColumn("status", status).drop("size_now", "mtime_now")
