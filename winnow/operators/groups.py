"""Exact duplicate groups, their metrics, keep strategies and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.storage import durable

STRATEGIES = ["newest", "oldest", "largest", "smallest", "shortest", "longest", "first", "spread", "manual"]


def group_metrics(files: DataFrame, hardlinks: bool = True, strict_size: bool = True) -> DataFrame:
    """Groups of at least two rows with one hash (and size): n, sizes, waste,
    sorted drives, hardlinks.  Rows without a hash belong to none."""
    inode = F.when(F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.struct("dev", "ino"))
    keys = ["sha256", "size"] if strict_size else ["sha256"]
    size = F.col("size") if strict_size else F.min("size")
    g = files.where("sha256 is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), *([] if strict_size else [F.min("size").alias("size")]),
        F.count_distinct(inode).alias("inodes"), F.count_if(inode.isNull()).alias("unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("drive") != "", F.col("drive")))), ", ").alias("drives"),
    )
    size = F.col("size")
    copies = F.greatest(F.col("inodes") + F.col("unknown") - 1, F.lit(0)) if hardlinks else F.col("n") - 1
    return g.where("n > 1").select(
        F.col("sha256").alias("hash_key"), "n", "size", (size * F.col("n")).alias("total_size"), (size * copies).alias("wasted_size"), "drives",
        (F.col("inodes") < F.col("n") - F.col("unknown")).alias("has_hardlinks"),
    )


def ordinal(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Numbers rows from 1 inside each key by order.  Rows are dealt by range of
    key and order and stored, numbered inside their range, and the numbers of
    the ranges before are added, so neither all rows nor a key meets in a task."""
    dealt = rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    stored = durable(dealt)
    counts = stored.groupBy("__part", *keys).agg(F.count("*").alias("__n"))  # a few rows per range
    before = F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("__part", *keys, F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    placed = stored.withColumn("__inside", inside).join(base, ["__part", *keys])
    return placed.select(*rows.columns, (F.col("__base") + F.col("__inside")).cast("bigint").alias(name))


def numbered(groups: DataFrame) -> DataFrame:
    """group_no by waste, largest first."""
    return ordinal(groups, [], [F.desc("wasted_size"), F.asc("hash_key"), F.asc("size")], "group_no")


def members(files: DataFrame) -> DataFrame:
    """Rows of files that belong to a group, in long form, with hash_key."""
    many = files.where("sha256 is not null").groupBy("sha256", "size").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return files.join(many, ["sha256", "size"], "left_semi").withColumn("hash_key", F.col("sha256"))


def totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("wasted_size"), F.lit(0)).alias("total_wasted"))


def pick_keepers(rows: DataFrame, strategy: str, key: list[str] | None = None) -> DataFrame:
    """Adds action: keep, delete, or review (manual) to the rows of groups.

    Ties keep the smallest ord.  The keeper is found by an aggregation (one
    smallest struct a group) and joined back, so a group may be of any size.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "manual":
        return rows.withColumn("action", F.lit("review"))
    key = [*(key or ["hash_key", "size"]), *(["drive"] if strategy == "spread" else [])]
    col = {"newest": "mtime", "oldest": "mtime", "largest": "size", "smallest": "size", "shortest": "duration", "longest": "duration"}.get(strategy)
    value = F.col(col).cast("double") if col else F.lit(0.0)
    rank = F.coalesce(-value if strategy in ("newest", "largest", "longest") else value, F.lit(float("inf")))
    best = rows.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), F.col("ord"))).alias("__best"))
    joined = rows.join(best.select(*[F.col(k).alias(f"__{k}") for k in key], "__best"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return joined.withColumn("action", F.when(F.col("ord") == F.col("__best.ord"), "keep").otherwise("delete")).select(*rows.columns, "action")


def pick_by_choice(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """action from a table (hash_key, pick): the pick-th member (from 1, by
    ord) is kept; groups without a valid pick are skipped."""
    sized = ordinal(rows, ["hash_key"], [F.asc("ord")], "pos")
    n = rows.groupBy("hash_key").agg(F.count("*").alias("__n"))
    valid = choices.join(n, "hash_key").where("pick between 1 and __n").select("hash_key", "pick")
    action = F.when(F.col("pick").isNull(), "skip").when(F.col("pos") == F.col("pick"), "keep").otherwise("delete")
    return sized.join(valid, "hash_key", "left").withColumn("action", action).drop("pick", "pos")


def bytes_saved(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "delete").alias("deletions"), F.coalesce(F.sum(F.when(F.col("action") == "delete", F.col("size"))), F.lit(0)).alias("bytes_saved"))


def bytes_freed(plan: DataFrame) -> DataFrame:
    """Hardlink-aware: an inode counts once, and not at all if a kept row has
    it; unknown inodes count in full."""
    gone, kept = plan.where("action = 'delete'"), plan.where("action = 'keep' and dev is not null and ino is not null")
    unknown = gone.where("dev is null or ino is null").select("size")
    ids = ["hash_key", "dev", "ino"]
    known = gone.where("dev is not null and ino is not null").join(kept.select(*ids).distinct(), ids, "left_anti").dropDuplicates(ids).select("size")
    return unknown.unionAll(known).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))
