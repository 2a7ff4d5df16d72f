"""Scan filters over a files table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.scalars import SYSTEM_IGNORE, glob_regex, is_video


def _relative(path: Column, base: str) -> Column:
    return F.substring(path, len(base.rstrip("/")) + 2, 1 << 30)


def _fits(rx: str):
    return lambda d: d.rlike(rx) | F.element_at(F.split(d, "/"), -1).rlike(rx)


def video_only(files: DataFrame) -> DataFrame:
    return files.where(is_video(F.col("path")))


def size_range(files: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Both ends included; 0 switches an end off."""
    out = files.where(F.col("size") >= least) if least else files
    return out.where(F.col("size") <= most) if most else out


def without_empty(files: DataFrame) -> DataFrame:
    return files.where("size > 0")


def count_empty(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("size") == 0).alias("skipped_empty"))


def exclude(files: DataFrame, patterns: list[str], base: str = "/", prune: bool = False, system: bool = False) -> DataFrame:
    """Drops rows whose path below base or whose name fits a glob; with prune,
    also rows below a folder that does."""
    rel = _relative(F.col("path"), base)
    parts = F.split(rel, "/")
    names = [F.element_at(parts, -1), rel]
    out = files
    for p in [*patterns, *(SYSTEM_IGNORE if system else [])]:
        rx = glob_regex(p)
        hit = names[0].rlike(rx) | names[1].rlike(rx)
        if prune:
            above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
            hit = hit | ((F.size(parts) > 1) & F.exists(above, _fits(rx)))
        out = out.where(~hit)
    return out
