"""A directory walk as a Spark data source: one partition per root.

Symbolic links are not followed and not listed; folders that fit an exclude
pattern are not entered.  A folder that cannot be read gives a row with its
error and no size.
"""

from __future__ import annotations

import fnmatch
import json
import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, base_dir string, size bigint, mtime double, dev bigint, ino bigint, drive string, error string"


def mount_label(path: str, dev: int) -> str:
    """The mount point that path lies under; the device number where there is
    none on the way up."""
    here = path
    try:
        while os.lstat(here).st_dev == dev:
            if os.path.ismount(here):
                return here
            here = os.path.dirname(here)
    except OSError:
        pass
    return f"dev{dev}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.patterns = json.loads(options.get("exclude", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.roots]

    def _skipped(self, rel: str) -> bool:
        return any(fnmatch.fnmatch(rel, p) or fnmatch.fnmatch(rel.rsplit("/", 1)[-1], p) for p in self.patterns)

    def read(self, partition: InputPartition):
        root = partition.value
        failed: list[OSError] = []
        labels: dict[int, str] = {}
        for top, dirs, names in os.walk(root, onerror=failed.append):
            below = lambda name, top=top: os.path.relpath(os.path.join(top, name), root).replace(os.sep, "/")
            dirs[:] = sorted(d for d in dirs if not self._skipped(below(d)))
            for name in sorted(names):
                path = os.path.join(top, name)
                try:
                    s = os.lstat(path)
                except OSError as e:
                    failed.append(e)
                    continue
                if stat.S_ISREG(s.st_mode) and not self._skipped(below(name)):
                    if s.st_dev not in labels:
                        labels[s.st_dev] = mount_label(top, s.st_dev)
                    yield path, root, s.st_size, s.st_mtime, s.st_dev, s.st_ino, labels[s.st_dev], None
        for e in failed:
            yield e.filename, root, None, None, None, None, None, e.strerror


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, roots: list[str], exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, errors) below existing roots; a path that overlapping roots
    reach twice is one row."""
    found = [str(p) for p in dict.fromkeys(Path(r).expanduser().resolve() for r in roots) if p.is_dir()]
    if not found:
        raise ValueError("no valid directory")
    spark.dataSource.register(WalkSource)
    rows = spark.read.format("walk").option("roots", json.dumps(found)).option("exclude", json.dumps(exclude or [])).load()
    files = rows.where("error is null").drop("error").dropDuplicates(["path"])
    return files, rows.where("error is not null").select("path", "error")
