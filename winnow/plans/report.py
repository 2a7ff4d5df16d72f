"""Reports and plans as rows; writing them is left to the caller or `write_report`."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.scalars import format_duration, format_size
from winnow.operators.groups import group_metrics, members, numbered, ordinal, totals


def csv_rows(files: DataFrame, hardlinks: bool = True) -> DataFrame:
    g = numbered(group_metrics(files)).select("group_no", "hash_key", "size", "has_hardlinks")
    rows = members(files).join(g, ["hash_key", "size"])
    inode = F.when(F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.concat_ws(":", "dev", "ino"))
    more = [inode.alias("inode"), F.col("has_hardlinks").alias("group_has_hardlinks")] if hardlinks else []
    return rows.select(F.col("group_no").alias("group"), F.col("hash_key").alias("hash"), "drive", "path", "size", "mtime", "duration", "is_video", *more)


def table_rows(files: DataFrame) -> DataFrame:
    sample = members(files).groupBy("hash_key", "size").agg(F.min_by("path", "ord").alias("sample"))
    g = numbered(group_metrics(files)).join(sample, ["hash_key", "size"])
    return g.select(
        "group_no", "n", F.substring("drives", 1, 18).alias("drives"), format_size(F.col("size")).alias("size_each"),
        format_size(F.col("wasted_size")).alias("wasted"), F.substring("sample", 1, 35).alias("sample"), F.when(F.col("has_hardlinks"), "*").otherwise("").alias("mark"),
    )


def detailed_rows(files: DataFrame) -> DataFrame:
    r = csv_rows(files)
    return r.select(
        "group", F.substring("hash", 1, 16).alias("hash16"), "path", format_size(F.col("size")).alias("size_text"),
        F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm").alias("modified"),
        F.when(F.col("duration") > 0, format_duration(F.col("duration"))).otherwise("").alias("duration_text"),
    )


NOTHING = "[+] No duplicates found."
NO_FUZZY = "[+] No fuzzy (same-content, different-size) video duplicates found."
RULE = "-" * 100


def ordered_members(files: DataFrame) -> DataFrame:
    """Members of groups with group_no, pos (from 1, by ord) and the group's
    n, wasted_size, drives and has_hardlinks."""
    placed = ordinal(members(files), ["hash_key", "size"], [F.asc("ord")], "pos")
    g = numbered(group_metrics(files)).select("group_no", "hash_key", "size", "n", "wasted_size", F.col("drives").alias("group_drives"), "has_hardlinks")
    return placed.join(g, ["hash_key", "size"])


def json_lines(files: DataFrame, timestamp: str) -> DataFrame:
    """(group_no, pos, line): the lines of one JSON document with timestamp,
    total_groups, total_wasted_bytes and groups, each with its files.  A line
    holds one file at most, so a group of any size makes no long row."""
    rows = ordered_members(files)
    inode = F.when(F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.concat_ws(":", "dev", "ino")).alias("inode")
    keep_nulls = {"ignoreNullFields": "false"}
    entry = F.to_json(F.struct("path", "size", "mtime", "drive", "sha256", "duration", "is_video", inode), keep_nulls)
    file = rows.select("group_no", "pos", F.concat(entry, F.when(F.col("pos") < F.col("n"), ",").otherwise("")).alias("line"))
    groups = rows.where("pos = 1").select("group_no", "hash_key", "n", "wasted_size", "group_drives", "has_hardlinks")
    whole = groups.agg(F.count("*").alias("g"), F.coalesce(F.sum("wasted_size"), F.lit(0)).alias("w"))
    drives = F.filter(F.split("group_drives", ", "), lambda d: d != "")
    head = F.to_json(F.struct(F.col("hash_key").alias("hash"), F.col("wasted_size").alias("wasted_bytes"), "has_hardlinks", drives.alias("drives")))
    opened = groups.select("group_no", F.lit(0).cast("bigint").alias("pos"), F.concat(F.rtrim(head, F.lit("}")), F.lit(', "files": [')).alias("line"))
    last = groups.join(F.broadcast(whole.select(F.col("g").alias("group_no"), F.lit(True).alias("last"))), "group_no", "left")
    closed = last.select("group_no", (F.col("n") + 1).alias("pos"), F.when(F.col("last"), "]}").otherwise("]},").alias("line"))
    zero, end = F.lit(0).cast("bigint"), F.lit((1 << 62)).cast("bigint")
    first = whole.select(zero.alias("group_no"), zero.alias("pos"), F.concat(F.lit('{"timestamp": "' + timestamp + '", "total_groups": '), F.col("g"), F.lit(', "total_wasted_bytes": '), F.col("w"), F.lit(', "groups": [')).alias("line"))
    tail = whole.select(end.alias("group_no"), zero.alias("pos"), F.lit("]}").alias("line"))
    return first.unionByName(opened).unionByName(file).unionByName(closed).unionByName(tail)


def dry_run(plan: DataFrame) -> DataFrame:
    return plan.where("action = 'delete'").select("hash_key", "path", F.format_string("[DRY-RUN] Would delete: [%s] %s", "drive", "path").alias("message"))


def text_table(files: DataFrame) -> Iterator[str]:
    """The table report with its head and totals, a row at a time."""
    rows = table_rows(files).orderBy("group_no").toLocalIterator()
    first = next(rows, None)
    if first is None:
        yield NOTHING
        return
    yield f"{'GROUP':<8} {'FILES':<8} {'DRIVES':<20} {'SIZE EACH':<14} {'WASTED':<14} SAMPLE PATH"
    yield RULE
    marked = False
    for r in chain([first], rows):
        marked = marked or bool(r.mark)
        yield f"{r.group_no:<8} {r.n:<8} {r.drives:<20} {r.size_each:<14} {r.wasted:<14} {r.mark}{r.sample}"
    yield RULE
    t = totals(group_metrics(files)).select("total_groups", format_size(F.col("total_wasted")).alias("w")).first()
    yield f"Total groups: {t.total_groups} | Total wasted space: {t.w}"
    if marked:
        yield "* = group includes hardlinked copies (already share disk space; wasted size already accounts for this)"


def _named(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _dressed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "size_text": format_size(F.col("size")), "modified": F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm"),
        "dur": F.when(F.col("duration") > 0, F.concat(F.lit(" | "), format_duration(F.col("duration")))).otherwise(""), "name": _named(F.col("path")),
    })


def text_detailed(files: DataFrame) -> Iterator[str]:
    """The detailed report: a head per group, two lines per file, the total."""
    t = totals(group_metrics(files)).select("total_groups", format_size(F.col("total_wasted")).alias("w")).first()
    if not t.total_groups:
        yield NOTHING
        return
    rows = _dressed(ordered_members(files)).withColumn("wasted", format_size(F.col("wasted_size")))
    for r in rows.orderBy("group_no", "pos").toLocalIterator():
        if r.pos == 1:
            yield f"\n--- [ Group {r.group_no} / {t.total_groups} ] ---"
            yield f"Hash: {r.hash_key[:16]}... | Size each: {r.size_text} | Wasted: {r.wasted}"
            if r.has_hardlinks:
                yield "NOTE: includes hardlinked copies, which share disk space; 'Wasted' leaves them out."
            yield f"Drives: {r.group_drives}"
        yield f"  [{r.pos}] [{r.drive}] {r.name}"
        yield f"      Path: {r.path}"
        yield f"      Modified: {r.modified}{r.dur}"
    yield "\n" + "=" * 60
    yield f"Total wasted space: {t.w}"


def fuzzy_rows(groups: DataFrame, videos: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of fuzzy groups in report order: group_no by waste, pos by ord."""
    g = ordinal(groups, [], [F.desc("wasted_size"), F.asc("component")], "group_no")
    g = g.select("group_no", "component", "n", "similarity", "wasted_size", "duration_spread", F.col("drives").alias("group_drives"))
    placed = ordinal(parts.join(videos.select("ord", "path", "drive", "size", "mtime", "duration"), "ord"), ["component"], [F.asc("ord")], "pos")
    return placed.join(g, "component")


def text_fuzzy(rows: DataFrame) -> Iterator[str]:
    """The fuzzy report over fuzzy_rows."""
    t = rows.where("pos = 1").agg(F.count("*").alias("g"), format_size(F.coalesce(F.sum("wasted_size"), F.lit(0))).alias("w")).first()
    if not t.g:
        yield NO_FUZZY
        return
    yield from ["\n" + "#" * 60, "  PROBABLE VIDEO DUPLICATES (perceptual match, not exact)", "#" * 60]
    dressed = _dressed(rows).withColumns({"saves": format_size(F.col("wasted_size")), "spread": format_duration(F.col("duration_spread"))})
    for r in dressed.orderBy("group_no", "pos").toLocalIterator():
        if r.pos == 1:
            yield f"\n--- [ Fuzzy Group {r.group_no} / {t.g} ] ~{r.similarity:.0f}% match ---"
            yield f"Drives: {r.group_drives} | Potential savings: {r.saves}"
            if r.duration_spread > 2:
                yield f"Runtime differs by up to {r.spread} across this group -- looks like a trim, not just a re-encode."
        yield f"  [{r.pos}] [{r.drive}] {r.name} ({r.size_text}{r.dur})"
        yield f"      Path: {r.path} | Modified: {r.modified}"
    yield "\n" + "=" * 60
    yield "These matched by duration and frame hashes, not byte by byte: review before deleting."
    yield f"Potential additional savings: {t.w}"


def text_csv(files: DataFrame) -> Iterator[str]:
    rows = csv_rows(files)
    ordered = rows.orderBy("group", "path")
    yield ",".join(rows.columns)
    line = F.to_csv(F.struct(*rows.columns))
    for r in ordered.select(line.alias("x")).toLocalIterator():
        yield r.x


def text_json(files: DataFrame) -> Iterator[str]:
    stamp = datetime.now().isoformat()
    for r in json_lines(files, stamp).orderBy("group_no", "pos").toLocalIterator():
        yield r.line


FORMATS = {"table": text_table, "detailed": text_detailed, "json": text_json, "csv": text_csv}


def skipped_folders(errors: DataFrame) -> list[str]:
    """The notice about folders that could not be read: their number and the
    first five."""
    n = errors.count()
    if not n:
        return []
    shown = [f"    - {r.path}" for r in errors.orderBy("path").limit(5).collect()]
    return [f"[!] Skipped {n} unreadable {'directory' if n == 1 else 'directories'} (permission denied)", *shown, *([f"    ... and {n - 5} more"] if n > 5 else [])]


def write_report(files: DataFrame, path: str) -> None:
    """One file, by the ending of path: .json, .csv, or the detailed text.
    Lines are streamed, so the driver holds one at a time."""
    kind = {".json": "json", ".csv": "csv"}.get(os.path.splitext(path)[1].lower(), "detailed")
    with open(path, "w", encoding="utf-8") as f:
        for line in FORMATS[kind](files):
            f.write(line + "\n")
