"""Command line: scan, clean, fuzzyclean and export; a shell without a command.

Exit code 0: nothing found or done; 1: duplicates found, no folder, or not
confirmed.  Nothing is removed without --apply.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.engine import Engine, apply_plan, confirmed
from winnow.functions.scalars import format_size, parse_size
from winnow.operators import fuzzy as fuzzy_operators
from winnow.operators import groups
from winnow.operators.groups import STRATEGIES
from winnow.plans import report
from winnow.session import local_session
from winnow.sources.cache import load_cache, save_cache


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="winnow")
    p.add_argument("command", nargs="?", choices=["scan", "clean", "fuzzyclean", "export"])
    p.add_argument("paths", nargs="*")
    p.add_argument("--video", "--video-only", action="store_true")
    p.add_argument("--quick", action="store_true")
    p.add_argument("--include-empty", action="store_true")
    p.add_argument("--skip-system", action="store_true")
    p.add_argument("--min-size", type=parse_size, default=0)
    p.add_argument("--max-size", type=parse_size, default=0)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--cache", "--cache-file", default="")
    p.add_argument("--workers", default="*", help="cores that are used")
    p.add_argument("--format", choices=list(report.FORMATS), default="detailed")
    p.add_argument("--fuzzy", action="store_true")
    p.add_argument("--fuzzy-tolerance", type=float, default=5.0)
    p.add_argument("--fuzzy-tolerance-ratio", type=float, default=0.5)
    p.add_argument("--fuzzy-frames", type=int, default=8)
    p.add_argument("--fuzzy-threshold", type=float, default=10)
    p.add_argument("--probe", default="ffprobe", help="tool that tells durations")
    p.add_argument("--grab", default="ffmpeg", help="tool that takes frames")
    p.add_argument("--strategy", choices=STRATEGIES, default="manual")
    p.add_argument("--interactive", action="store_true")
    p.add_argument("--trash", action="store_true", default=True)
    p.add_argument("--no-trash", dest="trash", action="store_false")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--yes", "-y", action="store_true")
    p.add_argument("--output", "-o", default="report.json")
    return p


def scan(engine: Engine, a: argparse.Namespace) -> DataFrame:
    cache = load_cache(engine.spark, a.cache) if a.cache else None
    files = engine.scan(a.paths or ["."], a.video, a.quick, a.min_size, a.max_size, a.include_empty, a.exclude, a.skip_system, cache)
    print("\n".join(report.skipped_folders(engine.errors)), end="")
    if a.cache and not a.quick:
        save_cache(files, a.cache)
    return files


def fuzzy_rows(engine: Engine, files: DataFrame, a: argparse.Namespace) -> DataFrame:
    return engine.fuzzy(files, a.fuzzy_tolerance, a.fuzzy_tolerance_ratio, a.fuzzy_frames, a.fuzzy_threshold, a.probe, a.grab)


def choose(rows: DataFrame, ask=input) -> tuple[DataFrame, bool]:
    """Asks for each group which member to keep: a number, s (skip) or q
    (quit).  rows: group_no, pos, n, key columns.  The plan of the answers."""
    spark, picks = rows.sparkSession, []
    for g in rows.where("pos = 1").select("group_no", "n").orderBy("group_no").toLocalIterator():
        for r in rows.where(F.col("group_no") == g.group_no).orderBy("pos").toLocalIterator():
            print(f"  [{r.pos}] [{r.drive}] {r.path}")
        try:
            answer = ask(f"Group {g.group_no}: keep (number, s skip, q quit) > ").strip().lower()
            while answer not in ("", "s", "skip", "q") and not (answer.isdigit() and 1 <= int(answer) <= g.n):
                answer = ask("Keep > ").strip().lower()
        except (EOFError, KeyboardInterrupt):
            answer = "q"
        if answer == "q":
            break
        if answer.isdigit():
            picks.append((g.group_no, int(answer)))
    chosen = spark.createDataFrame(picks, "group_no bigint, pick bigint")
    action = F.when(F.col("pos") == F.col("pick"), "keep").otherwise("delete")
    return rows.join(chosen, "group_no").withColumn("action", action).drop("pick"), bool(picks)


def clean(plan: DataFrame, a: argparse.Namespace, word: str = "DELETE", ask=input) -> int:
    """Dry run, or removal after confirmation.  A word other than DELETE has to
    be typed whatever else was said (fuzzy groups)."""
    freed = groups.bytes_freed(plan).select("bytes_freed", format_size(F.col("bytes_freed")).alias("x")).first()
    if not a.apply:
        for r in report.dry_run(plan).toLocalIterator():
            print(r.message)
        print(f"[+] Done. Space to free: {freed.x}")
        return 0
    count = plan.where("action = 'delete'").count()
    sure = word != "DELETE"
    if not confirmed(count, freed.x, a.trash and not sure, a.yes and not sure, word, ask):
        print("[!] Aborted -- no files were deleted.")
        return 1
    print("\n".join(apply_plan(plan, "DELETE", a.trash)))
    print(f"[+] Done. Space freed: {freed.x}")
    return 0


def run(engine: Engine, a: argparse.Namespace, ask=input) -> int:
    try:
        files = scan(engine, a)
    except ValueError as e:
        print(f"[!] {e}", file=sys.stderr)
        return 1
    if a.command == "export":
        report.write_report(files, a.output)
        print(f"[+] Report saved to: {Path(a.output)}")
        return 0
    if a.command == "scan":
        some = not groups.group_metrics(files).isEmpty()
        for line in report.FORMATS[a.format](files):
            print(line)
        if a.fuzzy:
            rows = fuzzy_rows(engine, files, a)
            some = some or not rows.isEmpty()
            print("\n".join(report.text_fuzzy(rows)))
        return int(some)
    return clean_files(engine, files, a, ask)


def clean_files(engine: Engine, files: DataFrame, a: argparse.Namespace, ask=input) -> int:
    by_hand = a.interactive or a.strategy == "manual"
    if a.command == "fuzzyclean":
        if a.strategy == "spread":
            print("[!] 'spread' is not for fuzzy groups, whose files differ.")
            return 1
        rows = fuzzy_rows(engine, files, a).withColumns({"hash_key": F.col("component"), "dev": F.lit(None).cast("bigint"), "ino": F.lit(None).cast("bigint")})
        if rows.isEmpty():
            print(report.NO_FUZZY)
            return 0
        plan = choose(rows, ask)[0] if by_hand else fuzzy_operators.fuzzy_plan(rows.select("ord"), rows.drop("ord").withColumn("ord", F.col("path")), a.strategy)
        return clean(plan, a, "YES", ask)
    if groups.group_metrics(files).isEmpty():
        print(report.NOTHING)
        return 0
    plan = choose(report.ordered_members(files), ask)[0] if by_hand else engine.plan(files, a.strategy)
    return clean(plan, a, ask=ask)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(local_session(a.workers))
    if not a.command:
        from winnow.shell import Shell

        Shell(engine, a).cmdloop()
        return 0
    return run(engine, a)


if __name__ == "__main__":
    sys.exit(main())
