import random

import duckdb
import pytest
from pyspark.sql import functions as F

import winnow.queries as Q
from winnow.functions import scalars as S
from winnow.operators import fuzzy, groups, hashing
from winnow.operators.components import connected_components

SF = "/root/testdata/sf0.01"
CORE = ["group_metrics", "hardlink_metrics", "quick_groups", "filter_prune_dirs", "keep_longest", "keep_spread", "bytes_freed", "cache_scan_counters", "candidate_pairs_ratio", "fp_aligned", "fuzzy_groups", "csv_rows", "json_report", "walk_source", "keep_choices", "table_rows", "detailed_rows"]


def norm(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.Q[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(Q.SQL[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted((tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall()), key=str)


def test_golden_scalars(spark):
    sizes = [(-5, "0 B"), (0, "0 B"), (512, "512.00 B"), (1023, "1023.00 B"), (1152, "1.12 KB"), (1408, "1.38 KB"), (1048575, "1024.00 KB"), (1048576, "1.00 MB"), (1610612736, "1.50 GB"), (2**50, "1.00 PB")]
    df = spark.createDataFrame(sizes, "n long, want string")
    assert df.where(S.format_size(F.col("n")) != F.col("want")).count() == 0
    times = [(None, "N/A"), (-1.0, "N/A"), (0.0, "00:00"), (59.9, "00:59"), (61.0, "01:01"), (3600.0, "01:00:00"), (360000.0, "100:00:00")]
    df = spark.createDataFrame(times, "s double, want string")
    assert [r[0] for r in df.select(S.format_duration(F.col("s"))).collect()] == [w for _, w in times]
    pairs = [("ff", "ff", 0), ("ff", "00", 8), ("ff00ff00ff00ff00", "0f00ff00ff00ff01", 5), ("zz", "00", 64), (None, "00", 64), ("", "00", 64)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert df.where(S.hamming(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    counts = [(1.0, 8), (119.9, 8), (120.0, 9), (300.0, 21), (435.0, 30), (7200.0, 30)]
    df = spark.createDataFrame(counts, "d double, want long")
    assert df.where(S.frame_count(F.col("d")) != F.col("want")).count() == 0
    assert [S.parse_size(x) for x in ("10MB", " 1.5 gb ", "10", "10B")] == [10485760, 1610612736, 10, 10]
    for bad in ("10K", "1.5", ""):
        with pytest.raises(ValueError):
            S.parse_size(bad)


def test_components_of_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(5, 5), (None, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_band_join_equals_naive(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([1.0, 2.5, 5.0, 7.5, 10.0, 15.0, rng.uniform(0.1, 90)])) for k in range(150)] + [(900, None), (901, 0.0)]
    v = spark.createDataFrame(rows, "ord long, duration double")
    good = [(k, d) for k, d in rows if d]
    for tol, ratio in ((2, 0.0), (5, 0.5), (0, 0.0), (0, 0.5)):
        want = {(a, b) for a, x in good for b, y in good if (y, b) > (x, a) and y - x <= max(tol, ratio * x)}
        assert {tuple(r) for r in fuzzy.candidate_pairs(v, tol, ratio).collect()} == want


def test_near_hashes_equal_brute_force(spark):
    rng = random.Random(8)
    flip = lambda h, k: h ^ sum(1 << i for i in rng.sample(range(64), k))
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1, 2**63]
    all_ = {h - 2**64 if h >> 63 else h for s in seeds for h in [s] + [flip(s, rng.randrange(17)) for _ in range(12)]}
    table = spark.createDataFrame([(h,) for h in all_], "h long")
    apart = {(x, y): ((x ^ y) & (2**64 - 1)).bit_count() for x in all_ for y in all_ if x < y}
    for radius in (0, 1, 2, 3, 7, 10, fuzzy.WIDEST):
        assert sorted(map(tuple, fuzzy.near_hashes(table, radius).collect())) == sorted(p for p, d in apart.items() if d <= radius), radius


def test_matched_videos_equal_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.getrandbits(64) - 2**63 for _ in range(rng.randrange(1, 6))] for _ in range(8)]
    rows = []
    for k in range(160):
        hs = list(rng.choice(base))
        for i in range(len(hs)):
            for bit in rng.sample(range(63), rng.choice([0, 0, 1, 4, 9, 14])):
                hs[i] ^= 1 << bit
        if k % 4 == 1:
            hs = hs[1:]  # may be empty
        if k % 9 == 2:
            hs.append(hs[0])
        if k % 20 == 3:
            hs.reverse()
        rows.append((k, rng.choice([6.0, 6.0, 9.0, 9.5, 20.0, 31.0]), [(float(i), h) for i, h in enumerate(hs)]))
    twins = [(200 + k, rng.choice([d, d, 9.0]), f) for k, (_, d, f) in enumerate(rows[:40])] + [(400 + k, d, f) for k, (_, d, f) in enumerate(rows[:40])]
    odd = [(900, None, rows[0][2]), (901, 0.0, rows[0][2]), (902, 9.0, None), (903, 9.0, []), (904, 9.0, [(0.0, None), *rows[0][2]]), (905, 9.0, [(0.0, None)])]
    loop = [(910 + k, 9.0, [(0.0, 5), (1.0, 7 << 40), (2.0, 5)]) for k in range(3)]  # not like itself: no order
    v = spark.createDataFrame(rows + twins + odd + loop, "ord long, duration double, frames array<struct<ts: double, h: long>>").cache()
    full = lambda df: sorted(tuple(r) for r in df.collect())
    for tol, ratio, threshold, monotone in ((5, 0.5, 10, 0.7), (2, 0.0, 10, 0.0), (0, 0.0, 0, 0.7), (5, 0.5, 3.5, 1.0), (5, 0.5, 14.9, 0.7), (5, 0.5, 22, 0.7)):
        want = full(fuzzy.match_pairs(fuzzy.candidate_pairs(v, tol, ratio), v, threshold=threshold, least_monotone=monotone))
        assert want and full(fuzzy.match_videos(v, tol, ratio, threshold, monotone)) == want
    assert not fuzzy.match_videos(v.limit(0), 5, 0.5).count() and not fuzzy.match_videos(v, 5, 0.5, -1).count()


@pytest.mark.parametrize("name", ["fp_aligned", "fuzzy_components", "fuzzy_groups", "fuzzy_clean_plan"])
def test_matches_without_all_pairs(spark, monkeypatch, name):
    def pairs(*_):
        raise AssertionError("every pair of videos of like durations is made")

    monkeypatch.setattr(fuzzy, "candidate_pairs", pairs)
    assert Q.Q[name](spark, SF).count() > 0


def test_keepers_ties_and_partition(spark):
    rows = [("h", 4, k, m, d, "x" if k % 2 else "") for k, m, d in ((1, 5.0, None), (2, 5.0, 3.0), (3, 4.0, 3.0), (4, 4.0, 9.0))]
    df = spark.createDataFrame(rows, "hash_key string, size long, ord long, mtime double, duration double, drive string")
    want = {"newest": {1}, "oldest": {3}, "largest": {1}, "smallest": {1}, "shortest": {2}, "longest": {4}, "first": {1}, "spread": {1, 2}}
    for name, kept in want.items():
        got = groups.pick_keepers(df, name).collect()
        assert {r.ord for r in got if r.action == "keep"} == kept and len(got) == 4
    with pytest.raises(ValueError):
        groups.pick_keepers(df, "best")


def test_hardlinks_in_freed_bytes(spark):
    rows = [("h", 1, "keep", 10, 1, 1), ("h", 2, "delete", 10, 1, 1), ("h", 3, "delete", 10, 1, 2), ("h", 4, "delete", 10, 1, 2), ("h", 5, "delete", 10, None, None)]
    plan = spark.createDataFrame(rows, "hash_key string, ord long, action string, size long, dev long, ino long")
    assert groups.bytes_freed(plan).first()[0] == 20


def test_stale_and_cache(spark):
    f = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("c", 3, 3.0)], "path string, size long, mtime double")
    now = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.5)], "path string, size long, mtime double")
    assert {r.path: r.status for r in hashing.stale_check(f, now).collect()} == {"a": "ok", "b": "changed", "c": "missing"}
    cache = spark.createDataFrame([("a", 1, 1.0, "x", True), ("b", 2, 9.0, "y", True), ("c", 3, 3.0, "z", False)], "path string, size long, mtime double, sha256 string, verified boolean")
    assert {r.path: r.cached_sha for r in hashing.cache_lookup(f, cache).collect()} == {"a": "x", "b": None, "c": None}


def test_walk(spark, tmp_path):
    from winnow.sources.walk import scan

    for name in ("a.txt", ".dot", "sub/_u", "skip/x"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    (tmp_path / "zero").touch()
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    files, errors = scan(spark, [str(tmp_path), str(tmp_path / "sub")], ["skip"])
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in files.collect()) == [".dot", "a.txt", "sub/_u", "zero"]
    assert errors.count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "winnow", tmp_path / "winnow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 50 and said[1] == "False" and int(said[2]) >= 50


FAKE_PROBE = """#!/usr/bin/env python3
import sys
name = sys.argv[-1].rsplit("/", 1)[-1]
by_stream = "-select_streams" in sys.argv
if name.startswith("bad"): sys.exit(1)
if name.startswith("stream"): print("N/A" if not by_stream else "60.0")
else: print({"a": "60.0", "b": "61.0", "c": "400.0", "d": "0.9"}[name[0]])
"""
FAKE_GRAB = """#!/usr/bin/env python3
import random, sys
name = sys.argv[sys.argv.index("-i") + 1].rsplit("/", 1)[-1]
at = float(sys.argv[sys.argv.index("-ss") + 1])
rng = random.Random(int(at // 8) if name[0] in "ab" else name + str(at))
sys.stdout.buffer.write(bytes(rng.randrange(256) for _ in range(1024)))
"""


@pytest.fixture
def tree(tmp_path):
    """Three equal files in two folders, two with equal ends, a lone one, videos and fake tools."""
    top = tmp_path / "top"
    for name, body in {"x/1.txt": b"same" * 20, "y/2.txt": b"same" * 20, "z/3.txt": b"same" * 20, "p.bin": b"A" * 30 + b"1" + b"A" * 30, "q.bin": b"A" * 30 + b"2" + b"A" * 30, "lone": b"l", "a.mp4": b"va" * 50, "b.mkv": b"vbb" * 70, "c.avi": b"vc" * 33, "d.mp4": b"short", "bad.mp4": b"bad", "stream.mov": b"s" * 9}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body)
    for name, body in {"probe": FAKE_PROBE, "grab": FAKE_GRAB}.items():
        (tmp_path / name).write_text(body)
        (tmp_path / name).chmod(0o755)
    return top


def test_scan_with_cache_and_quick(spark, tree, tmp_path):
    from winnow.engine import Engine
    from winnow.sources.cache import cache_size, load_cache, save_cache

    e, store = Engine(spark, chunk=20), str(tmp_path / "cache")
    names = lambda df: sorted(r.path[len(str(tree)) + 1 :] for r in df.collect())
    same = ["x/1.txt", "y/2.txt", "z/3.txt"]
    assert load_cache(spark, store).count() == 0
    first = e.scan([str(tree)])
    assert set(same) <= set(names(first)) and names(groups.members(first)) == same
    save_cache(first, store)
    save_cache(first, store)
    assert cache_size(spark, store) == first.count()
    assert names(groups.members(e.scan([str(tree)], cache=load_cache(spark, store)))) == same
    (tree / "w.txt").write_bytes(b"same" * 20)
    assert names(groups.members(e.scan([str(tree)], cache=load_cache(spark, store)))) == sorted([*same, "w.txt"])
    quick = names(groups.members(e.scan([str(tree)], quick=True, cache=load_cache(spark, store))))
    assert quick == sorted([*same, "w.txt", "p.bin", "q.bin"])
    kept = [r.path for r in e.plan(e.scan([str(tree)]), "first").where("action = 'keep'").collect()]
    assert kept == [str(tree / "w.txt")]
    assert {r.drive for r in first.select("drive").distinct().collect()} <= {"/", "/tmp", *(str(p) for p in tree.parents)}


def test_file_hash(tmp_path):
    import hashlib

    from winnow.engine import file_hash

    p = tmp_path / "f"
    p.write_bytes(bytes(range(100)))
    whole, ends = hashlib.sha256(bytes(range(100))).hexdigest(), hashlib.sha256(bytes(range(10)) + bytes(range(90, 100))).hexdigest()
    assert [file_hash(str(p), 100, c) for c in (None, 50, 10)] == [whole, whole, ends]
    assert file_hash(str(tmp_path / "none"), 1) is None


def test_cli(spark, tree, tmp_path, capsys, monkeypatch):
    import json

    from winnow import cli
    from winnow.engine import Engine

    e = Engine(spark)

    def run(*words, ask=lambda _: "no"):
        code = cli.run(e, cli.parser().parse_args([*words[:1], str(tree), *words[1:]]), ask)
        return code, capsys.readouterr().out

    code, out = run("scan", "--format", "table")
    assert code == 1 and "Total groups: 1 | Total wasted space: 160.00 B" in out and out.splitlines()[0].startswith("GROUP")
    code, out = run("scan")
    assert "--- [ Group 1 / 1 ] ---" in out and "  [3] [" in out
    body = json.loads(run("scan", "--format", "json")[1])
    assert (body["total_groups"], body["total_wasted_bytes"], len(body["groups"][0]["files"])) == (1, 160, 3)
    assert body["groups"][0]["files"][0]["duration"] is None and body["groups"][0]["drives"]
    assert run("scan", "--min-size", "1MB") == (0, "[+] No duplicates found.\n")
    empty = json.loads(run("scan", "--min-size", "1MB", "--format", "json")[1])
    assert empty["groups"] == [] and empty["total_groups"] == 0
    for name in ("r.json", "r.csv", "r.txt"):
        assert run("export", "-o", str(tmp_path / name))[0] == 0
    assert json.loads((tmp_path / "r.json").read_text())["total_groups"] == 1
    assert len((tmp_path / "r.csv").read_text().splitlines()) == 4 and "Group 1 / 1" in (tmp_path / "r.txt").read_text()
    assert cli.run(e, cli.parser().parse_args(["scan", str(tmp_path / "none")])) == 1
    # nothing goes without --apply and the typed word
    code, out = run("clean", "--strategy", "first")
    assert code == 0 and out.count("[DRY-RUN] Would delete") == 2
    assert run("clean", "--strategy", "first", "--apply", "--no-trash") [0] == 1
    monkeypatch.setattr("sys.stdin", open("/dev/null"))  # noqa: SIM115
    assert run("clean", "--strategy", "first", "--apply", "--no-trash", ask=input)[0] == 1
    assert all((tree / f).exists() for f in ("x/1.txt", "y/2.txt", "z/3.txt"))
    code, out = run("clean", "--strategy", "first", "--apply", "--no-trash", ask=lambda _: "DELETE")
    assert code == 0 and out.count("[DELETED]") == 2 and "Space freed: 160.00 B" in out
    assert [(tree / f).exists() for f in ("x/1.txt", "y/2.txt", "z/3.txt")] == [True, False, False]
    assert run("clean", "--strategy", "first") == (0, "[+] No duplicates found.\n")


def test_apply_plan_skips_changed(spark, tree):
    import os

    from winnow.engine import Engine, apply_plan

    e = Engine(spark)
    plan = e.plan(e.scan([str(tree)]), "first")
    with pytest.raises(PermissionError):
        apply_plan(plan, "yes")
    os.utime(tree / "y/2.txt", (1, 1))
    (tree / "z/3.txt").unlink()
    said = sorted(apply_plan(plan, "DELETE"))
    assert len(said) == 2 and said[0].endswith("2.txt: changed since scan") and said[1].endswith("3.txt: file no longer exists")
    assert (tree / "x/1.txt").exists() and (tree / "y/2.txt").exists()


def test_fuzzy(spark, tree, tmp_path, capsys):
    from winnow import cli
    from winnow.engine import Engine

    e = Engine(spark)
    tools = ["--probe", str(tmp_path / "probe"), "--grab", str(tmp_path / "grab")]
    run = lambda *w, ask=lambda _: "no": cli.run(e, cli.parser().parse_args([w[0], str(tree), *w[1:]]), ask)
    assert run("scan", "--fuzzy", "--video", *tools) == 1
    out = capsys.readouterr().out
    assert "Fuzzy Group 1 / 1" in out and "a.mp4" in out and "b.mkv" in out and "c.avi" not in out and "d.mp4" not in out
    assert run("scan", "--fuzzy", "--video", "--probe", "no-such-tool") == 0
    assert "[+] No fuzzy" in capsys.readouterr().out
    assert run("fuzzyclean", "--strategy", "spread", *tools) == 1
    assert run("fuzzyclean", "--strategy", "largest", *tools) == 0
    assert "Would delete" in capsys.readouterr().out
    assert run("fuzzyclean", "--strategy", "largest", "--apply", "--yes", *tools) == 1 and (tree / "a.mp4").exists()
    assert run("fuzzyclean", "--strategy", "largest", "--apply", "--no-trash", *tools, ask=lambda _: "YES") == 0
    assert not (tree / "a.mp4").exists() and (tree / "b.mkv").exists()


def test_media(spark, tree, tmp_path):
    import numpy as np

    from winnow.sources import media

    probe, grab = str(tmp_path / "probe"), str(tmp_path / "grab")
    assert [media.probe_duration(str(tree / n), probe) for n in ("a.mp4", "stream.mov", "bad.mp4")] == [60.0, 60.0, None]
    assert media.probe_duration("x", "no-such-tool") is None
    rows = spark.createDataFrame([(str(tree / n), v) for n, v in (("a.mp4", True), ("d.mp4", True), ("bad.mp4", True), ("lone", False))], "path string, is_video boolean")
    got = {r.path.rsplit("/", 1)[-1]: r for r in media.with_frames(media.with_duration(rows, probe), 8, grab).collect()}
    assert [got[n].duration for n in ("a.mp4", "d.mp4", "bad.mp4", "lone")] == [60.0, 0.9, None, None]
    assert len(got["a.mp4"].frames) == 8 and got["d.mp4"].frames is None and got["bad.mp4"].frames is None
    rng = np.random.default_rng(2)
    gray = rng.integers(0, 256, (32, 32)).astype(np.uint8)
    soft = np.clip(gray.astype(int) + rng.integers(-3, 4, (32, 32)), 0, 255).astype(np.uint8)
    bits = lambda a, b: bin((media.perceptual_hash(a) ^ media.perceptual_hash(b)) & (1 << 64) - 1).count("1")
    assert bits(gray, gray) == 0 and bits(gray, soft) <= 8 < 20 < bits(gray, rng.integers(0, 256, (32, 32)))


def test_shell(spark, tree, tmp_path, capsys):
    from winnow import cli
    from winnow.engine import Engine
    from winnow.shell import Shell

    answers = iter(["9", "2"])
    s = Shell(Engine(spark), cli.parser().parse_args([]), lambda _: next(answers))
    said = lambda line: (s.onecmd(line), capsys.readouterr().out)[1]
    assert "No scan results" in said("clean")
    assert "'*.csv'" not in said("exclude '*.csv'") and s.options.exclude == ["*.csv"]
    assert "*.csv" in said("exclude --list") and "none" in said("exclude --clear")
    assert "3" in said("workers 3") and "(disabled)" in said("cache") and "c1" in said(f"cache {tmp_path}/c1") and "(disabled)" in said("cache --off")
    assert "No closing quotation" in said('scan "open')
    out = said(f"scan '{tree}' {tmp_path}/none --format table")
    assert "Skipping invalid path" in out and "Total groups: 1" in out
    assert "total_groups=1" in said("totals")
    assert "Report saved" in said(f"export {tmp_path}/s.csv")
    out = said("clean --apply --no-trash --yes")
    assert out.count("[DELETED]") == 2 and (tree / "y/2.txt").exists() and not (tree / "x/1.txt").exists()
    assert s.onecmd("exit") is True


def test_ordinal_equals_sort(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaab"), rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "hash_key string, v int, k int")
    got = groups.ordinal(df.repartition(8), ["hash_key"], [F.desc("v"), F.asc("k")], "no").collect()
    for key in "ab":
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [(r.hash_key, r.v, r.k) for r in sorted((g for g in got if g.hash_key == key), key=lambda r: r.no)] == want
    whole = sorted(groups.ordinal(df, [], [F.asc("k")], "no").collect(), key=lambda r: r.no)
    assert [r.no for r in whole] == list(range(1, 3001)) and [r.k for r in whole] == list(range(3000))


def test_skipped_folders(spark):
    from winnow.plans.report import skipped_folders

    said = skipped_folders(spark.createDataFrame([(f"/d{k}", "no") for k in range(7)], "path string, error string"))
    assert said[0].startswith("[!] Skipped 7 unreadable directories") and len(said) == 7 and said[-1].strip() == "... and 2 more"
    assert skipped_folders(spark.createDataFrame([], "path string, error string")) == []
