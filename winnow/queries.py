"""Registered queries over the driver's tables, with their SQL.

`files` and `frames` are derived views, defined alike in Spark and DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import scalars as S
from winnow.operators import filters, fuzzy, groups, hashing
from winnow.plans import report
from winnow.storage import durable, shared_dir

CHUNK = 256
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = """
SELECT doc_id AS ord,
  '/' || source || '/' || lang || '/doc_' || CAST(doc_id AS {S}) ||
    CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.txt' WHEN 2 THEN '.MKV' ELSE '.bin' END AS path,
  CAST({LEN}(text) AS BIGINT) AS size, CAST(1704067200 + (doc_id % 5) * 3600 AS DOUBLE) AS mtime, source AS drive,
  doc_id % 4 IN (0, 2) AS is_video,
  CASE WHEN doc_id % 4 IN (0, 2) AND doc_id % 5 <> 0 THEN CAST(n_chars AS DOUBLE) / 10 END AS duration,
  CASE WHEN doc_id % 11 <> 0 THEN doc_id % 3 END AS dev,
  CASE WHEN doc_id % 11 <> 0 THEN {INO} END AS ino, text
FROM documents"""


def files(spark: SparkSession, sf: str, inode: bool = False) -> DataFrame:
    """The files view; ino needs an aggregation over equal texts, joined back."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sql = FILES[: FILES.index("FROM documents")].format(S="STRING", LEN="octet_length", INO="first_id" if inode else "doc_id")
    if inode:
        key = [F.sha2("text", 256).alias("tk"), (F.col("doc_id") % 3).alias("dk")]
        first = docs.groupBy(*key).agg(F.min("doc_id").alias("first_id"))
        docs = docs.withColumns({"tk": key[0], "dk": key[1]}).join(first, ["tk", "dk"])
    return spark.sql(sql + "FROM {docs}", docs=docs)


CTE = "WITH files AS (" + FILES.format(S="VARCHAR", LEN="strlen", INO="min(doc_id) OVER (PARTITION BY text, doc_id % 3)") + """),
hashed AS (SELECT *, sha256(text) AS h FROM files),
mem AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS gn FROM hashed) WHERE gn > 1),
grp AS (SELECT h AS hash_key, count(*) AS n, min(size) AS size, min(size) * count(*) AS total_size,
  min(size) * greatest(count(DISTINCT CASE WHEN dev IS NOT NULL THEN dev || ':' || ino END) + count(*) FILTER (dev IS NULL) - 1, 0) AS wasted_size,
  min(size) * (count(*) - 1) AS wasted_plain, string_agg(DISTINCT drive, ', ' ORDER BY drive) AS drives,
  count(DISTINCT CASE WHEN dev IS NOT NULL THEN dev || ':' || ino END) < count(dev) AS has_hardlinks FROM mem GROUP BY h),
num AS (SELECT *, row_number() OVER (ORDER BY wasted_size DESC, hash_key, size) AS group_no FROM grp)
"""
FRAMES = """
frames0 AS (SELECT vec_id // 5 AS v, vec_id % 5 AS f, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << (i - 1)::INT ELSE 0 END)) AS UBIGINT) AS h FROM embeddings),
frames AS (
  SELECT v * 10 AS vid, 60.0::DOUBLE + 10 * (v % 13) AS dur, 1000000 + v * 1000 AS size, f, h FROM frames0
  UNION ALL SELECT v * 10 + 1, 61.5::DOUBLE + 10 * (v % 13), 600000 + v * 1000, f, xor(h, (CAST(1 AS UBIGINT) << f)) FROM frames0 WHERE v % 3 = 0
  UNION ALL SELECT v * 10 + 2, (60.0::DOUBLE + 10 * (v % 13)) * 0.7, 700000 + v * 1000, f - 2, h FROM frames0 WHERE v % 4 = 0 AND f >= 2),
videos AS (SELECT vid AS ord, min(dur) AS duration, min(size) AS size, 'd' || (vid % 3) AS drive FROM frames GROUP BY vid),
flat AS (SELECT x.ord AS a, y.ord AS b FROM videos x JOIN videos y ON (y.duration > x.duration OR (y.duration = x.duration AND y.ord > x.ord)) AND y.duration - x.duration <= 2),
wide AS (SELECT x.ord AS a, y.ord AS b FROM videos x JOIN videos y ON (y.duration > x.duration OR (y.duration = x.duration AND y.ord > x.ord)) AND y.duration - x.duration <= greatest(5.0, 0.5 * x.duration)),
lens AS (SELECT vid, count(*) AS n FROM frames GROUP BY vid),
ends AS (SELECT a, b, CASE WHEN p.n > q.n THEN b ELSE a END AS s, CASE WHEN p.n > q.n THEN a ELSE b END AS l FROM wide JOIN lens p ON p.vid = a JOIN lens q ON q.vid = b),
best AS (SELECT * FROM (SELECT a, b, x.f AS sf, y.f AS lf, bit_count(xor(x.h, y.h)) AS d, row_number() OVER (PARTITION BY a, b, x.f ORDER BY bit_count(xor(x.h, y.h)), y.f) AS k
  FROM ends JOIN frames x ON x.vid = s JOIN frames y ON y.vid = l) WHERE k = 1),
steps AS (SELECT *, lag(lf) OVER (PARTITION BY a, b ORDER BY sf) AS prev FROM best),
scored AS (SELECT a, b, avg(d) AS avg_dist, coalesce(avg(CASE WHEN prev IS NOT NULL THEN CASE WHEN lf >= prev THEN 1.0 ELSE 0.0 END END), 1.0) AS monotone, avg(CAST(lf - sf AS DOUBLE)) AS est_offset FROM steps GROUP BY a, b),
edges AS (SELECT *, greatest(0, 100 * (1 - avg_dist / 64)) AS sim FROM scored WHERE avg_dist <= 10 AND monotone >= 0.7),
two AS (SELECT a AS s, b AS d FROM edges UNION SELECT b, a FROM edges),
reach(s, d) AS (SELECT s, s FROM two UNION SELECT r.s, t.d FROM reach r JOIN two t ON t.s = r.d),
comp AS (SELECT s AS ord, min(d) AS component FROM reach GROUP BY s)
"""
V = "WITH RECURSIVE " + FRAMES


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    base = e.select(F.expr("vec_id div 5").alias("v"), (F.col("vec_id") % 5).alias("f"), bits.alias("h"))
    dur = F.lit(60.0) + F.lit(10) * (F.col("v") % 13)
    one = base.select((F.col("v") * 10).alias("vid"), dur.alias("dur"), (F.col("v") * 1000 + 1000000).alias("size"), "f", "h")
    flip = F.col("h").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("f").cast("int")))
    two = base.where("v % 3 = 0").select(F.col("v") * 10 + 1, dur + 1.5, F.col("v") * 1000 + 600000, "f", flip)
    three = base.where("v % 4 = 0 and f >= 2").select(F.col("v") * 10 + 2, dur * 0.7, F.col("v") * 1000 + 700000, F.col("f") - 2, "h")
    return one.union(two).union(three)


def videos(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    fr = F.array_sort(F.collect_list(F.struct("f", F.struct(F.col("f").cast("double").alias("ts"), "h").alias("x"))))
    return f.groupBy("vid").agg(F.min("dur").alias("duration"), F.min("size").alias("size"), F.transform(fr, lambda s: s.x).alias("frames")).select(
        F.col("vid").alias("ord"), "duration", "size", F.concat(F.lit("d"), (F.col("vid") % 3).cast("string")).alias("drive"), F.lit(0.0).alias("mtime"), "frames"
    )


def _hashed(spark: SparkSession, sf: str, inode: bool = False) -> DataFrame:
    return files(spark, sf, inode).withColumn("sha256", F.sha2("text", 256)).drop("text")


def q(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


q("exact_groups", CTE + "SELECT hash_key, n FROM grp")(lambda s, d: groups.group_metrics(_hashed(s, d)).select("hash_key", "n"))
q("group_metrics", CTE + "SELECT row_number() OVER (ORDER BY wasted_plain DESC, hash_key) AS group_no, hash_key, n, size, total_size, wasted_plain AS wasted_size, drives FROM grp")(
    lambda s, d: groups.numbered(groups.group_metrics(_hashed(s, d), hardlinks=False)).drop("has_hardlinks"))
q("hardlink_metrics", CTE + "SELECT hash_key, n, wasted_size, has_hardlinks FROM grp")(lambda s, d: groups.group_metrics(_hashed(s, d, True)).select("hash_key", "n", "wasted_size", "has_hardlinks"))
q("report_totals", CTE + "SELECT count(*) AS total_groups, CAST(sum(wasted_size) AS BIGINT) AS total_wasted FROM grp")(lambda s, d: groups.totals(groups.group_metrics(_hashed(s, d, True))))
q("size_histogram", CTE + "SELECT size, count(*) AS n FROM files GROUP BY size")(lambda s, d: hashing.size_histogram(files(s, d)))
q("size_collisions", CTE + "SELECT ord, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)")(lambda s, d: hashing.colliding(files(s, d).select("ord", "size"), ["size"]))
PART = "sha256(CASE WHEN size > 512 THEN array_slice(encode(text), 1, 256) || array_slice(encode(text), -256, -1) ELSE encode(text) END)"
PCTE = CTE + f", part AS (SELECT *, {PART} AS p FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1))"
q("quick_groups", PCTE + "SELECT p AS hash_key, size, count(*) AS n FROM part GROUP BY p, size HAVING count(*) > 1")(
    lambda s, d: groups.group_metrics(hashing.staged_hash(files(s, d), "text", CHUNK, quick=True)).select("hash_key", "size", "n"))


@q("quick_false_positives", CTE + f"SELECT p AS hash_key, count(*) AS n FROM (SELECT {PART} AS p, h FROM hashed) GROUP BY p HAVING count(DISTINCT h) > 1")
def _false(s, d):
    f = files(s, d).select(S.partial_sha(F.col("text"), CHUNK).alias("hash_key"), F.sha2("text", 256).alias("h"))
    return f.groupBy("hash_key").agg(F.count("*").alias("n"), F.count_distinct("h").alias("k")).where("k > 1").drop("k")


q("staged_full_hash", PCTE + "SELECT ord, size, p AS partial_hash, CASE WHEN count(*) OVER (PARTITION BY size, p) > 1 THEN sha256(text) END AS sha256 FROM part")(
    lambda s, d: hashing.staged_hash(files(s, d).select("ord", "size", "text"), "text", CHUNK).select("ord", "size", "partial_hash", "sha256"))
q("filter_video", CTE + "SELECT ord, path FROM files WHERE regexp_matches(path, '(?i)\\.(mp4|mkv|avi|mov|wmv|flv|webm|m4v|mpg|mpeg|3gp|ts|ogv)$')")(lambda s, d: filters.video_only(files(s, d).select("ord", "path")))
q("filter_size_range", CTE + "SELECT ord, size FROM files WHERE size >= 500 AND size <= 2000")(lambda s, d: filters.size_range(files(s, d).select("ord", "size"), 500, 2000))
q("filter_empty", CTE + "SELECT ord, size FROM files WHERE size > 0")(lambda s, d: filters.without_empty(files(s, d).select("ord", "size")))
q("filter_exclude_glob", CTE + "SELECT ord, path FROM files WHERE NOT regexp_matches(path, '[^/]*7\\.(txt|bin)$') AND NOT regexp_matches(path, '^/src1/de/')")(lambda s, d: filters.exclude(files(s, d).select("ord", "path"), ["*7.txt", "*7.bin", "src1/de/*"]))
q("filter_prune_dirs", CTE + "SELECT ord, path FROM files WHERE NOT regexp_matches(path, '^/(src1|[^/]+/fr)/')")(lambda s, d: filters.exclude(files(s, d).select("ord", "path"), ["src1", "fr"], prune=True))

ORDERS = {"newest": "mtime DESC, ord", "oldest": "mtime, ord", "largest": "size DESC, ord", "smallest": "size, ord", "shortest": "duration ASC NULLS LAST, ord", "longest": "duration DESC NULLS LAST, ord", "first": "ord"}
for _name, _order in ORDERS.items():
    q(f"keep_{_name}", CTE + f"SELECT h AS hash_key, ord, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY {_order}) = 1 THEN 'keep' ELSE 'delete' END AS action FROM mem")(
        lambda s, d, n=_name: groups.pick_keepers(groups.members(_hashed(s, d)), n).select("hash_key", "ord", "action"))
q("keep_spread", CTE + "SELECT h AS hash_key, ord, CASE WHEN row_number() OVER (PARTITION BY h, drive ORDER BY ord) = 1 THEN 'keep' ELSE 'delete' END AS action FROM mem")(
    lambda s, d: groups.pick_keepers(groups.members(_hashed(s, d)), "spread").select("hash_key", "ord", "action"))
q("keep_manual", CTE + "SELECT h AS hash_key, ord, 'review' AS action FROM mem")(lambda s, d: groups.pick_keepers(groups.members(_hashed(s, d)), "manual").select("hash_key", "ord", "action"))


@q("keep_choices", CTE + """SELECT h AS hash_key, ord, CASE WHEN ord_min % 3 = 0 THEN 'skip' WHEN k = 2 THEN 'keep' ELSE 'delete' END AS action
FROM (SELECT *, min(ord) OVER (PARTITION BY h) AS ord_min, row_number() OVER (PARTITION BY h ORDER BY ord) AS k FROM mem)""")
def _choices(s, d):
    m = groups.members(_hashed(s, d))
    choices = m.groupBy("hash_key").agg(F.min("ord").alias("o")).where("o % 3 <> 0").select("hash_key", F.lit(2).cast("bigint").alias("pick"))
    return groups.pick_by_choice(m, choices).select("hash_key", "ord", "action")


PLAN = CTE + ", plan AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY mtime DESC, ord) = 1 THEN 'keep' ELSE 'delete' END AS action FROM mem) "
plan = lambda s, d: groups.pick_keepers(groups.members(_hashed(s, d, True)), "newest")
q("clean_plan_dry_run", PLAN + "SELECT h AS hash_key, path, '[DRY-RUN] Would delete: [' || drive || '] ' || path AS message FROM plan WHERE action = 'delete'")(lambda s, d: report.dry_run(plan(s, d)))
q("bytes_saved", PLAN + "SELECT count(*) AS deletions, CAST(sum(size) AS BIGINT) AS bytes_saved FROM plan WHERE action = 'delete'")(lambda s, d: groups.bytes_saved(plan(s, d)))
q("bytes_freed", PLAN + """SELECT CAST(sum(size) AS BIGINT) AS bytes_freed FROM (SELECT size FROM plan WHERE action = 'delete' AND dev IS NULL UNION ALL
SELECT min(size) FROM plan p WHERE action = 'delete' AND dev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plan k WHERE k.action = 'keep' AND k.h = p.h AND k.dev = p.dev AND k.ino = p.ino) GROUP BY h, dev, ino)""")(lambda s, d: groups.bytes_freed(plan(s, d)))


@q("stale_check", CTE + "SELECT ord, path, CASE WHEN ord % 7 = 0 THEN 'missing' WHEN ord % 7 IN (1, 2) THEN 'changed' ELSE 'ok' END AS status FROM files")
def _stale(s, d):
    f = files(s, d).select("ord", "path", "size", "mtime")
    now = f.where("ord % 7 <> 0").select("path", F.expr("CASE WHEN ord % 7 = 1 THEN size + 1 ELSE size END").alias("size"), F.expr("CASE WHEN ord % 7 = 2 THEN mtime + 0.5 ELSE mtime END").alias("mtime"))
    return hashing.stale_check(f, now).select("ord", "path", "status")


def _cache(s, d):
    return _hashed(s, d).where("ord % 3 = 0").select("path", "size", F.expr("CASE WHEN ord % 2 = 0 THEN mtime ELSE mtime + 1 END").alias("mtime"), "sha256", "duration", F.expr("ord % 5 <> 0").alias("verified"))


HIT = "ord % 3 = 0 AND ord % 2 = 0 AND ord % 5 <> 0"
q("cache_lookup", CTE + f"SELECT ord, CASE WHEN {HIT} THEN h END AS cached_sha FROM hashed")(lambda s, d: hashing.cache_lookup(files(s, d).select("ord", "path", "size", "mtime"), _cache(s, d)).select("ord", "cached_sha"))
q("cache_scan_counters", CTE + f"""SELECT count(*) FILTER ({HIT}) AS cache_hits, count(*) FILTER (NOT ({HIT}) AND k = 1) AS skipped_unique, count(*) FILTER (NOT ({HIT}) AND k > 1) AS hashed,
(SELECT count(*) FROM files WHERE size = 0) AS skipped_empty FROM (SELECT *, count(*) OVER (PARTITION BY size) AS k FROM files WHERE size > 0)""")(lambda s, d: hashing.scan_counters(files(s, d).drop("text"), _cache(s, d)))
q("exact_anti", CTE + "SELECT ord, path FROM hashed WHERE is_video AND ord NOT IN (SELECT ord FROM mem)")(
    lambda s, d: (lambda f: f.where("is_video").join(groups.members(f).select("path").distinct(), "path", "left_anti").select("ord", "path"))(_hashed(s, d)))
q("candidate_pairs_flat", V + "SELECT a, b FROM flat")(lambda s, d: fuzzy.candidate_pairs(videos(s, d), 2))
q("candidate_pairs_ratio", V + "SELECT a, b FROM wide")(lambda s, d: fuzzy.candidate_pairs(videos(s, d), 5, 0.5))
q("needed_videos", V + "SELECT a AS ord FROM flat UNION SELECT b FROM flat")(lambda s, d: (lambda p: p.select(F.col("a").alias("ord")).union(p.select("b")).distinct())(fuzzy.candidate_pairs(videos(s, d), 2)))


@q("frame_hamming", V + "SELECT x.vid AS a, y.vid AS b, x.f, CAST(bit_count(xor(x.h, y.h)) AS INT) AS dist FROM frames x JOIN frames y ON y.vid = x.vid + 1 AND x.f = y.f")
def _frame_hamming(s, d):
    f = frames(s, d).select("vid", "f", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("h"))
    y = f.select(F.col("vid").alias("b"), F.col("f").alias("yf"), F.col("h").alias("yh"))
    return f.join(y, (F.col("vid") + 1 == F.col("b")) & (F.col("f") == F.col("yf"))).select(F.col("vid").alias("a"), "b", "f", S.hamming(F.col("h"), F.col("yh")).alias("dist"))


q("frame_count", CTE + "SELECT ord, CASE WHEN duration <= 0 THEN 8 ELSE greatest(8, least(CAST(floor(duration / 15) AS BIGINT) + 1, 30)) END AS frames FROM files WHERE duration IS NOT NULL")(
    lambda s, d: files(s, d).where("duration is not null").select("ord", S.frame_count(F.col("duration")).alias("frames")))
q("sample_times", CTE + """SELECT ord, i, round(least(duration * 0.03, 2.0) + greatest(duration - 2 * least(duration * 0.03, 2.0), 0.1) * i / 7, 6) AS t
FROM files, range(8) r(i) WHERE duration IS NOT NULL""")(
    lambda s, d: files(s, d).where("duration is not null").select("ord", F.posexplode(S.sample_times(F.col("duration"), F.lit(8).cast("bigint"))).alias("i", "t")).select("ord", F.col("i").cast("bigint").alias("i"), F.round("t", 6).alias("t")))
q("fp_positional", V + "SELECT a, b, round(avg(bit_count(xor(x.h, y.h))), 6) AS avg_dist, round(greatest(0, 100 * (1 - avg(bit_count(xor(x.h, y.h))) / 64)), 6) AS similarity FROM flat JOIN frames x ON x.vid = a JOIN frames y ON y.vid = b AND x.f = y.f GROUP BY a, b HAVING avg(bit_count(xor(x.h, y.h))) <= 10")(
    lambda s, d: (lambda v: fuzzy.match_pairs(fuzzy.candidate_pairs(v, 2), v, "positional").select("a", "b", F.round("avg_dist", 6).alias("avg_dist"), F.round("similarity", 6).alias("similarity")))(videos(s, d)))


def _matches(s, d):
    return fuzzy.match_videos(videos(s, d), 5, 0.5)


q("fp_aligned", V + "SELECT a, b, round(avg_dist, 6) AS avg_dist, round(monotone, 6) AS monotone, round(sim, 6) AS similarity, round(est_offset, 6) AS est_offset FROM edges")(
    lambda s, d: _matches(s, d).select("a", "b", *[F.round(c, 6).alias(c) for c in ("avg_dist", "monotone", "similarity", "est_offset")]))
q("fuzzy_components", V + "SELECT ord, component FROM comp")(lambda s, d: fuzzy.fuzzy_members(_matches(s, d)))


@q("fuzzy_groups", V + """SELECT c.component, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(size) - max(size) AS BIGINT) AS wasted_size, round(max(duration) - min(duration), 6) AS duration_spread,
string_agg(DISTINCT drive, ', ' ORDER BY drive) AS drives, round(min(s.similarity), 6) AS similarity FROM comp c JOIN videos USING (ord) JOIN (SELECT component, avg(sim) AS similarity FROM edges JOIN comp ON ord = a GROUP BY component) s ON s.component = c.component GROUP BY c.component""")
def _groups(s, d):
    m = durable(_matches(s, d))
    g = fuzzy.fuzzy_groups(m, videos(s, d), fuzzy.fuzzy_members(m))
    return g.withColumns({c: F.round(c, 6) for c in ("duration_spread", "similarity")})


q("fuzzy_clean_plan", V + "SELECT component, ord, CASE WHEN row_number() OVER (PARTITION BY component ORDER BY size DESC, ord) = 1 THEN 'keep' ELSE 'delete' END AS action FROM comp JOIN videos USING (ord)")(
    lambda s, d: fuzzy.fuzzy_plan(videos(s, d), fuzzy.fuzzy_members(_matches(s, d)), "largest").select("component", "ord", "action"))
SIZE_SQL = "CASE WHEN {n} <= 0 THEN '0 B' WHEN {n} < 1024 THEN format('{{:.2f}} B', {n} / 1.0) WHEN {n} < 1048576 THEN format('{{:.2f}} KB', {n} / 1024.0::DOUBLE) ELSE format('{{:.2f}} MB', {n} / 1048576.0::DOUBLE) END"
DUR_SQL = "CASE WHEN {s} IS NULL OR {s} < 0 THEN 'N/A' WHEN floor({s}) >= 3600 THEN printf('%02d:%02d:%02d', CAST(floor({s}) AS BIGINT) // 3600, CAST(floor({s}) AS BIGINT) % 3600 // 60, CAST(floor({s}) AS BIGINT) % 60) ELSE printf('%02d:%02d', CAST(floor({s}) AS BIGINT) // 60, CAST(floor({s}) AS BIGINT) % 60) END"
q("fmt_size", CTE + "SELECT ord, " + SIZE_SQL.format(n="(size * 8)") + " AS text FROM files")(lambda s, d: files(s, d).select("ord", S.format_size(F.col("size") * 8).alias("text")))
q("fmt_duration", CTE + "SELECT ord, " + DUR_SQL.format(s="(duration * 10)") + " AS text FROM files")(lambda s, d: files(s, d).select("ord", S.format_duration(F.col("duration") * 10).alias("text")))
q("parse_size", CTE + "SELECT ord, CASE ord % 3 WHEN 0 THEN size WHEN 1 THEN size * 1024 ELSE size * 1048576 END AS bytes FROM files")(
    lambda s, d: files(s, d).select("ord", S.parse_size_column(F.expr("CASE ord % 3 WHEN 0 THEN concat(size, '') WHEN 1 THEN concat(' ', size, ' kb') ELSE concat(size, '.0MB') END")).alias("bytes")))
INODE = "CASE WHEN dev IS NOT NULL THEN dev || ':' || ino END"
q("csv_rows", CTE + f'SELECT group_no AS "group", h AS hash, drive, path, mem.size, mtime, duration, is_video, {INODE} AS inode, has_hardlinks AS group_has_hardlinks FROM mem JOIN num ON h = hash_key')(lambda s, d: report.csv_rows(_hashed(s, d, True)))
q("table_rows", CTE + "SELECT group_no, n, substr(drives, 1, 18) AS drives, " + SIZE_SQL.format(n="size") + " AS size_each, " + SIZE_SQL.format(n="wasted_size") + " AS wasted, substr((SELECT arg_min(path, ord) FROM mem WHERE h = hash_key), 1, 35) AS sample, CASE WHEN has_hardlinks THEN '*' ELSE '' END AS mark FROM num")(lambda s, d: report.table_rows(_hashed(s, d, True)))
q("detailed_rows", CTE + 'SELECT group_no AS "group", substr(h, 1, 16) AS hash16, path, ' + SIZE_SQL.format(n="mem.size") + " AS size_text, strftime(make_timestamp(CAST(mtime * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') AS modified, CASE WHEN duration > 0 THEN " + DUR_SQL.format(s="duration") + " ELSE '' END AS duration_text FROM mem JOIN num ON h = hash_key")(lambda s, d: report.detailed_rows(_hashed(s, d, True)))


@q("json_report", CTE + f"SELECT group_no, row_number() OVER (PARTITION BY h ORDER BY ord) AS pos, path, mem.size, mtime, drive, h AS sha256, duration, is_video, {INODE} AS inode FROM mem JOIN num ON h = hash_key")
def _json(s, d):
    """The file lines of the JSON report, read back."""
    fields = "path string, size bigint, mtime double, drive string, sha256 string, duration double, is_video boolean, inode string"
    lines = report.json_lines(_hashed(s, d, True), "").where(F.col("line").startswith('{"path"'))
    return lines.select("group_no", "pos", F.from_json(F.rtrim("line", F.lit(",")), fields).alias("f")).select("group_no", "pos", "f.*")


@q("walk_source", "SELECT * FROM (VALUES ('a.txt', CAST(1 AS BIGINT)), ('.hidden', 1), ('empty', 0), ('sub/_u.bin', 1)) t(path, size)")
def _walk(s, d):
    from winnow.sources.walk import scan

    top = Path(shared_dir(s).removeprefix("file://")) / f"walk-{uuid.uuid4().hex}"  # executors see it too
    top.mkdir(parents=True)
    for name, body in (("a.txt", "x"), (".hidden", "y"), ("empty", ""), ("sub/_u.bin", "z"), ("skip/gone.txt", "w")):
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(body)
    found, _ = scan(s, [str(top), str(top / "sub")], ["skip"])
    return found.select(F.substring("path", len(str(top)) + 2, 1000).alias("path"), "size")
