"""URL filters by hashed expressions.

A URL expands into (host suffix, path prefix) expressions; each is hashed, and
a short prefix of the digest is equi-joined with the prefixes of the rules'
digests.  Hits are confirmed on the full digest and the longest rule wins.
Only expressions that some rule could equal are made: label counts and path
lengths come from the rule table, so their number per URL is bounded by the
rules' shapes and not by the URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.textops import fresh

PREFIX_HEX = 8  # four bytes of the digest
BROADCAST_RULES = 100_000  # rules beyond this are joined by shuffle

#: The rules of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty for null or without '://'."""
    rest = F.expr(f"substr(`{url}`, length(substring_index(`{url}`, '://', 1)) + 4)")
    has = F.coalesce(F.contains(F.col(url), F.lit("://")), F.lit(False))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", F.when(has, low).otherwise("")).withColumn("path", F.when(has, after).otherwise(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    t = spark.createDataFrame([(h, p, v) for h, p, v in rules], "r_host string, r_path string, r_verdict string")
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    return t.select(
        F.concat("r_host", "r_path").alias("r_rule"),
        "r_verdict",
        digest.alias("r_digest"),
        F.substring(digest, 1, PREFIX_HEX).alias("short"),
        (F.length("r_host") + F.length("r_path")).alias("r_len"),
        F.length("r_host").alias("r_hlen"),
        F.size(F.split("r_host", r"\.")).alias("r_labels"),
        F.length("r_path").alias("r_plen"),
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    Without a fitting rule, rule is null and the verdict is `default`: a URL
    that no list names passes.  Of fitting rules the longest wins, between
    equally long ones the longer host.  Verdicts are worked out once per
    distinct (host, path), which a partial aggregation finds before the
    shuffle, however often a URL is repeated.  Columns of pages with the names
    of the new ones are replaced; null and scheme-less URLs fit no rule.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    parsed = with_host_path(pages, url)
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    distinct = parsed.select("host", "path").where("host <> ''").distinct()
    forms = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("plen")) for n, k in shapes]) if shapes else F.expr("cast(array() as array<struct<labels:int,plen:int>>)")
    expanded = (
        distinct.withColumn("form", F.explode(forms))
        .where("form.labels <= length(host) - length(replace(host, '.', '')) + 1 and form.plen <= length(path)")
        .withColumn("digest", F.sha2(F.concat_ws("\n", F.expr("substring_index(host, '.', -form.labels)"), F.expr("left(path, form.plen)")), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    best = F.max(F.struct("r_len", "r_hlen", "r_rule", "r_verdict")).alias("best")
    found = expanded.join(table, "short").where("digest = r_digest").groupBy("host", "path").agg(best)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    hit_verdict = fresh("hit_verdict", kept)
    hit = found.select("host", "path", F.col("best.r_rule").alias("rule"), F.col("best.r_verdict").alias(hit_verdict))
    shown = [F.col(f"`{c}`") for c in kept]
    parsed = parsed.select(*shown, "host", "path")
    return parsed.join(hit, ["host", "path"], "left").select(*shown, "host", "path", "rule", F.coalesce(hit_verdict, F.lit(default)).alias("verdict"))


ORACLE = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES {rules}),
parsed AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ranked AS (
  SELECT p.*, r_host, r_path, r_verdict,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(r_host) + length(r_path) DESC NULLS LAST) AS k
  FROM parsed p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM ranked WHERE k = 1
"""


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    return ORACLE.format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules))
