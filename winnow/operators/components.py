"""Connected components of an edge table (transitive closure of matches).

Alternating large-star / small-star contraction.  Each round is two
aggregations with map-side combine and two equi-joins, so a hub that holds a
third of all edges is pre-aggregated before the shuffle and its join partition
can be split by adaptive execution.  The edge table of each round is written
to the shared checkpoint folder and the former one is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.storage import held, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed pairs (u, v); u is the centre."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (
            joined.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
        )
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every id points to one root and no root points anywhere."""
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.lit(None).alias("root")))
    per = ends.groupBy("id").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.count("root").alias("k"))
    return per.where("lo <> hi or (k > 0 and k < n)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every id that occurs in an edge between two
    different ids; component is the smallest id reachable.

    Edges with a null end and self-loops are ignored, repeated edges count
    once, an empty table gives an empty result.
    """
    start = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = materialise(start)
    while not _settled(now.df):
        nxt = materialise(_star(_star(now.df, True), False))
        now.drop()
        now = nxt
    e = held(now)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
