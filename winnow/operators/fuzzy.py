"""Near-duplicate media: duration bands, fingerprints, fuzzy groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.scalars import hamming_bits, similarity
from winnow.operators.components import connected_components
from winnow.storage import durable

#: Up to this many bits bands of a hash tell near hashes from others; beyond it nearly every pair meets in one.
WIDEST = 14


def _banded(v: DataFrame, pick: Column, bucket: Column, allowed: Column) -> DataFrame:
    i = v.where(pick).select(F.col("ord").alias("a"), F.col("duration").alias("da"), bucket.alias("b"))
    j = v.select(F.col("ord").alias("b_ord"), F.col("duration").alias("db"), F.explode(F.array(bucket, bucket - 1)).alias("b"))
    later = (F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b_ord") > F.col("a")))
    return i.join(j, "b").where(later & (F.col("db") - F.col("da") <= allowed)).select("a", F.col("b_ord").alias("b"))


def candidate_pairs(videos: DataFrame, tolerance: float, ratio: float = 0.0) -> DataFrame:
    """Pairs (a the shorter, b) whose durations differ by at most
    max(tolerance, ratio * shorter); equal durations are ordered by ord.

    The range join is an equi-join on buckets as wide as the gap: linear ones
    where the tolerance rules, logarithmic ones where the ratio does.
    """
    v = videos.where("duration is not null and duration > 0").select("ord", "duration")
    d = F.col("duration")
    by_ratio = d * ratio > tolerance if ratio else F.lit(False)
    linear = F.floor(d / tolerance) if tolerance else F.xxhash64(d)
    flat = _banded(v, ~by_ratio, linear, F.lit(float(tolerance)))
    if not ratio:
        return flat
    # a hair's width more per bucket, so that rounding of ln loses no boundary
    log = F.floor(F.log(d) / (math.log1p(ratio) * (1 + 1e-9)))
    return flat.union(_banded(v, by_ratio, log, F.col("da") * ratio))


def positional(a: Column, b: Column) -> Column:
    """Mean distance of the hashes at equal places, as far as both go."""
    k = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, 1, k), F.slice(b, 1, k), hamming_bits), F.lit(0), lambda s, x: s + x)
    return F.when(k > 0, total / k)


def aligned(a: Column, b: Column) -> Column:
    """struct(avg_dist, monotone, est_offset) of the best match of every frame
    of the shorter fingerprint; frames are struct(ts, h)."""
    swap = F.size(a) > F.size(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    best = F.transform(short, lambda s: F.array_min(F.transform(long, lambda x, i: F.struct(hamming_bits(s.h, x.h).alias("d"), i.alias("i"), (x.ts - s.ts).alias("o")))))
    n = F.size(short)
    mean = lambda f, zero: F.aggregate(best, zero, lambda acc, x: acc + f(x)) / n
    steps = F.zip_with(F.slice(best, 1, F.greatest(n - 1, F.lit(0))), F.slice(best, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: (y.i >= x.i).cast("int"))
    monotone = F.when(n > 1, F.aggregate(steps, F.lit(0), lambda acc, x: acc + x) / (n - 1)).otherwise(F.lit(1.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.struct(mean(lambda x: x.d, F.lit(0)).alias("avg_dist"), monotone.alias("monotone"), mean(lambda x: x.o, F.lit(0.0)).alias("est_offset")))


def _mean_best(a: Column, b: Column) -> Column:
    """avg_dist of aligned(a, b) alone; less than it where a hash is null."""
    best = lambda x, long: F.aggregate(long, F.lit(64), lambda d, y: F.least(d, hamming_bits(x.h, y.h)))
    mean = lambda short, long: F.aggregate(short, F.lit(0), lambda acc, x: acc + best(x, long)) / F.size(short)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.size(a) > F.size(b), mean(b, a)).otherwise(mean(a, b)))


def match_pairs(pairs: DataFrame, prints: DataFrame, mode: str = "aligned", threshold: float = 10, least_monotone: float = 0.7) -> DataFrame:
    """Matched pairs with avg_dist, similarity (and monotone, est_offset);
    prints: ord, frames array<struct<ts, h>>.  No fingerprint, no match."""
    a = prints.select(F.col("ord").alias("a"), F.col("frames").alias("fa"))
    b = prints.select(F.col("ord").alias("b"), F.col("frames").alias("fb"))
    both = pairs.join(a, "a").join(b, "b")
    if mode == "positional":
        out = both.withColumn("avg_dist", positional(F.col("fa.h"), F.col("fb.h"))).where(F.col("avg_dist") <= threshold)
        return out.select("a", "b", "avg_dist", similarity(F.col("avg_dist")).alias("similarity"))
    both = both.where(_mean_best(F.col("fa"), F.col("fb")) <= threshold)  # cheaper than the whole match, which few pairs need
    out = both.withColumn("m", aligned(F.col("fa"), F.col("fb"))).where((F.col("m.avg_dist") <= threshold) & (F.col("m.monotone") >= least_monotone))
    return out.select("a", "b", "m.avg_dist", "m.monotone", similarity(F.col("m.avg_dist")).alias("similarity"), "m.est_offset")


def _bands(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, reach) of bands of 64 bits: two hashes at most
    `radius` bits apart differ by at most `reach` <= 2 bits in one of them, as
    reach + 1 over all bands makes radius + 1."""
    n = -(-(radius + 1) // 3)
    at = [64 * k // n for k in range(n + 1)]
    return [(at[k], at[k + 1] - at[k], (radius + 1) // n + (k < (radius + 1) % n) - 1) for k in range(n)]


def _band(h: Column, j: int, first: int, bits: int) -> Column:
    """Band j of a hash, unlike any value of another band."""
    v = F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
    return v.bitwiseOR(F.lit(j << 32)) if j else v


def near_hashes(hashes: DataFrame, radius: int) -> DataFrame:
    """Pairs x < y of different 64-bit hashes (column h, distinct) at most
    `radius` <= WIDEST bits apart, every one once.

    Hashes are dealt by their bands: x goes to its own value and those one bit
    off, y too where a band may differ by 2 bits.  Of the places where a pair
    meets one counts: in the first band that is near enough y's value or, 2
    bits apart, x's with the lower bit of y.
    """
    bands = _bands(radius)
    spark = hashes.sparkSession
    hashes = hashes.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # small rows that become many
    bit = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)

    def keys(h: Column, own: int) -> Column:
        out = []
        for j, (first, bits, reach) in enumerate(bands):
            v = _band(h, j, first, bits)
            out += [v] + ([v.bitwiseXOR(F.lit(bit(k))) for k in range(bits)] if reach >= own else [])
        return F.explode(F.array(*out)).alias("k")

    x = hashes.select(F.col("h").alias("x"), keys(F.col("h"), 1))
    y = hashes.select(F.col("h").alias("y"), keys(F.col("h"), 2))
    here = F.lit(False)
    for j, (first, bits, reach) in reversed(list(enumerate(bands))):
        bx, by = _band(F.col("x"), j, first, bits), _band(F.col("y"), j, first, bits)
        diff = bx.bitwiseXOR(by)
        place = F.when(F.bit_count(diff) == 2, bx.bitwiseXOR(diff.bitwiseAND(-diff))).otherwise(by)
        here = F.when(F.bit_count(diff) <= reach, F.col("k") == place).otherwise(here)
    near = (F.col("x") < F.col("y")) & (hamming_bits(F.col("x"), F.col("y")) <= radius)
    return x.join(y, "k").where(near & here).select("x", "y")


def match_videos(videos: DataFrame, tolerance: float, ratio: float = 0.0, threshold: float = 10, least_monotone: float = 0.7) -> DataFrame:
    """match_pairs (aligned) over all candidate_pairs of videos (ord, duration,
    frames), without making them; ord is unique.

    A mean of at most `threshold` has a frame at most as far from one of the
    other video, so only fingerprints that share near hashes are compared,
    equal ones once; a threshold beyond WIDEST takes all pairs.
    """
    v = durable(videos.where("duration > 0 and size(frames) > 0").select("ord", "duration", "frames"))
    if not 0 <= threshold < WIDEST + 1:
        return match_pairs(candidate_pairs(v, tolerance, ratio), v, threshold=threshold, least_monotone=least_monotone)
    gap = lambda d: F.greatest(F.lit(float(tolerance)), d * float(ratio))
    prints = durable(v.groupBy("frames").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min("duration").alias("lo"), F.max("duration").alias("hi")))
    at = durable(prints.select(F.struct("ord", "n", "lo", "hi").alias("p"), F.explode(F.array_distinct("frames.h")).alias("x")).where("x is not null"))
    other = at.toDF("q", "y")
    near = at.join(near_hashes(at.select(F.col("x").alias("h")).distinct(), math.floor(threshold)), "x").join(other, "y")
    near = near.select(F.inline(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))))
    both = near.union(at.join(other, F.col("x") == F.col("y")).select("p", "q"))
    timely = (F.col("p.lo") <= F.col("q.hi")) & (F.col("q.lo") - F.col("p.hi") <= gap(F.col("p.hi")))
    pairs = both.where(timely & ((F.col("p.ord") != F.col("q.ord")) | (F.col("p.n") > 1))).select(F.col("p.ord").alias("a"), F.col("q.ord").alias("b")).distinct()
    same = match_pairs(pairs, prints, threshold=threshold, least_monotone=least_monotone)
    members = v.join(prints.select("frames", F.col("ord").alias("print")), "frames").select("print", F.struct("duration", "ord").alias("v"))
    found = same.join(members.toDF("a", "va"), "a").join(members.toDF("b", "vb"), "b")
    found = found.where((F.col("va") < F.col("vb")) & (F.col("vb.duration") - F.col("va.duration") <= gap(F.col("va.duration"))))
    return found.select(F.col("va.ord").alias("a"), F.col("vb.ord").alias("b"), "avg_dist", "monotone", "similarity", "est_offset")


def fuzzy_members(matches: DataFrame) -> DataFrame:
    return connected_components(matches, "a", "b").select(F.col("id").alias("ord"), "component")


def fuzzy_groups(matches: DataFrame, videos: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per component: n, mean similarity of its matched pairs, sizes,
    waste (all but the largest), duration spread, drives."""
    sims = matches.join(parts.select(F.col("ord").alias("a"), "component"), "a").groupBy("component").agg(F.avg("similarity").alias("similarity"))
    d = F.when(F.col("duration") > 0, F.col("duration"))
    g = parts.join(videos, "ord").groupBy("component").agg(
        F.count("*").alias("n"), F.sum("size").alias("total_size"), (F.sum("size") - F.max("size")).alias("wasted_size"),
        F.coalesce(F.max(d) - F.min(d), F.lit(0.0)).alias("duration_spread"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("drive") != "", F.col("drive")))), ", ").alias("drives"),
    )
    return g.join(sims, "component", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def fuzzy_plan(videos: DataFrame, parts: DataFrame, strategy: str) -> DataFrame:
    from winnow.operators.groups import pick_keepers

    if strategy == "spread":
        raise ValueError("spread does not apply to fuzzy groups")
    return pick_keepers(parts.join(videos, "ord"), strategy, ["component"])
