"""Near-duplicate documents by DartMinHash over word shingles.

A text is a weighted set: its word shingles and how often each occurs.  Darts
are thrown at the plane element x (0, weight] x time as a Poisson process that
depends on nothing but the element and the region (0, 1], (1, 2], (2, 4], ...
of its weight; each dart has a hashed coordinate.  A text keeps the darts in its own region up to a time that
makes about K ln K of them, and of those the earliest per coordinate: two texts
agree in a coordinate with the probability of their weighted Jaccard
similarity.  Texts that agree in a band of coordinates are compared exactly.

Texts with the same words are one class from the start (an aggregation with
map-side combine).  In a bucket, no list of all pairs is made: its smallest
member is compared with all others, which settles most buckets.  Those whose
members are still in different components are cut into blocks; a task gets
pairs of blocks and finds, from one byte a coordinate, the members that have a
likely partner in another component.  Only those meet again with signatures
and shingles, and the pairs that may link two components are verified.  The components are those of all verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.textops import U, content_key, mix, shingles
from winnow.operators.components import connected_components
from winnow.storage import durable, lasting, scratch, spread

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 32, 7  # a pair at 0.8 shares a band with a probability of 0.9995
K = BANDS * ROWS
BLOCK = 1000  # documents of a bucket in one block
BLOCK_SHINGLES = 2_000_000  # and their different shingles
SALTS = 64  # parts of a bucket, or the number of shuffle partitions if that is larger
TASK_ROWS = 4000  # rows of several cells that one call gets
TASK_SHINGLES = 4_000_000  # and their different shingles
LOT = 64  # texts signed at once
SLICE = 1 << 17  # regions that get darts at once
DARTS = K * (np.log(K) + 3)  # expected number thrown; where a coordinate stays empty, twice as many are


def weighted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text and their counts."""
    return np.unique(shingles(np.frombuffer(raw, np.uint8), WORDS), return_counts=True)


def _cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The regions of a weighted set: seed, lower end and width of each, and
    the element's weight.  Widths double, so an element has 1 + log2(weight)."""
    levels = np.where(weights > 1, np.ceil(np.log2(weights)).astype(np.int64) + 1, 1)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    seeds = mix(np.repeat(elements, levels) + level.astype(U) * U(0xC2B2AE3D27D4EB4F))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    return seeds, low, np.maximum(low, 1), np.repeat(weights, levels)


def _fraction(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def _throw(cells: list[tuple[np.ndarray, ...]], until: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set and coordinate the earliest dart before the set's time, and
    its hash; the time is infinite where there is none."""
    owner = np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells])
    whole = [np.concatenate([c[j] for c in cells]) for j in range(4)]
    best, dart = np.full(len(cells) * k, np.inf), np.zeros(len(cells) * k, U)
    for start in range(0, len(owner), SLICE):
        here = slice(start, start + SLICE)
        seeds, low, wide, weight, of = *(x[here] for x in whole), owner[here]
        now, end, step = np.zeros(len(seeds)), until[of], 1
        while len(seeds):  # a region's next dart comes after an exponential time
            block = int(np.clip(SLICE // 16 // len(seeds), 3, 256))
            u = mix(seeds[:, None] + np.arange(step, step + block, dtype=U) * U(0x9E3779B97F4A7C15))
            time = now[:, None] + np.cumsum(-np.log(_fraction(u)), axis=1) / wide[:, None]
            hit = time < end[:, None]
            row = np.nonzero(hit)[0]
            t, d = time[hit], mix(u[hit] ^ U(0x5851F42D4C957F2D))
            if low.any():  # the set has the part of the widest region up to its weight
                own = low[row] + _fraction(mix(d ^ U(0xD6E8FEB86659FD93))) * wide[row] < weight[row]
                row, t, d = row[own], t[own], d[own]
            key = of[row] * k + (d % U(k)).astype(np.int64)
            np.minimum.at(best, key, t)
            first = t == best[key]
            dart[key[first]] = d[first]
            on = hit[:, -1]
            seeds, low, wide, weight, of, now, end = seeds[on], low[on], wide[on], weight[on], of[on], time[on, -1], end[on]
            step += block
    return best.reshape(-1, k), dart.reshape(-1, k)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """The earliest dart per coordinate (32 bits of its hash) of each of some
    weighted sets, none of them empty."""
    cells = [_cells(*x) for x in sets]
    until = np.array([DARTS / w.sum() for _, w in sets])
    out, left = np.zeros((len(sets), k), np.uint32), np.arange(len(sets))
    while len(left):
        best, dart = _throw([cells[i] for i in left], until[left], k)
        full = np.isfinite(best).all(1)
        out[left[full]] = dart[full] >> U(32)
        left = left[~full]
        until[left] *= 2
    return out.view(np.int32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum()) + int(b[1].sum()) - both, 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sets = [], []
        sigs: list = [None] * b.num_rows
        held: list[int] = []

        def flush() -> None:
            if held:
                for i, sig in zip(held, signatures([sets[i] for i in held]), strict=True):  # noqa: B023
                    sigs[i] = sig  # noqa: B023
            held.clear()  # noqa: B023

        cells = 0
        for i, t in enumerate(b.column(1)):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            keys.append(content_key(raw))
            sets.append(weighted(raw))
            if len(sets[i][0]):
                held.append(i)
                cells += len(sets[i][0])
            if len(held) >= LOT or cells > SLICE:
                flush()
                cells = 0
        flush()
        sketch = [None if x is None else x.astype(np.uint8).tobytes() for x in sigs]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64()]
        cols = [[k[0] for k in keys], [k[1] for k in keys], sigs, sketch, [len(u) for u, _ in sets]]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, x) for c, x in zip(cols, types, strict=True))], names=["id", "h1", "h2", "sig", "sketch", "size"])


def _alike(least: float):
    """Keeps the pairs whose signatures agree as pairs at `least` do, or in up
    to five standard errors fewer coordinates."""
    agree = least - 5 * np.sqrt(least * (1 - least) / K)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).flatten().to_numpy().reshape(-1, K) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array((x == y).mean(1) >= agree, pa.bool_()))

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            return weighted((text or "").encode("utf-8", "surrogatepass"))

        for b in batches:
            ok = [similarity(of(x.as_py()), of(y.as_py())) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [weighted((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)]
        cols = [b.column(0), pa.array([u.view(np.int64) for u, _ in got], pa.list_(pa.int64())), pa.array([c for _, c in got], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "elements", "counts"])


def _close(pdf: pd.DataFrame, same_at, agree: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a cell the later rows of other components that the cell
    has to compare with it and that agree in enough coordinates."""
    comp, own, inside = pdf.component.to_numpy(), pdf.own.to_numpy(), bool(pdf.inside.iloc[0])
    for k in range(len(pdf) - 1):
        same = same_at(k)
        at = np.flatnonzero((same >= agree) & (comp[k + 1 :] != comp[k]) & (inside | (own[k + 1 :] != own[k])))
        if len(at):
            yield k, at + k + 1, same[at]


MEMBER = ["cell", "id", "component", "own", "inside", "size"]


def _with_partners(least: float):
    """The members of cells (pairs of blocks of a bucket) that may be alike to
    another, by one byte of each coordinate."""
    agree = least - 5 * np.sqrt(least * (1 - least) / K)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [group[MEMBER].iloc[:0]]
        for _, cell in group.groupby("cell", sort=False):
            x = np.frombuffer(b"".join(cell.sketch), np.uint8).reshape(-1, K)
            some = np.zeros(len(cell), bool)
            for k, at, _ in _close(cell, lambda k, x=x: (x[k + 1 :] == x[k]).mean(1), agree):
                some[k] = some[at] = True
            out.append(cell.loc[some, MEMBER])
        return pd.concat(out)

    return run


def _link_cells(least: float):
    """Links between components inside cells: a spanning forest of the
    components' verified links.  Likely pairs come first; a pair that earlier
    links have joined is not compared."""
    agree = least - 5 * np.sqrt(least * (1 - least) / K)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, cell in group.groupby("cell", sort=False):
            comp = cell.component.to_numpy()
            sig = np.stack(cell.sig.to_numpy())
            sets = list(zip(cell.elements, cell.counts, strict=True))
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found = [(np.full(len(at), k), at, same) for k, at, same in _close(cell, lambda k, sig=sig: (sig[k + 1 :] == sig[k]).mean(1), agree)]
            if not found:
                continue
            a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
            for k in np.argsort(-score, kind="stable").tolist():
                x, y = int(comp[a[k]]), int(comp[b[k]])
                rx, ry = find(x), find(y)
                if rx != ry and similarity(sets[a[k]], sets[b[k]]) >= least:
                    root[max(rx, ry)] = min(rx, ry)
                    out.append((min(x, y), max(x, y)))
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, component_id (the smallest id reachable over
    pairs of at least `least`), kept (it is that document).

    Null text counts as empty; texts without a word are alike.  Texts of fewer
    than five words are one shingle.  A null id is its own kept document.  Rows
    that repeat an id give a row each, by their own text; ids are otherwise
    taken as unique.  Pairs at exactly `least` are alike.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    signed = durable(spread(base.where("id is not null")).mapInArrow(_sign, "id long, h1 long, h2 long, sig array<int>, sketch binary, size long"))
    with scratch():
        comps, classes = _class_components(base, signed, least)
    found = classes.join(comps, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("id", "h1", "h2").join(found, ["h1", "h2"]).select("id", "component_id")
    out = out.union(base.where("id is null").select("id", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _class_components(base: DataFrame, signed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the classes that link with another, and the classes
    (h1, h2, id) of equal word sequences, both stored."""
    classes = durable(signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "sig", "sketch", "size")).alias("m")).select("h1", "h2", "m.*"))
    # Buckets of at least two classes
    bands = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    spots = classes.where("sig is not null").select("id", "size", F.explode(bands).alias("band")).distinct()
    shared = spots.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    buckets = durable(spots.join(shared.select("band", "lead"), "band"))
    involved = buckets.select("id").distinct()
    sigs = durable(classes.join(involved, "id", "left_semi").dropDuplicates(["id"]).select("id", "sig", "sketch"))
    texts = durable(base.where("id is not null").join(involved, "id", "left_semi").dropDuplicates(["id"]))

    def ends(pairs: DataFrame, table: DataFrame, col: str) -> DataFrame:
        a = table.select(F.col("id").alias("src"), F.col(col).alias("a"))
        b = table.select(F.col("id").alias("dst"), F.col(col).alias("b"))
        return pairs.join(b, "dst").join(a, "src").select("src", "dst", "a", "b")

    def compare(pairs: DataFrame) -> DataFrame:
        alike = ends(pairs, sigs, "sig").mapInArrow(_alike(least), "src long, dst long")
        return ends(alike, texts, "t").mapInArrow(_verify(least), "src long, dst long")

    led = buckets.where("id <> lead").select(F.col("lead").alias("src"), F.col("id").alias("dst")).distinct()
    comps = durable(connected_components(durable(compare(led))))

    def unsettled(members: DataFrame) -> DataFrame:
        """Members of the buckets in which two that have not led are apart."""
        span = members.where("not led").groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        return members.join(span.where("lo <> hi").select("band"), "band", "left_semi")

    start = buckets.join(comps, "id", "left").select("band", "id", "size", F.coalesce("component", "id").alias("component"), (F.col("id") == F.col("lead")).alias("led"))
    active = durable(unsettled(start).where("not led").drop("led"))
    # a bucket's number of blocks reaches its members by the salts that they have, so that no task gets a whole bucket
    salts = max(SALTS, int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = active.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(SALTS)), F.lit(salts)))
    counted = salted.groupBy("band", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = counted.groupBy("band").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("nb"), F.collect_list("salt").alias("found"))
    dealt = salted.join(blocks.select("band", "nb", F.explode("found").alias("salt")), ["band", "salt"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cell = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    cells = durable(dealt.select(cell, "id", "component", "own", (F.col("own") == F.col("other")).alias("inside"), "size"))

    def parts(table: DataFrame) -> DataFrame:
        """Deals cells to tasks of like numbers of rows and shingles."""
        n, shingles = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        return table.withColumn("part", F.pmod("cell", F.lit(max(211, n // TASK_ROWS, shingles // TASK_SHINGLES))))

    # one byte a coordinate tells which members have a likely partner; only they meet with their shingles
    light = parts(cells).join(sigs.select("id", "sketch"), "id")
    some = durable(light.groupBy("part").applyInPandas(_with_partners(least), "cell long, id long, component long, own int, inside boolean, size long"))
    sets = texts.join(some.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "id long, elements array<long>, counts array<long>")
    loaded = parts(some).drop("size").join(durable(sets.join(sigs.select("id", "sig"), "id")), "id")
    links = durable(loaded.groupBy("part").applyInPandas(_link_cells(least), "src long, dst long"))
    merged = durable(connected_components(links))
    roots = merged.toDF("component", "into")
    comps = comps.union(merged.select("id", F.col("id").alias("component")).join(comps, "id", "left_anti"))
    comps = comps.join(roots, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
    return lasting(comps), lasting(classes.select("h1", "h2", "id"))
