"""Embedding near-duplicates by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard
transform and takes the closest of the 2d signed axes.  `HASHES` of them make a
table's bucket; `TABLES` tables are kept.  A vector lives in its own bucket of
each table and is also looked up in the `PROBES` next-best buckets.  Every pair
that meets is verified by cosine in double precision.

Identical vectors are collapsed first (with map-side combine) and only counted.
The number of hashes grows with the logarithm of the number of vectors, and a
last hash over a few axes only takes up the rest, so that buckets of unlike
vectors stay equally small at every number.  A bucket is cut into blocks of at most `BLOCK` residents and queries; a task
gets one pair of blocks, so no group is gathered whole.  A pair that meets more
than once is counted only at its first meeting, which both vectors' codes tell,
so no list of pairs is made: a block pair returns a link count per vector and a
spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.components import connected_components
from winnow.storage import durable, spread

TABLES = 8
LEAST_HASHES = 2
BUCKET = 32  # vectors that an average bucket may hold before one more hash is taken
LOAD = 0.5  # vectors in an average bucket once the last hash has cut it
PROBES = 4  # buckets looked up in each table, the own one first
BLOCK = 2000
LOT = 50_000  # pairs compared at once
TASK_ROWS = 20_000  # rows of several cells that one call gets
SEED = 20_011


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of 2."""
    n, w = x.shape
    h = 1
    while h < w:
        x = x.reshape(n, w // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, w)


def hashes_for(vectors: int, dim: int) -> int:
    """Whole hashes of a table, so that its buckets hold at most BUCKET on average."""
    sides = _sides(dim)
    most = max(LEAST_HASHES, 62 // (sides.bit_length() - 1))  # codes have 63 bits
    return min(most, max(LEAST_HASHES, math.ceil(math.log(max(1, vectors / BUCKET), sides))))


def last_axes(vectors: int, dim: int, hashes: int) -> int:
    """Axes of the last hash, a power of 2, that bring an average bucket down to
    LOAD vectors; 0 where the whole hashes do or codes have no room."""
    sides = _sides(dim)
    cut = vectors / LOAD / sides**hashes
    room = 62 - hashes * (sides.bit_length() - 1)
    bits = min(math.ceil(math.log2(max(1, cut))), sides.bit_length() - 1, room)
    return 1 << (bits - 1) if bits > 0 else 0


def _sides(dim: int) -> int:
    """Signed axes of a hash over whole vectors."""
    return 2 * max(2, 1 << (dim - 1).bit_length())


def codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = LEAST_HASHES, probes: int = PROBES, last: int = 0) -> np.ndarray:
    """(rows, tables, probes) bucket codes of unit vectors, the own one first;
    last is the number of axes of one more hash, if any."""
    n, d = vectors.shape
    w = _sides(d) // 2
    widths = [w] * hashes + ([last] if last else [])
    scale = [2 ** sum(x.bit_length() for x in widths[h + 1 :]) for h in range(len(widths))]  # of each hash in the code
    padded = np.zeros((n, w))
    padded[:, :d] = vectors
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        parts, second, lost = [], [], []
        for h, width in enumerate(widths):
            rng = np.random.Generator(np.random.Philox(key=[SEED + 1000 * t + h, w]))
            x = padded
            for _ in range(3):
                x = _hadamard(x * (rng.integers(0, 2, w) * 2.0 - 1)) / np.sqrt(w)
            x = x[:, :width]
            top = min(3, width)
            axes = np.argpartition(-np.abs(x), top - 1, axis=1)[:, :top]
            order = np.argsort(-np.abs(np.take_along_axis(x, axes, 1)), axis=1, kind="stable")
            axes = np.take_along_axis(axes, order, 1)
            value = np.take_along_axis(x, axes, 1)
            code = 2 * axes + (value < 0)
            parts.append(code[:, 0])
            for k in range(1, top):
                second.append((h, code[:, k]))
                lost.append(np.abs(value[:, 0]) - np.abs(value[:, k]))
        own = sum(p * by for p, by in zip(parts, scale, strict=True))
        out[:, t, :] = own[:, None]
        # the next-best buckets change one hash, least lost closeness first
        by_loss = np.argsort(np.stack(lost, 1), axis=1, kind="stable")
        alts = np.stack([own + (code - parts[h]) * scale[h] for h, code in second], 1)
        for k in range(1, probes):
            out[:, t, k] = alts[rows, by_loss[:, min(k, alts.shape[1]) - 1]]
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times the power of 2 that brings their largest component near 1,
    so that no product leaves the range of doubles; cosines stay the same."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pack(v: np.ndarray, codes: np.ndarray) -> list[bytes]:
    """Vectors and their codes as bytes, in half the width where that is exact."""
    with np.errstate(over="ignore", under="ignore"):
        half = v.astype("<f4")
    v = half if (half.astype(np.float64) == v).all() else v.astype("<f8")
    codes = codes.astype("<i4") if codes.max() < 1 << 31 else codes.astype("<i8")
    return [bytes([v.itemsize, codes.itemsize]) + a.tobytes() + b.tobytes() for a, b in zip(v, codes, strict=True)]


def _unpack(blobs: pd.Series, dim: int, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    out, codes = np.empty((len(blobs), dim)), np.empty((len(blobs), n_codes), np.int64)
    for k, b in enumerate(blobs):
        edge = 2 + dim * b[0]
        out[k] = np.frombuffer(b, f"<f{b[0]}", dim, 2)
        codes[k] = np.frombuffer(b, f"<i{b[1]}", n_codes, edge)
    return out, codes


def _meetings(home: np.ndarray, seek: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (seeker, resident) that share a cell, in bounded lots.

    home and seek are the cells of the residents and seekers, each sorted.
    """
    lo, hi = np.searchsorted(home, seek, "left"), np.searchsorted(home, seek, "right")
    many = hi - lo
    ends = np.cumsum(many)
    at = 0
    while at < len(seek):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT, "right")))
        n = many[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)
        yield a, b
        at = stop


def _links(group: pd.DataFrame, least: float, tables: int, probes: int) -> pd.DataFrame:
    """Verified links of some block pairs: (id, links, root) per linked vector."""
    return pd.concat([_links_of(part, int(dim), least, tables, probes) for dim, part in group.groupby("dim")])


def _links_of(group: pd.DataFrame, dim: int, least: float, tables: int, probes: int) -> pd.DataFrame:
    empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    group = group.sort_values("cell", kind="stable")
    home, seek = group[group.role == 0], group[group.role == 1]
    if not len(home) or not len(seek):
        return empty
    (hv, hc), (sv, sc) = (_unpack(g.blob, dim, tables * probes) for g in (home, seek))
    hc, sc = (c.reshape(-1, tables, probes) for c in (hc, sc))
    hn, sn = np.sqrt((hv * hv).sum(1)), np.sqrt((sv * sv).sum(1))
    hi, si, hm, sm = home.id.to_numpy(), seek.id.to_numpy(), home.members.to_numpy(), seek.members.to_numpy()
    tab = seek.tab.to_numpy()
    links: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in _meetings(home.cell.to_numpy(), seek.cell.to_numpy()):
        cos = np.einsum("ij,ij->i", sv[a], hv[b]) / (sn[a] * hn[b])
        near = (cos >= least) & (si[a] != hi[b])
        a, b = a[near], b[near]
        if not len(a):
            continue
        t, rows = tab[a], np.arange(len(a))
        forth = (sc[a] == hc[b][:, :, :1]).any(2)  # the seeker looks into the other's own bucket
        back = (hc[b] == sc[a][:, :, :1]).any(2)
        mine = (np.argmax(forth | back, axis=1) == t) & forth[rows, t] & (~back[rows, t] | (si[a] < hi[b]))
        for x, y, nx, ny in zip(si[a[mine]].tolist(), hi[b[mine]].tolist(), sm[a[mine]].tolist(), hm[b[mine]].tolist(), strict=True):
            links[x] = links.get(x, 0) + ny
            links[y] = links.get(y, 0) + nx
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
    if not links:
        return empty
    ids = list(links)
    return pd.DataFrame({"id": ids, "links": [links[x] for x in ids], "root": [find(x) for x in ids]})


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec: str = "embedding", group: str = "label", tables: int = TABLES, hashes: int | None = None, probes: int = PROBES) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Only rows with the same non-null group value and the same dimension are
    compared.  Null or zero vectors and ones with a null or non-finite
    component link with nothing, as do rows with a null id.  n_links counts
    the other rows linked directly; component_id is the smallest id reachable;
    kept marks the row that carries that id.  Rows that repeat an id and its
    vector count as identical vectors; ids are otherwise taken as unique.
    Vectors of any finite size are compared, as they are scaled first.  hashes
    is by default what `hashes_for` and `last_axes` say for the distinct vectors;
    where given, there is no last hash.  An empty table
    gives an empty result and other columns are ignored.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), F.col(group).alias("grp"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.col("grp").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)
    good = base.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # -0.0 and 0.0 are one value
    clean = good.where("usable").select("id", "grp", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    classes = durable(clean.groupBy("grp", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("members")))

    distinct = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row per dimension

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf.vec.map(len)
            for d in sorted(map(int, dims.unique())):
                part = pdf[dims == d]
                v = _scaled(np.stack(part.vec.to_numpy()))
                whole = hashes or hashes_for(distinct[d], d)
                got = codes(_unit(v), tables, whole, probes, 0 if hashes else last_axes(distinct[d], d, whole)).reshape(len(part), -1)
                yield pd.DataFrame({"id": part.rep.to_numpy(), "grp": part.grp.astype(str).to_numpy(), "dim": d, "blob": _pack(v, got), "members": part.members.to_numpy(), "codes": list(got)})

    schema = "id long, grp string, dim int, blob binary, members long, codes array<long>"
    indexed = durable(spread(classes).mapInPandas(index, schema))
    # role 0: at home in the table's own bucket; role 1: looks into a probed one
    spots = F.flatten(F.array(*[F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(int(p > 0)).alias("probe"), F.element_at("codes", t * probes + p + 1).alias("code")) for p in range(probes)]) for t in range(tables)]))
    seen = indexed.select("id", "grp", "dim", F.explode(spots).alias("s")).select("id", "grp", "dim", "s.tab", "s.code", "s.probe").distinct()
    homes = seen.where("probe = 0").select("id", "grp", "dim", "tab", "code", F.lit(0).alias("role"))
    key = ["grp", "dim", "tab", "code"]
    sizes = homes.groupBy(*key).agg(F.count("*").alias("n_home")).join(seen.groupBy(*key).agg(F.count("*").alias("n_seek")), key).where("n_seek > 1")
    sizes = durable(sizes.select(*key, F.ceil(F.col("n_home") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("n_seek") / BLOCK).cast("int").alias("sb")))
    both = homes.union(seen.select("id", "grp", "dim", "tab", "code", F.lit(1).alias("role")))
    placed = both.join(sizes, key)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, F.col("hb")).otherwise(F.col("sb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("sb")).otherwise(F.col("hb")) - 1))
    cells = placed.select("id", *key, "role", own.alias("own"), other.alias("other"))
    cells = cells.select("id", *key, "role", F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("cell_h"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("cell_s"))
    cells = durable(cells.select("id", "tab", "role", F.xxhash64(*key, "cell_h", "cell_s").alias("cell")))
    parts = max(211, cells.count() // TASK_ROWS)
    loaded = cells.join(indexed.select("id", "dim", "blob", "members"), "id").withColumn("part", F.pmod("cell", F.lit(parts)))
    found = durable(loaded.groupBy("part").applyInPandas(lambda g: _links(g, least, tables, probes), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("far"))
    comps = connected_components(found.select("id", "root"), "id", "root").select(F.col("id").alias("rep"), "component")
    per_class = (
        classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comps, "rep", "left")
        .select("grp", "vec", (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = clean.join(per_class, ["grp", "vec"]).select("id", "n_links", "component_id")
    alone = good.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS s, b.vec_id AS d FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(s, d) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, l.d FROM reach r JOIN links l ON r.d = l.s)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE s = v.vec_id) AS n_links,
  (SELECT min(d) FROM reach WHERE s = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(d) FROM reach WHERE s = v.vec_id) AS kept
FROM embeddings v
"""
