"""Stupid-backoff language-model scores from count tables partitioned by hash.

Documents meet in lots of about LOT_BYTES of text.  Each lot lists its distinct
n-grams (64-bit hashes of the empty n-gram and those of up to `order` words)
with their counts, sorted and split by range of hash; those lists, not the single n-grams,
are what is shuffled.  The lists of one range together are that part of the
corpus's count table; every list is answered with the counts of its n-grams.
Each lot then joins the answers to its documents' n-grams and sums them per
document.  An n-gram seen fewer than `cutoff` times in the corpus backs off to
the one without its first word, times 0.4.  An n-gram occurs at most once in a lot's list, so frequent
ones weigh on no range more than rare ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.textops import BASE, SPACE, U, mix, prefix_sums, span_hash

BACKOFF = 0.4
ORDER = 2  # with CUTOFF as in ORACLE
CUTOFF = 2
LOT_BYTES = 8 << 20  # of text, in one lot of documents
RANGE_BYTES = 16 << 20  # of text, for one range of hashes
MAX_PARTITIONS = 50_000  # tasks that share the lots
WINDOW = 1 << 17  # bytes hashed at a time

EMPTY = U(0)  # the empty n-gram: its count is the number of words


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    lo, hi = _edges(raw)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.append(np.searchsorted(lo, starts), len(lo))))
    hashes = np.empty(len(lo), U)
    k = 0
    while k < len(lo):
        end = max(k + 1, int(np.searchsorted(hi, lo[k] + WINDOW, "right")))
        at = lo[k]
        sums = prefix_sums(raw[at : hi[end - 1]])
        hashes[k:end] = span_hash(sums, lo[k:end] - at, hi[k:end] - at)
        k = end
    return hashes, doc


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    los, his, before = [], [], True
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    for a in range(0, len(raw), WINDOW):
        blank = SPACE[raw[a : a + WINDOW]]
        turns = np.flatnonzero(np.diff(blank, prepend=before))
        into = blank[turns]
        his.append((turns[into] + a).astype(kind))
        los.append((turns[~into] + a).astype(kind))
        before = blank[-1]
    if not before:
        his.append(np.array([len(raw)], kind))
    return np.concatenate([np.zeros(0, kind), *los]), np.concatenate([np.zeros(0, kind), *his])


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, np.ndarray, np.ndarray]]]:
    """Hashes of the empty n-gram, of all words and of the n-grams of each
    length from 2 to `order`, in the order of their last words; of every word
    its text; for each of those lengths its slice of the hashes, the words that
    end its n-grams, and where the n-grams one shorter that end a word before
    stand among those of their length.

    Words are numbered in 32 bits and n-grams hashed by WINDOW, as a lot may
    be one long text."""
    w, doc = token_hashes(texts)
    out = np.empty(1 + order * len(w), U)
    out[0] = EMPTY
    out[1 : len(w) + 1] = w
    lengths, last, ends = [], slice(1, len(w) + 1), np.arange(len(w), dtype=np.int32 if len(w) < 1 << 31 else np.int64)
    for n in range(2, order + 1):
        at = ends[1:]  # whose word before ends an n-gram shorter by one, too
        before = np.flatnonzero(doc[at] == doc[at - (n - 1)]).astype(ends.dtype)
        ends = at[before]
        here = slice(last.stop, last.stop + len(ends))
        for a in range(0, len(ends), WINDOW):
            b = min(a + WINDOW, len(ends))
            out[here.start + a : here.start + b] = mix(mix(out[last][before[a:b]] * BASE + U(n - 1)) + w[ends[a:b]])
        lengths.append((here, ends, before))
        last = here
    return out[: last.stop], doc, lengths


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned integers by byte place, without the leading places that are 0."""
    places = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    wide = max((k + 1 for k in range(8) if places[k].any()), default=1)
    return places[:wide].tobytes()


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    places = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(places)] = places.T
    return out.view("<u8").reshape(-1)


def packed(x: np.ndarray) -> bytes:
    data = squeeze(x)
    return b"z" + zlib.compress(data, 1) if len(data) > 64 else b" " + data


def unpacked(data: bytes, n: int) -> np.ndarray:
    return unsqueeze(zlib.decompress(data[1:]) if data[:1] == b"z" else data[1:], n)


def range_floor(k: int, parts: int) -> np.uint64:
    """The least hash of the k-th of `parts` (at most 2**32) ranges."""
    return U(-(-(k << 32) // parts) << 32)


def _new(ranked: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], ranked[1:] != ranked[:-1]))


def _places(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of distinct keys, and of every key its place among them, ascending."""
    order = keys.argsort()
    nth = np.cumsum(_new(keys[order]), dtype=np.int32 if len(keys) < 1 << 31 else np.int64)
    place = np.empty_like(nth)
    place[order] = nth - 1
    return int(nth[-1]), place


def _texts(lot: pa.Table) -> list[bytes]:
    return [t or b"" for t in lot.column("text").cast(pa.large_binary()).to_pylist()]


LISTS = "lot long, part long, size long, grams binary, counts binary"
ANSWERS = "lot long, part long, size long, counts binary"


def list_grams(parts: int, order: int) -> Callable[[pa.Table], pa.Table]:
    def run(lot: pa.Table) -> pa.Table:
        keys, doc = grams(_texts(lot), order)[:2]
        keys.sort()
        first = np.flatnonzero(_new(keys))
        n = np.diff(np.append(first, len(keys)))
        n[0] += len(doc) - 1
        keys = keys[first]
        number = lot.column("lot")[0].as_py()
        part = (keys >> U(32)) * U(parts) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))  # of the ranges that the lot has
        rows = []
        for k, a, b in zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            deltas = np.diff(keys[a:b], prepend=range_floor(k, parts))
            rows.append((number, k, b - a, squeeze(deltas), packed(n[a:b])))
        names = ["lot", "part", "size", "grams", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def answer(parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(lists: pa.Table) -> pa.Table:
        floor = range_floor(lists.column("part")[0].as_py(), parts)
        cuts = np.cumsum([0, *lists.column("size").to_pylist()])
        keys, n = np.empty(cuts[-1], U), np.empty(cuts[-1], U)
        for a, b, g, c in zip(cuts, cuts[1:], lists.column("grams"), lists.column("counts"), strict=False):
            np.cumsum(unsqueeze(g.as_py(), b - a), out=keys[a:b], dtype=U)
            n[a:b] = unpacked(c.as_py(), b - a)
        keys += floor
        order = keys.argsort(kind="stable")
        keys = keys[order]
        first = np.flatnonzero(_new(keys))
        del keys
        totals = np.add.reduceat(n[order], first)
        n[order] = np.repeat(totals, np.diff(np.append(first, len(n))))
        blobs = [packed(n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return lists.select(["lot", "part", "size"]).append_column("counts", pa.array(blobs, pa.binary()))

    return run


def score_lot(order: int, cutoff: int, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(lot: pa.Table, answers: pa.Table) -> pa.Table:
        keys, doc, lengths = grams(_texts(lot), order)
        size, place = _places(keys)
        del keys
        got = answers.select(["part", "size", "counts"]).sort_by("part")
        cuts = np.cumsum([0, *got.column("size").to_pylist()])
        if cuts[-1] != size:
            raise ValueError("a lot's answers don't match its n-grams")
        counts = np.empty(size)
        for a, b, c in zip(cuts, cuts[1:], got.column("counts"), strict=False):
            counts[a:b] = unpacked(c.as_py(), b - a)
        last = place[1 : len(doc) + 1]
        lp = np.log(counts[last] / max(counts[0], 1.0))
        for here, ends, before in lengths:
            n = counts[place[here]]
            seen = n >= cutoff
            lp[ends[~seen]] += np.log(BACKOFF)
            lp[ends[seen]] = np.log(n[seen] / counts[last[before[seen]]])
            last = place[here]
        k = np.bincount(doc, minlength=lot.num_rows)
        s = np.bincount(doc, weights=lp, minlength=lot.num_rows)
        cols = [lot.column("id").combine_chunks().cast(id_type), pa.array(k, pa.int64()), pa.array(s, pa.float64())]
        return pa.table(cols, names=["id", "k", "s"])

    return run


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cutoff: int = CUTOFF, order: int = ORDER) -> DataFrame:
    """One row per row of docs: id, n_words, log_score (sum of natural logs over
    its words) and mean_log_score (null without words).

    The score of a word after the order - 1 words before it is count(n-gram) /
    count(n-gram without the word) if the n-gram occurs `cutoff` times (1: at
    any count), else 0.4 times its score after one word less; that after none
    is count(word) / words in the corpus.  A word with fewer words before it
    starts from those, without the 0.4.  Null text counts as empty.  Every row
    is scored by itself, also where ids are null or repeated, and counts as
    often as it is given; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if order < 1:
        raise ValueError("the order is the number of words in an n-gram, 1 at least")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    lots, parts = size // LOT_BYTES + 1, size // RANGE_BYTES + 1
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("lot", F.pmod(F.xxhash64("id", "text"), F.lit(lots)))
    base = base.repartition(min(lots, MAX_PARTITIONS), "lot")
    id_type = to_arrow_type(base.schema["id"].dataType)
    lists = base.groupBy("lot").applyInArrow(list_grams(parts, order), LISTS)
    answers = lists.repartition(min(parts, MAX_PARTITIONS), "part").groupBy("part").applyInArrow(answer(parts), ANSWERS)
    schema = base.select("id").schema.add("k", "long").add("s", "double")
    scored = base.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(score_lot(order, cutoff, id_type), schema)
    return scored.select(F.col("id").alias(id_col), F.col("k").alias("n_words"), F.round("s", 4).alias("log_score"), F.round(F.col("s") / F.nullif("k", F.lit(0)), 6).alias("mean_log_score"))


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13) || chr(12) || chr(11), '     '), ' '), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS word, unnest(list_prepend(NULL, w[:len(w) - 1])) AS before FROM d WHERE len(w) > 0),
c1 AS (SELECT word, count(*) AS n1 FROM g GROUP BY word),
c2 AS (SELECT before, word, count(*) AS n2 FROM g WHERE before IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT g.doc_id, CASE WHEN n2 IS NOT NULL THEN ln(n2 / b.n1) ELSE ln(c1.n1 / (SELECT sum(n1) FROM c1)::DOUBLE) + CASE WHEN g.before IS NULL THEN 0 ELSE ln(0.4) END END AS p
  FROM g JOIN c1 ON c1.word = g.word LEFT JOIN c2 ON c2.word = g.word AND c2.before = g.before LEFT JOIN c1 b ON b.word = g.before)
SELECT d.doc_id, count(p) AS n_words, round(coalesce(sum(p), 0), 4) AS log_score, round(sum(p) / nullif(count(p), 0), 6) AS mean_log_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
