"""Removal of repeated 100-byte strings across a collection, exactly.

Every byte covered by a 100-byte string (window) that also starts earlier in
the collection goes.  The column-wise collection BWT was not kept: it needs as
many rounds as the longest document has bytes, each over the whole transform
(see the README).  Windows are grouped by content instead, in three levels,
each an exact refinement of the one before:

1. Each window belongs to its anchor, the least 24-gram in it by a hash.  Equal
   windows have equal anchors at equal places.  The windows of one anchor
   occurrence, with all the text they cover, form a run.  Runs with the same
   text are repeated in all their windows, but for the earliest.
2. Of anchors that occur with different texts, the earliest run of each text is
   cut by the distance to the anchor into runs of at most 17 windows, which
   share 84 bytes at least; these are compared likewise.
3. Of the rest, single windows are compared, by two independent hashes of 64
   bits each.

A level moves 32 bytes per run, in packed blocks per bucket of keys.  What
repeats inside one batch is settled there, so a run that a third of all
documents share reaches its bucket once a batch.  Of an anchor that stands in
many different texts, a batch sends its bucket HOT runs, enough to tell that
there are several texts; its other runs pass to the next level at once, which
finds whatever they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from winnow.llm.textops import U, mix, prefix_sums, span_hash
from winnow.storage import durable, spread

WINDOW = 100
GRAM = 24
STEP = 17
SEGMENT = 1 << 20  # window starts of a text handled at once, some 130 bytes each; places in it take 24 bits
LOT = 1_000_000  # runs that a task holds before it sends them
BUCKET_CHARS = 4_000_000
HOT = 8  # runs of one key that a batch sends to its bucket, 2 at least

RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("at", "<u8")])  # at: tag of the text << 48 | start << 16 | distance to anchor << 8 | windows


def anchor_runs(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Level 1 runs of a text: (key, ctx, -, at) arrays."""
    for seg in range(0, max(len(raw) - WINDOW + 1, 0), SEGMENT):
        part = raw[seg : seg + SEGMENT + WINDOW - 1]
        sums, n = prefix_sums(part), len(part)
        i = np.arange(n - GRAM + 1)
        h = span_hash(sums, i, i + GRAM)
        rank = (h >> U(24) << U(24)) | i.astype(U)
        w, m = WINDOW - GRAM + 1, n - WINDOW + 1
        rows = np.full(-(-len(rank) // w) * w, U(2**64 - 1))
        rows[: len(rank)] = rank
        rows = rows.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & U(0xFFFFFF)).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        hi = np.concatenate((lo[1:], [m]))
        p = place[lo]
        yield _runs(h[p], sums, lo, hi, p - lo, seg)


def _runs(key: np.ndarray, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray, seg: int) -> np.ndarray:
    out = np.zeros(len(lo), RUN)
    shape = (off << 8 | (hi - lo)).astype(U)
    out["key"], out["ctx"] = key, span_hash(sums, lo, hi + WINDOW - 1) ^ mix(shape)
    out["at"] = (lo + seg).astype(U) << U(16) | shape
    return out


def _split(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (at >> U(16) & U(0xFFFFFFFF)).astype(np.int64), (at >> U(8) & U(255)).astype(np.int64), (at & U(255)).astype(np.int64)


def _parts(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A text by segments: (text that its runs cover, runs that start in it as
    counted from its start, start)."""
    if len(raw) <= SEGMENT:
        yield raw, at, 0
        return
    at = np.sort(at)  # of one text, so by start
    edges = np.arange(0, len(raw) + SEGMENT, SEGMENT)
    cuts = np.searchsorted(_split(at)[0], edges)
    for seg, a, b in zip(edges.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=False):
        if a < b:
            yield raw[seg : seg + SEGMENT + 2 * WINDOW], at[a:b] - (U(seg) << U(16)), seg


def short_runs(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Level 2 runs of a text, from level 1 runs."""
    for part, own, seg in _parts(raw, at):
        sums = prefix_sums(part)
        lo, off, many = _split(own)
        p = lo + off
        for j in range(-(-WINDOW // STEP)):
            s0, s1 = np.maximum(lo, p - STEP * j - STEP + 1), np.minimum(lo + many, p - STEP * j + 1)
            ok = s0 < s1
            core = p[ok] - STEP * j
            yield _runs(span_hash(sums, core, core + WINDOW - STEP + 1) ^ U(j), sums, s0[ok], s1[ok], p[ok] - s0[ok], seg)


def single_windows(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Level 3: the windows of level 2 runs."""
    for part, own, seg in _parts(raw, at):
        lo, _, many = _split(own)
        s = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out = np.zeros(len(s), RUN)
        out["key"], out["at"] = span_hash(prefix_sums(part), s, s + WINDOW), (s + seg).astype(U) << U(16) | U(1)
        out["ctx"] = span_hash(prefix_sums(part, 1), s, s + WINDOW, 1)
        yield out


def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each text, in order of key; the others, which are repeated).
    One place given twice is not repeated."""
    runs = runs[np.lexsort((runs["at"], runs["doc"], runs["ctx"], runs["key"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["key"][1:] != runs["key"][:-1]) | (runs["ctx"][1:] != runs["ctx"][:-1])
    lead, late = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0)), np.flatnonzero(~new)
    again, lead = runs[late], runs[lead[late]]
    return runs[new], again[(again["doc"] != lead["doc"]) | (again["at"] >> U(16) != lead["at"] >> U(16))]


def _blocks(runs: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    runs[:] = [np.concatenate(runs)]
    first, again = settle(runs.pop())  # held nowhere else
    new = np.concatenate(([True], first["key"][1:] != first["key"][:-1])) if len(first) else np.zeros(0, bool)
    nth = np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
    first, direct = first[nth < HOT], first[nth >= HOT]
    of = (first["key"] % U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    names, kinds, blobs = [], [], []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        names.append(b)
        kinds.append(0)
        blobs.append(first[order[edges[b] : edges[b + 1]]].tobytes())
    for kind, known in ((1, again), (2, direct)):  # settled here: dealt anywhere
        for k in range(0, len(known), 4096):
            names.append(int(mix(mix(known["doc"][k : k + 1].view(U)) ^ known["at"][k : k + 1])[0] % U(buckets)))
            kinds.append(kind)
            blobs.append(known[k : k + 4096].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _make(level: Callable, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, RUN)], 0
        for b in batches:
            for k in range(b.num_rows):
                raw = np.frombuffer((b.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                more = (np.array(b.column(3)[k].as_py(), np.int64).view(U),) if b.num_columns > 3 else ()
                for got in level(raw, *more):
                    got["doc"] = b.column(0)[k].as_py()
                    got["at"] |= U(b.column(2)[k].as_py()) << U(48)
                    held.append(got)
                    size += len(got)
                    if size >= LOT:
                        yield from _blocks(held, buckets)
                        held, size = [np.zeros(0, RUN)], 0
        if size:
            yield from _blocks(held, buckets)

    return run


def _settle_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """kind 1: repeated windows; kind 2: runs to refine."""
    of = lambda k: np.concatenate([np.zeros(0, RUN), *(np.frombuffer(x, RUN) for x in pdf.blob[pdf.kind == k])])
    first, again = settle(of(0))
    many = np.zeros(len(first), bool)
    many[1:] |= first["key"][1:] == first["key"][:-1]
    many[:-1] |= first["key"][1:] == first["key"][:-1]
    again = np.concatenate([again, of(1)])
    more = np.concatenate([first[many], of(2)])
    both = np.concatenate([again, more])
    kind = np.repeat([1, 2], [len(again), len(more)])
    return pd.DataFrame({"kind": kind.astype(np.int32), "doc": both["doc"], "at": both["at"].view(np.int64)})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, tag, at) of runs of windows that also start earlier; docs: (doc, t,
    tag of 16 bits, which tells texts under one id apart)."""
    total = docs.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(211, total // BUCKET_CHARS)
    source, found = spread(docs), []
    tag = F.shiftrightunsigned("at", 48).cast("int").alias("tag")
    for level in (anchor_runs, short_runs, single_windows):
        blocks = source.mapInArrow(_make(level, buckets), "bucket int, kind int, blob binary")
        done = blocks.groupBy("bucket").applyInPandas(_settle_bucket, "kind int, doc long, at long")
        if level is not single_windows:  # the last level's rows are read once only
            done = durable(done)
        found.append(done.where("kind = 1").select("doc", tag, "at"))
        rest = done.where("kind = 2").groupBy("doc", tag).agg(F.collect_list("at").alias("runs"))  # at most a document's own
        source = docs.join(rest, ["doc", "tag"]).select("doc", "t", "tag", "runs")
    return found[0].union(found[1]).union(found[2])


def cover(n: int, at: np.ndarray) -> np.ndarray:
    """Which of n bytes the windows of the runs cover."""
    lo, _, many = _split(at)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(lo, n), 1)
    np.add.at(edge, np.minimum(lo + many + WINDOW - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept_text (remaining bytes; pieces of cut characters left out).

    Null text counts as empty.  Rows with a null id are neither searched nor
    cut.  A row given twice does not repeat itself: both are cut alike.  Texts
    under one id are told apart by a hash and come in its order.  Texts shorter
    than a window have nothing to remove.  Other columns are left out; carry
    adds them all, without the text, as the struct `row`.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"), *row)
    base = base.withColumn("tag", F.shiftrightunsigned(F.xxhash64("t"), 48).cast("int"))
    runs = repeated_windows(base.where(f"doc is not null and octet_length(t) >= {WINDOW}").select("doc", "t", "tag"))
    per_doc = runs.groupBy("doc", "tag").agg(F.collect_list("at").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                data = b.column(1)[k].as_py().encode("utf-8", "surrogatepass")
                at = b.column(2)[k].as_py()
                kept, spans, gone = data, 0, 0
                if at:
                    out = cover(len(data), np.array(at, np.int64).view(U))
                    spans, gone = int(out[0]) + int((out[1:] & ~out[:-1]).sum()), int(out.sum())
                    kept = np.frombuffer(data, np.uint8)[~out].tobytes()
                rows.append((len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[3:]], names=[*names, *(["row"] if carry else [])])

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    joined = base.join(per_doc, ["doc", "tag"], "left").select("doc", "t", "runs", *(["row"] if carry else []))
    whole = StructType.fromDDL(schema)
    return joined.mapInArrow(cut, whole.add(joined.schema["row"]) if carry else whole)
