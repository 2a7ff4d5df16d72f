"""Best-fit packing by exact-complement hashing.

Documents become token pieces in one narrow pass.  Everything that decides the
packing is a function of the histogram of piece lengths, which has at most
`capacity` entries whatever the input size.  The driver therefore plans in
bulk: for the longest length with items left, the gap it leaves is looked up
among the lengths, then in the index of pair sums, then in that of triple sums, and of
those still available as many combinations are consumed as the availability counts allow; what
remains is placed best-fit, also in bulk.  The plan is a bounded table of
(length, rank interval) -> (sequence, offset); each piece finds its place by
its rank among the pieces of its length.  Ranks are dealt over many salted
groups, so one length holding most rows is no hot spot.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.storage import durable, spread

CAPACITY = 2048
RANK_GROUP_ROWS = 50_000

#: Fixed value: the byte-level splitting rule of the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"  # deal: a row's number in its task

LONG_BLANKS = 10_000  # longer blank runs pass by the splitting expression, which such runs exhaust

#: Characters on whose classes all Unicode versions and regex engines agree.
#: Texts with others, or with the special token, go to the tokenizer itself.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]")
_SPECIAL = "<|endoftext|>"
_BLANKS = re.compile(rf"[\t\n\r ]{{{LONG_BLANKS},}}")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary and splitting rule are the tokenizer file's; plain texts are
    merged by a faster public implementation of the same byte-level BPE (the
    tests hold the two against each other), all others by the tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        import tiktoken

        self.file = tokenizer_file
        with open(tokenizer_file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(shown)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(to_byte[c] for c in tok): i for tok, i in vocab.items() if tok != _SPECIAL}
        coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.fast, self.one_part = coder.encode_ordinary, coder._encode_single_piece

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def _plain(self, text: str) -> list[int]:
        """Ids of a plain text.  The rule makes one part of a blank run, but
        for its last character where something follows it."""
        out: list[int] = []
        at = 0
        for run in _BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.fast(text[at : run.start()])
            out += self.one_part(text[run.start() : end].encode())
            at = end
        return out + self.fast(text[at:])

    def encode(self, text: str) -> bytes:
        plain = not _OTHER.search(text) and _SPECIAL not in text
        ids = self._plain(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> Encoder:
    """One encoder a worker process, whatever the number of its tasks."""
    return Encoder(tokenizer_file)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document.

    A document is its ids and then id 0; null text counts as empty, so it is
    the single id 0.  Documents longer than `capacity` are cut from the end
    into pieces of `capacity` ids; the first piece takes the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, deal = _encoder(tokenizer_file), 0
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                cut = n - (-(-n // capacity) - 1) * capacity
                edges = [0, *range(cut, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((doc, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), deal))
                    deal += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, PIECES)


def plan_patterns(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(runs, count)]: `count` sequences, each of runs (length, how many).

    Bulk exact-complement consumption, then bulk best fit of the residuals.
    """
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in hist.items():
        avail[n] += c
    plans: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if avail[capacity]:
        plans.append((((capacity, 1),), int(avail[capacity])))
        avail[capacity] = 0

    def consume(parts: list[int]) -> bool:
        runs: dict[int, int] = {}
        for p in parts:
            runs[p] = runs.get(p, 0) + 1
        n = min(int(avail[p]) // m for p, m in runs.items())
        if n < 1:
            return False
        for p, m in runs.items():
            avail[p] -= n * m
        plans.append((tuple(sorted(runs.items(), reverse=True)), n))
        return True

    # The index: for each sum, the first (longest) parts of its pairs and triples.
    held = avail > 0
    pair_index = np.zeros((capacity + 1, capacity + 1), dtype=bool)
    for x in np.flatnonzero(held).tolist():
        rest = np.arange(1, min(x, capacity - x) + 1)
        pair_index[x + rest, x] = held[rest]
    pair_sum = pair_index.any(axis=1)
    triple_index = np.zeros_like(pair_index)
    for x in np.flatnonzero(held).tolist():
        rest = np.arange(2, min(2 * x, capacity - x) + 1)  # the longest of three is at least a third
        triple_index[x + rest, x] = pair_sum[rest]

    def first_parts(index: np.ndarray, total: int, top: int) -> list[int]:
        """Indexed first parts up to `top` still available, longest first."""
        at = np.flatnonzero(index[total, : top + 1])
        return at[avail[at] > 0][::-1].tolist()

    def pairs(total: int, top: int, keep: list[int]) -> list[int] | None:
        for x in first_parts(pair_index, total, top):
            parts = [*keep, x, total - x]
            if all(avail[p] >= parts.count(p) for p in set(parts)):
                return parts
        return None

    def triples(total: int, top: int, keep: list[int]) -> list[int] | None:
        for x in first_parts(triple_index, total, top):
            if found := pairs(total - x, x, [*keep, x]):
                return found
        return None

    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        while avail[length] > 0:
            if avail[gap] > 0 and consume([length, gap]):
                continue
            found = pairs(gap, min(length, gap - 1), [length]) or triples(gap, min(length, gap - 1), [length])
            if not found or not consume(found):
                break

    # Residuals: open sequences with the same content form one class.
    classes: dict[int, list[list]] = {}  # gap -> [runs, count]
    for length in np.flatnonzero(avail)[::-1].tolist():
        left = int(avail[length])
        for gap in sorted(g for g in classes if g >= length):
            if not left:
                break
            fit, stay = gap // length, []
            for runs, count in classes.pop(gap):
                whole = min(count, left // fit)
                rest = left - whole * fit if whole < count else 0
                if whole:
                    classes.setdefault(gap - fit * length, []).append([[*runs, (length, fit)], whole])
                    left -= whole * fit
                if rest and left:
                    classes.setdefault(gap - rest * length, []).append([[*runs, (length, rest)], 1])
                    left -= rest
                    whole += 1
                if count > whole:
                    stay.append([runs, count - whole])
            if stay:
                classes.setdefault(gap, []).extend(stay)
        fit = capacity // length
        if left // fit:
            classes.setdefault(capacity - fit * length, []).append([[(length, fit)], left // fit])
        if left % fit:
            classes.setdefault(capacity - left % fit * length, []).append([[(length, left % fit)], 1])
    plans += [(tuple(runs), count) for same in classes.values() for runs, count in same]
    return plans


def placement_table(plans: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, per sequence, offset) rows; ranks in
    [lo, hi) of a length fill `per` places in each sequence from `first` on."""
    rows, used, seq = [], {}, 0
    for runs, count in plans:
        at = 0
        for length, per in runs:
            lo = used.get(length, 0)
            used[length] = lo + per * count
            rows.append((length, lo, lo + per * count, seq, per, at))
            at += per * length
        seq += count
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table: it is read
    three times).  An empty table gives an empty result."""
    spark = pieces.sparkSession
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = placement_table(plan_patterns(hist, capacity))
    table = F.broadcast(spark.createDataFrame(rows, "l_length long, lo long, hi long, first long, per long, at long").coalesce(1))
    salts = max(211, sum(hist.values()) // RANK_GROUP_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("inside", inside).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inside") - 1)
    here = (F.col("length") == F.col("l_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    k = F.col("rank") - F.col("lo")
    return ranked.join(table, here).select(
        *[c for c in pieces.columns if c != "deal"],
        (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (k % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in sequences of `capacity`.

    Null and empty texts are the one id 0.  Null and repeated ids and repeated
    rows are documents like any other; every row is packed.  Texts may be of
    any length and hold blank runs of any length.  Pieces of one length are
    alike, so which takes which place is decided by id, piece and place in the
    input.  Other columns are ignored; an empty table gives an empty result.
    """
    return pack(durable(token_pieces(docs, tokenizer_file, capacity, id_col, text_col)), capacity)
