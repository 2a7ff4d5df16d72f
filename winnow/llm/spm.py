"""SentencePiece encoding and decoding, by a max-plus scan or by merges.

Models of the unigram kind: encoding is the best path (largest sum of piece
scores) through a text.  Its state at a cut is how far the piece that crosses
it reaches.  A giant run is split into chunks; each chunk alone gives the matrix
of best sums from entry to exit state, matrices are combined associatively (max,
+), and with the states at its ends known each chunk is traced back by itself.
Models of the merge kind: the two neighbours whose joint piece has the best
score are merged, of equals the leftmost, until no two make a piece.

No piece holds a blank mark after another character, so every run of blanks
and the word after it is a chunk with one state at both ends; the path of a
word is worked out once per batch, for all new words together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.storage import spread

MARK = "▁"
GIANT = 256  # longer runs without a blank are scanned in chunks
CHUNK = 128
CACHE = 1_000_000  # words whose path is kept
LOT = 1024  # documents whose new words are worked out together
BELOW = 10.0  # how far under the least score a character that no piece holds (spelled as bytes) is
NONE = -1e18


BPE = 2  # model types are 1 unigram, 2 merges, 3 words, 4 characters


def model_type(proto: bytes) -> int:
    """Field 3 of the trainer's settings, which are field 2 of a model file."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                if b < 128:
                    return out
                shift += 7

        while at < len(data):
            key = number()
            size = 0
            if key & 7 == 0:
                yield key >> 3, number()
                continue
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size

    trainer = b"".join(v for k, v in fields(proto) if k == 2)
    return next((v for k, v in reversed([*fields(trainer)]) if k == 3), 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best sums over two spans one after the other."""
    return (a[:, :, None] + b[None]).max(1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, combined in a tree."""
    if len(matrices) < 2:
        return matrices
    pairs = prefixes([product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    return [matrices[0], *(pairs[k // 2] if k % 2 else product(pairs[k // 2 - 1], matrices[k]) for k in range(1, len(matrices)))]


class Pieces:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses words")
        self.merges = model_type(sp.serialized_model_proto()) == BPE
        self.unknown = min(self.score.values()) - BELOW
        self.longest = max(map(len, self.id))
        # marks that no piece holds after a letter: a cut there has one state as well
        after = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        free = [c for c in ",.!?;:\n" if c not in after]
        self.cut = re.compile(rf"(?<=[^\W\d_])(?=[{re.escape(''.join(free))}])") if free else re.compile(r"(?!)")
        self.spelled = [bytes([self.of_byte[i]]) if i in self.of_byte else self.text.get(i, "").encode("utf-8", "surrogatepass") for i in range(n)]
        self.cache: dict[str, bytes] = {}  # little-endian ids of a word

    def _arc(self, s: str) -> float:
        return self.score.get(s, self.unknown if len(s) == 1 else NONE)

    def scan(self, s: str, lo: int, hi: int) -> tuple[np.ndarray, dict]:
        """The chunk s[lo:hi]: best sums by (entry, exit) and the way back."""
        k = self.longest
        most = np.full((k, hi - lo + k), NONE)  # [entry, place]; pieces start inside the chunk
        back = np.zeros((k, hi - lo + k), np.int16)
        for a in range(min(k, hi - lo + 1)):
            most[a, a] = 0.0
        for i in range(lo, hi):
            for j in range(i + 1, min(i + k, len(s)) + 1):
                arc = self._arc(s[i:j])
                if arc > NONE:
                    new = most[:, i - lo] + arc
                    better = new > most[:, j - lo]
                    most[better, j - lo] = new[better]
                    back[better, j - lo] = j - i
        return most[:, hi - lo :].copy(), {"back": back, "lo": lo}

    def _giant(self, s: str) -> list[str]:
        cuts = [*range(0, len(s), CHUNK), len(s)]
        parts = [self.scan(s, lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        matrices = [m for m, _ in parts]
        start = np.full(self.longest, NONE)
        start[0] = 0.0
        rows = [start, *(p[0] for p in prefixes(matrices))]  # best sums at each cut, by state
        out = 0
        states = [out]  # at cuts, from the end on
        for m, r in zip(reversed(matrices), reversed(rows[:-1]), strict=True):
            out = int(np.argmax(r + m[:, out]))
            states.append(out)
        states.reverse()
        found: list[str] = []
        for (_, p), lo, hi, a, b in zip(parts, cuts, cuts[1:], states, states[1:], strict=False):
            j, mine = hi - lo + b, []
            while j > a:
                step = int(p["back"][a, j])
                mine.append(s[lo + j - step : lo + j])
                j -= step
            found += reversed(mine)
        return found

    def _words(self, words: list[str]) -> None:
        """Paths of many short words at once, place by place."""
        for size in sorted({len(w) for w in words}):
            same = [w for w in words if len(w) == size]
            most, back = np.full((len(same), size + 1), NONE), np.zeros((len(same), size + 1), np.int32)
            most[:, 0] = 0.0
            for j in range(1, size + 1):
                for i in range(max(0, j - self.longest), j):
                    get = self.score.get
                    arc = np.array([get(w[i:j], NONE) for w in same])
                    if j == i + 1:
                        arc = np.where(arc > NONE, arc, self.unknown)
                    new = most[:, i] + arc
                    better = new > most[:, j]
                    most[better, j] = new[better]
                    back[better, j] = i
            for w, b in zip(same, back.tolist(), strict=True):
                j, path = size, []
                while j:
                    path.append(w[b[j] : j])
                    j = b[j]
                self.cache[w] = self._ids(reversed(path))

    def _merged(self, s: str) -> list[str]:
        """The pieces of s after all merges, best score first, of equals the
        leftmost."""
        get, n = self.score.get, len(s)
        part, after, before = list(s), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(-score, i, s[i : i + 2]) for i in range(n - 1) if (score := get(s[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i]
            if j < 0 or not part[i] or len(part[i]) + len(part[j]) != len(joined) or part[i] + part[j] != joined:
                continue  # one of the two has been merged since
            part[i], part[j], after[i] = joined, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (score := get(new := joined + part[after[i]])) is not None:
                    heappush(heap, (-score, i, new))
            if (h := before[i]) >= 0 and (score := get(new := part[h] + joined)) is not None:
                heappush(heap, (-score, h, new))
        return [p for p in part if p]

    def _ids(self, path) -> bytes:
        out: list[int] = []
        for p in path:
            if p in self.id:
                out.append(self.id[p])
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        split = [(" " + t).replace(" ", f"\0{MARK}").replace(f"{MARK}\0", MARK) if t and "\0" not in t else "" for t in texts]
        split = [self.cut.sub("\0", s).split("\0")[1:] if s else [(" " + t).replace(" ", MARK)] if t else [] for s, t in zip(split, texts, strict=True)]
        new = {w for s in split for w in s} - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = {w for s in split for w in s}
        if self.merges:
            for w in new:
                self.cache[w] = self._ids(self._merged(w))
        else:
            self._words([w for w in new if len(w) <= GIANT])
            for w in new:
                if len(w) > GIANT:
                    self.cache[w] = self._ids(self._giant(w))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), "<u4") for s in split]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.spelled.__getitem__, ids))
        return data.decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


@lru_cache(maxsize=1)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids_crc32 (little-endian unsigned
    32-bit ids), round_trip (decoding gives the text back) and ids.

    Null and empty texts have no token; null and repeated ids and repeated rows
    are encoded like any other, and an empty table gives an empty result.  Of
    paths with equal sums the one whose last piece starts first is taken, of
    equal merges the leftmost.  A text's own block marks (U+2581) come back as
    blanks, as is usual, so they make round_trip false.  Other columns are
    ignored.  A text must fit in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_file)
        for b in batches:
            for lo in range(0, b.num_rows, LOT):
                part = b.slice(lo, LOT)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = p.encode_many(texts)
                cols = [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([p.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["id", "n_tokens", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])]
    schema = "id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)
