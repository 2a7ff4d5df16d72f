"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  An n-gram binds (takes
the product of) its letters' vectors, each permuted (rotated) by its place; a
text bundles (sums) its n-gram vectors.  A language's prototype is the bundle
of all texts learned for it; a text gets the language whose prototype has the
largest cosine with its own vector.

Training sums vectors per partition and language, so what reaches the driver
is one vector per language.  Prediction is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.textops import fresh
from winnow.storage import spread

DIM = 1024
NGRAM = 3
CACHED_GRAMS = 40_000
HELD_GRAMS = 500_000  # n-grams of texts that are bundled at once in training
UNKNOWN = "und"
MAX_LANGUAGES = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_codes(text: str | None) -> np.ndarray:
    """The n-grams of a whole text as integers: lower case, anything between
    words one blank.  Empty if the text has no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[raw], raw, 0).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    if not c.any():
        return np.zeros(0, np.int64)
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    codes = np.zeros(max(len(c) - NGRAM + 1, 0), np.int64)
    for k in range(NGRAM):
        codes = codes << 21 | c[k : len(c) - NGRAM + 1 + k]
    return codes


class Space:
    """n-gram vectors, made on demand and kept in a bounded table."""

    def __init__(self, dim: int = DIM):
        self.dim, self.rows, self.at = dim, np.zeros((CACHED_GRAMS, dim), np.int8), {}
        self.letter = lru_cache(maxsize=20_000)(self._letter)

    def _letter(self, c: int) -> np.ndarray:
        return np.random.Generator(np.random.Philox(key=c + 1)).integers(0, 2, self.dim, np.int8) * 2 - 1

    def vector(self, code: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for k in range(NGRAM):
            out = out * np.roll(self.letter(code >> 21 * k & 0x1FFFFF), k)
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dim, np.float32)
        for lo in range(0, len(codes), CACHED_GRAMS // 2):
            part = codes[lo : lo + CACHED_GRAMS // 2].tolist()
            if len(self.at) + len(part) > CACHED_GRAMS:
                self.at.clear()
            at = self.at
            for x in part:
                if x not in at:
                    self.rows[len(at)] = self.vector(x)
                    at[x] = len(at)
            idx = [at[x] for x in part]
            total += counts[lo : lo + len(idx)].astype(np.float32) @ self.rows[idx].astype(np.float32)
        return total


@lru_cache(maxsize=1)
def _space() -> Space:
    return Space()


def learn_prototypes(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype per non-null language, learned from all given rows.
    Texts without a letter add nothing.  More than MAX_LANGUAGES languages are
    an error, as their prototypes would not fit the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(), {}
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> None:
            for lang, codes in held.items():
                got = space.bundle(*np.unique(np.concatenate(codes), return_counts=True))
                sums[lang] = sums.get(lang, 0) + got.astype(np.float64)
            held.clear()

        size = 0
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                lang = lang.as_py()
                if lang is not None and len(codes := gram_codes(text.as_py())):
                    held.setdefault(lang, []).append(codes)
                    size += len(codes)
                    if size > HELD_GRAMS:
                        flush()
                        size = 0
        flush()
        out = [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(out, names=["lang", "v"])

    parts = spread(rows.select(F.col(text).alias("t"), F.col(lang).alias("l"))).mapInArrow(run, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    out = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in found}
    return {k: v / np.linalg.norm(v) for k, v in out.items() if v.any()}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the cosine, 0 if negative) and n_grams (how many
    different n-grams the text has).  Null texts and texts without a letter are
    `und` with score 0, as is every text where nothing was learned; ties go to
    the first language in order."""
    names = sorted(prototypes)
    protos = np.array([prototypes[k] for k in names], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space()
        for b in batches:
            preds, scores, sizes = [], [], []
            for text in b.column(b.num_columns - 1):
                codes, counts = np.unique(gram_codes(text.as_py()), return_counts=True)
                sizes.append(len(codes))
                if not len(codes) or not names:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = space.bundle(codes, counts)
                cos = protos @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cos))
                preds.append(names[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=out_names)

    added = ("lang_pred", "score", "n_grams")
    kept = [c for c in docs.columns if c.lower() not in added]
    out_names = [*kept, *added]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double").add("n_grams", "long")
    return spread(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(fresh("text", kept)))).mapInArrow(run, schema)
