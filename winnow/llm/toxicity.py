"""Toxicity by weak supervision.

Voters are lexicon words and word beginnings (patterns) found in a bounded
sample of labelled rows.  A generative label model, fitted by EM from the
voters' agreement, holds the rate at which each voter fires on either class and
their correlations, both estimated anew in each round, with the given label as
one more noisy voter; voters that fire together within a class share their say.
Its posteriors train a linear classifier over the votes, which scores every
whole text in one narrow pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.textops import fresh
from winnow.storage import durable, spread

SAMPLE_ROWS = 12_000  # labelled rows the voters and the classifier are fitted on
MAX_VOTERS = 256
HIT_SHARE = 0.004  # of the positive rows: the least number that a voter stands in
MIN_HITS = 3
MIN_LOG_ODDS = 3.0
PATTERN_LETTERS = 5
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> tuple[list[str], set[str]]:
    """All words of a text in lower case, and the beginnings of the longer."""
    words = _WORD.findall((text or "").lower())
    return words, {w[:PATTERN_LETTERS] + "*" for w in set(words) if len(w) > PATTERN_LETTERS}


def votes(text: str | None, lexicon: frozenset[str]) -> tuple[list[str], int, int]:
    """The voters that fire on a text, how many words hit, number of words."""
    words, starts = features(text)
    fired = [*(lexicon & set(words)), *(lexicon & starts)]
    hits = sum(w in lexicon or w[:PATTERN_LETTERS] + "*" in lexicon for w in words) if fired else 0
    return fired, hits, len(words)


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # of the voters, then of the four shape features
    bias: float

    def score(self, fired: list[str], hits: int, words: int) -> float:
        if not self.voters:
            return 1 / (1 + np.exp(-self.bias))
        at = {v: k for k, v in enumerate(self.voters)}
        z = self.bias + sum(self.weights[at[v]] for v in fired) + float(shape(hits, words) @ self.weights[len(self.voters) :])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def shape(hits: int, words: int) -> np.ndarray:
    return np.array([hits >= 2, hits >= 3, min(hits, 8) / 8, min(1.0, 20 * hits / max(words, 1))], float)


def label_model(fires: np.ndarray, given: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of the positive class for each row.

    fires: rows x voters, 0 or 1; given: the label of each row, which is one
    more voter and known to be right no better than any.  EM from the voters'
    agreement: a row starts as positive as far as more than one speak for it.
    Each round estimates from the posteriors how often each voter fires on
    either class (its accuracy) and how voters go together inside the classes;
    a voter's say is divided by one plus its positive correlations with the
    others.  The label is no word of the text and shares its say with none; no
    round looks at it in any other way.
    """
    say = np.hstack([fires, given[:, None]])
    many = say.sum(1)
    p = np.select([many >= 3, many == 2, many == 1], [0.95, 0.8, 0.2], 0.02)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        rate1, rate0 = (p @ say + 0.5) / (p.sum() + 1), ((1 - p) @ say + 0.05) / ((1 - p).sum() + 1)
        left = say - np.outer(p, rate1) - np.outer(1 - p, rate0)
        spread = np.sqrt((left**2).mean(0)) + 1e-9
        corr = (left.T @ left) / len(left) / np.outer(spread, spread)
        share = 1 / np.maximum(np.where(corr > 0.1, corr, 0).sum(0), 1)
        share[-1] = 1
        on, off = share * np.log(rate1 / rate0), share * np.log((1 - rate1) / (1 - rate0))
        z = np.log(prior / (1 - prior)) + say @ on + (1 - say) @ off
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-4:
            break
    return p


def linear_fit(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - target) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits a model on at most `sample_rows` rows of (id, text, label 0/1),
    chosen by a hash of the id.  Without rows of both classes the model gives
    the share of positive labels (0 without rows) as every score."""
    base = rows.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"), (F.col(label) > 0).cast("int").alias("y"))
    n = base.count()
    if n > sample_rows:  # keeps the smallest hashes; a few rows more or less than the bound times 0.98
        edge = int(-(2**63) + 2**64 * 0.98 * sample_rows / n)
        base = base.where(F.xxhash64("id", F.lit(11)) < edge)
    base = durable(base)  # read three times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words, starts = features(t.as_py())
                (pos if y else neg).update(set(words) | starts)
        yield from _counted(pos, neg)

    def _counted(pos: Counter, neg: Counter) -> Iterator[pa.RecordBatch]:
        keys = list(pos | neg)
        cols = [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["f", "pos", "neg"])

    sums = base.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    classes = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        rate = min(max(n1 / max(n1 + n0, 1), 1e-9), 1 - 1e-9)
        return Model([], np.zeros(0), float(np.log(rate / (1 - rate))))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    top = sums.where(F.col("pos") >= max(MIN_HITS, HIT_SHARE * n1)).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc("odds"), F.desc("pos"), "f").limit(MAX_VOTERS)
    voters = [r["f"] for r in top.collect()]
    lexicon = frozenset(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [votes(t.as_py(), lexicon) for t in b.column(1)]
            cols = [b.column(2), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "fired", "hits", "words"])

    seen = base.mapInArrow(vote, "y int, fired array<string>, hits long, words long").collect()  # at most the sample
    at = {v: k for k, v in enumerate(voters)}
    fires = np.zeros((len(seen), len(voters)))
    for k, r in enumerate(seen):
        fires[k, [at[v] for v in r["fired"]]] = 1
    given = np.array([r["y"] for r in seen], float)
    shapes = np.array([shape(r["hits"], r["words"]) for r in seen])
    weights, bias = linear_fit(np.hstack([fires, shapes]), label_model(fires, given))
    return Model(voters, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= threshold) to every row.
    A null or empty text has no vote and gets the score of such texts."""
    lexicon = frozenset(model.voters)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(*votes(t.as_py(), lexicon)) for t in b.column(b.num_columns - 1)]
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            more = [pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*kept, "score", "predicted"])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("score", "double").add("predicted", "integer")
    return spread(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(fresh("text", kept)))).mapInArrow(run, schema)
