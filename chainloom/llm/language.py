"""Language identification as inference of multilingual mixtures.

A language is a distribution over hashed character trigrams, counted over all labelled
training texts.  A document's trigrams are drawn from a mixture of languages, whose
proportions expectation-maximisation estimates.  The set of languages is chosen by
penalised likelihood: it starts with the likeliest language and takes in another one as
long as the gain in log-likelihood exceeds the penalty of one more parameter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 15
SMOOTHING = 0.5
STEPS = 12
# Trigrams overlap, so that each character counts about three times.
OVERLAP = 3.0
# Penalty of one more language: that many times the logarithm of the number of trigrams.
PENALTY = 3.0
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # buckets x languages


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of letters and single spaces for all else; none without a letter."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(32))[keep]
    mixed = points[:-2] * np.uint32(2654435761) + points[1:-1] * np.uint32(2246822519) + points[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(668265263)) >> np.uint32(17)).astype(np.int64)


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> Model | None:
    """Trigram counts of all usable rows with a language and a letter; None without any.

    Each task adds up its own rows first, so that a shuffle moves at most one row for each
    task, language and bucket."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name] += np.bincount(trigrams(body), minlength=BUCKETS)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_language = counted.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    if not per_language:
        return None
    table = np.full((BUCKETS, len(per_language)), SMOOTHING)
    for j, row in enumerate(per_language):
        table[np.array(row["at"], np.int64), j] += np.array(row["n"], np.float64)
    return Model(tuple(r["lang"] for r in per_language), np.log(table / table.sum(axis=0)).astype(np.float32))


class Batch:
    """Trigram counts of many documents, one after another."""

    def __init__(self, model: Model, grams: list[np.ndarray]):
        found = [np.unique(g, return_counts=True) for g in grams]
        self.sizes = np.array([len(f) for f, _ in found])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(grams)), self.sizes)
        self.count = np.concatenate([c for _, c in found]).astype(np.float32)
        self.total = np.add.reduceat(self.count, self.starts)
        log_p = model.log_p[np.concatenate([f for f, _ in found])]
        self.single = np.add.reduceat(log_p * self.count[:, None], self.starts, axis=0)
        self.top = log_p.max(axis=1)
        self.p = np.exp(log_p - self.top[:, None])
        self.base = np.add.reduceat(self.top * self.count, self.starts)

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some documents' trigrams, and where each document starts in them."""
        sizes = self.sizes[docs]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[docs] - starts, sizes) + np.arange(sizes.sum()), starts

    def mixture(self, docs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over the allowed languages of each document, and log-likelihoods."""
        at, starts = self.rows(docs)
        p, count = self.p[at], self.count[at]
        owner = np.repeat(np.arange(len(docs)), self.sizes[docs])
        theta = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
        for _ in range(STEPS):
            share = p * theta[owner]
            share *= (count / np.maximum(share.sum(axis=1), 1e-30))[:, None]
            theta = np.add.reduceat(share, starts, axis=0) / self.total[docs][:, None]
        inner = np.log(np.maximum((p * theta[owner]).sum(axis=1), 1e-30)) * count
        return theta, np.add.reduceat(inner, starts) + self.base[docs]


def infer(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[list[float]]]:
    """Per text: the language of the largest share, a score, and all shares."""
    n_langs = len(model.languages)
    names, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[0.0] * n_langs for _ in texts]
    grams = [trigrams(t) for t in texts]
    known = [i for i, g in enumerate(grams) if len(g)]
    if not known:
        return names, scores, shares
    batch = Batch(model, [grams[i] for i in known])
    best = batch.single.argmax(axis=1)
    everyone = np.arange(len(known))
    theta = np.zeros((len(known), n_langs), np.float32)
    theta[everyone, best] = 1
    likelihood = batch.single[everyone, best].astype(np.float64)
    penalty = PENALTY * OVERLAP * np.log(batch.total + 1)
    if n_langs > 1:
        _, all_in = batch.mixture(everyone, np.ones((len(known), n_langs), bool))
        chosen = theta > 0
        # Only a document that all languages together explain much better can need a second.
        open_docs = everyone[all_in - likelihood > penalty]
        while len(open_docs):
            options = []
            for j in range(n_langs):
                wider = chosen[open_docs].copy()
                wider[:, j] = True
                options.append(batch.mixture(open_docs, wider))
            gains = np.stack([ll for _, ll in options], axis=1) - likelihood[open_docs][:, None]
            gains[chosen[open_docs]] = -np.inf
            pick = gains.argmax(axis=1)
            taken = gains[np.arange(len(open_docs)), pick] > penalty[open_docs]
            for d, j, row in zip(open_docs[taken], pick[taken], np.flatnonzero(taken)):
                chosen[d, j] = True
                theta[d], likelihood[d] = options[j][0][row], options[j][1][row]
            open_docs = open_docs[taken]
            open_docs = open_docs[~chosen[open_docs].all(axis=1)]
    relative = (batch.single - batch.single.max(axis=1, keepdims=True)) / OVERLAP
    posterior = np.exp(relative)
    posterior /= posterior.sum(axis=1, keepdims=True)
    answer = theta.argmax(axis=1)
    # One language: how surely it is this one.  Several: the share of the largest.
    alone = (theta > 0).sum(axis=1) == 1
    score = np.where(alone, posterior[everyone, answer], theta[everyone, answer])
    for row, i in enumerate(known):
        names[i], scores[i], shares[i] = model.languages[answer[row]], float(score[row]), theta[row].tolist()
    return names, scores, shares


def groups(texts: list[str], chars: int = 400_000) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def with_language(df: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """The rows with a struct ``out`` of ``pred``, ``score`` and ``shares`` (of the model's
    languages in order).

    ``und`` with score 0 stands for a null text, one without a letter, or no model.  Equal
    texts have equal results, ties go to the language first in order, an empty table stays
    empty, and a column named ``out`` is replaced.
    """

    @F.arrow_udf("struct<pred:string,score:double,shares:array<float>>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores, shares = [], [], []
            for group in groups(batch.to_pylist()):
                a, b, c = infer(model, group) if model is not None else ([UNKNOWN] * len(group), [0.0] * len(group), [[] for _ in group])
                names += a
                scores += b
                shares += c
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float32()))], ["pred", "score", "shares"]
            )

    # Declared so, a later filter on the result stays above it and it runs once.
    return df.withColumn(out, predicted.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
