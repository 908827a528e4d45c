"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of its words and of their beginnings, so that inflected forms of a stem
share a feature.  Logistic regression with an L1 penalty is fitted on a bounded sample of
labelled texts.  In every sampled text that names a group of people, the name is swapped
for the other names of its kind and for a neutral word; the squared change of the score
under these swaps is a further penalty, so that the classifier can't hold the mention of a
group for toxic because toxic texts mention it more often.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chainloom.llm import common

# The bounded sample: at most so many labelled rows of each class.
SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 6000
# A feature must be in so many sampled texts, and be among so many that differ most by class.
LEAST_TEXTS = 4
FEATURES = 6000
L1 = 4e-4
L2 = 1e-4
COUNTERFACTUAL = 5.0
STEPS = 250
SWAPS = 4
THRESHOLD = 0.3
MEMO = 300_000

# Names of groups of people by kind and language; the first of each row is
# the neutral word of the kind.
IDENTITIES = """
people women men girls boys females males
person woman man girl boy female male
believers christians muslims jews hindus buddhists atheists catholics
believer christian muslim jew hindu buddhist atheist catholic
citizens immigrants refugees foreigners migrants natives
citizen immigrant refugee foreigner migrant native
couples gays lesbians heterosexuals bisexuals
partner gay lesbian straight heterosexual bisexual transgender queer
human black white asian hispanic african european arab latino
neighbours mexicans chinese indians germans french spaniards turks russians poles
patients disabled blind deaf autistic
leute frauen männer mädchen jungen
gläubige christen muslime juden hindus buddhisten atheisten
bürger einwanderer flüchtlinge ausländer migranten
gens femmes hommes filles garçons
croyants chrétiens musulmans juifs hindous bouddhistes athées
citoyens immigrés réfugiés étrangers migrants
gente mujeres hombres chicas chicos
creyentes cristianos musulmanes judíos hindúes budistas ateos
ciudadanos inmigrantes refugiados extranjeros migrantes
"""

WORD = re.compile(r"[^\W_]+")


def kinds() -> dict[str, list[str]]:
    """For each name the words it is swapped for."""
    out: dict[str, list[str]] = {}
    for line in IDENTITIES.split("\n"):
        names = line.split()
        for i, name in enumerate(names):
            out.setdefault(name, names[:1] * (i > 0) + [n for n in names[i + 1:] + names[1:i] if n != name])
    return out


def words(text: str) -> set[str]:
    return set(WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()))


def features(word: str) -> list[int]:
    """The word itself and its beginnings of three to seven letters."""
    data = [f"={word}"] + [word[:k] for k in range(3, min(len(word), 7) + 1)]
    return [zlib.crc32(d.encode("utf-8", "surrogatepass")) for d in data]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]


def fit(texts: list[str], labels: np.ndarray, importance: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Minimises weighted log loss + L1 + L2 + the counterfactual penalty by accelerated
    proximal gradient steps."""
    memo: dict[str, list[int]] = {}
    swaps = kinds()
    rows, named = [], []
    for text in texts:
        found = words(text)
        ids: set[int] = set()
        if len(memo) > MEMO // 3:
            memo = {}
        for word in found:
            if word not in memo:
                memo[word] = features(word)
            ids.update(memo[word])
        rows.append(np.fromiter(ids, np.uint32, len(ids)))
        named.append(sorted(found.intersection(swaps)))
    importance = importance / importance.sum()
    del memo
    share = importance * len(rows)
    names = np.unique(np.concatenate(rows))
    # A text at a time, so that no array is as long as all features of all texts but one of each.
    places = [np.searchsorted(names, r).astype(np.int32) for r in rows]
    by_class, texts_with = [np.zeros(len(names)), np.zeros(len(names))], np.zeros(len(names), np.int64)
    for i, own in enumerate(places):
        by_class[int(labels[i])][own] += share[i]
        texts_with[own] += 1
    by_class = [total / max(share[labels == c].sum(), 1e-9) for c, total in enumerate(by_class)]
    spread = np.sqrt((by_class[0] + by_class[1] + 2 / len(rows)) / 2)
    contrast = np.where(texts_with >= LEAST_TEXTS, np.abs(by_class[1] - by_class[0]) / spread, -1)
    kept = np.zeros(len(names), bool)
    kept[np.argsort(-contrast, kind="stable")[:FEATURES]] = True
    kept &= contrast >= 0
    kept[np.searchsorted(names, np.intersect1d(names, [f for n in swaps for f in features(n)]))] = True
    place = np.cumsum(kept) - 1
    places = [place[own[kept[own]]] for own in places]
    col, row = np.concatenate(places), np.repeat(np.arange(len(rows)), [len(own) for own in places])
    n_rows = len(rows)
    del places, rows
    width = int(kept.sum())
    slot = {int(f): i for i, f in enumerate(names[kept])}

    # A row for each swap: the features that come less those that go.
    d_row, d_col, d_value, n_swaps = [], [], [], 0
    for own in named:
        for name in own:
            for other in swaps[name][:SWAPS]:
                change: dict[int, float] = {}
                for word, sign in ((other, 1.0), (name, -1.0)):
                    for f in features(word):
                        if f in slot:
                            change[slot[f]] = change.get(slot[f], 0.0) + sign
                change = {k: v for k, v in change.items() if v}
                d_row += [n_swaps] * len(change)
                d_col += change.keys()
                d_value += change.values()
                n_swaps += 1
    d_row, d_col, d_value = np.array(d_row, np.int64), np.array(d_col, np.int64), np.array(d_value)

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = bias + np.bincount(row, weights=w[col], minlength=n_rows)
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.bincount(col, weights=error[row], minlength=width) + L2 * w
        if n_swaps:
            moved = np.bincount(d_row, weights=d_value * w[d_col], minlength=n_swaps)
            g += counterfactual / n_swaps * np.bincount(d_col, weights=d_value * moved[d_row], minlength=width)
        return g, float(error.sum())

    # The largest curvature, by power iteration.
    v, top = np.ones(width + 1) / np.sqrt(width + 1), 1.0
    for _ in range(20):
        z = v[-1] + np.bincount(row, weights=v[col], minlength=n_rows)
        z *= importance / 4
        u = np.r_[np.bincount(col, weights=z[row], minlength=width), z.sum()]
        if n_swaps:
            moved = np.bincount(d_row, weights=d_value * v[d_col], minlength=n_swaps)
            u[:-1] += counterfactual / n_swaps * np.bincount(d_col, weights=d_value * moved[d_row], minlength=width)
        top = max(float(np.linalg.norm(u)), 1e-12)
        v = u / top
    step = 1 / (1.1 * top + L2)
    rate = float((importance * labels).sum())
    bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    w, ahead_w, ahead_b, t = np.zeros(width), np.zeros(width), bias, 1.0
    for _ in range(STEPS):
        g, gb = gradient(ahead_w, ahead_b)
        new = ahead_w - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = ahead_b - step * gb
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - bias)
        w, bias, t = new, new_b, t_next
    return Model(bias, {int(f): float(x) for f, x in zip(names[kept], w) if x})


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL) -> Model | None:
    """Model of the labelled rows outside the held-out fold; None without both classes.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  Rows with a null are not
    used; of several labels of one id the larger counts; equal texts are used once.  The
    rows are the first ``SAMPLE_*`` of each class in the order of a hash, each weighted by
    its class' share among all labels, and one task fits the model on them.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~common.held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = usable.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(usable.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids, so they can be broadcast.
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, int] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                rows[text] = max(label, rows.get(text, 0))
        texts = sorted(rows)
        y = np.array([rows[t] for t in texts])
        if len(set(y.tolist())) < 2:
            return
        weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
        model = fit(texts, y, weight, counterfactual)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *model.weights], pa.int64()), pa.array([model.bias, *model.weights.values()], pa.float64())], ["feature", "weight"]
        )

    fitted = sample.select("text", "toxic").repartition(1)
    parts = {r["feature"]: r["weight"] for r in fitted.mapInArrow(fit_all, "feature bigint, weight double").collect()}
    if not parts:
        return None
    return Model(parts.pop(-1), parts)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def score(self, text: str) -> float:
        if len(self.memo) > MEMO:
            self.memo = {}
        found = words(text)
        weights = self.model.weights
        for word in found.difference(self.memo):
            self.memo[word] = tuple(f for f in features(word) if f in weights)
        active = set().union(*map(self.memo.__getitem__, found))
        z = self.model.bias + sum(weights[f] for f in sorted(active))
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def with_score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1 of their whole text.

    A null text counts as empty and has the score of a text without any known word.
    Without a model the score is 0.  Equal texts score alike, an empty table stays empty,
    and a column named ``out`` is replaced.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            yield pa.array([float(scorer.score(t)) if scorer else 0.0 for t in batch.to_pylist()], pa.float64())

    return df.withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))
