"""Toxicity by a counterfactual-regularised classifier.

Features are words and word beginnings (so that inflected forms count together) present in a text. Those whose share differs between toxic and other labelled texts by more than chance
are kept, and a logistic regression is fitted on them. Each labelled text that names an identity group gets a counterfactual:
every identity term is swapped for another of its kind. The fit penalises the squared change of the score between
the two, so that a group's name by itself does not move it; identity terms always stay among the features for that.

Only a bounded sample of labelled rows (``SAMPLE``, in the order of a hash of the doc_id) is learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut_lineage

#: Most labelled rows learned from, most words kept, least |z| and texts of a word, strength of ridge and of the counterfactual penalty.
SAMPLE, WORDS, LEAST_Z, LEAST_TEXTS, RIDGE, FAIRNESS = 20_000, 512, 4.5, 5, 0.05, 20.0

#: Names of groups, by kind. A swap stays inside a kind.
IDENTITY = {
    "faith": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    "faiths": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    "person": ["woman", "man", "girl", "boy"],
    "people": ["women", "men", "girls", "boys"],
    "origin": ["african", "american", "arab", "asian", "european", "mexican", "chinese", "indian", "turkish", "russian"],
    "colour": ["black", "white", "brown"],
    "love": ["gay", "lesbian", "straight", "bisexual", "queer", "transgender"],
    "stay": ["immigrants", "refugees", "foreigners", "natives"],
    "body": ["blind", "deaf", "disabled", "autistic"],
}
_NEXT = {w.encode(): kind[(i + 1) % len(kind)].encode() for kind in IDENTITY.values() for i, w in enumerate(kind)}
#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes above 127 stay.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: str | None) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) if text else set()


def features(whole: set[bytes]) -> set[bytes]:
    """The words and, marked by ^, their first four and five bytes."""
    return whole.union([b"^" + w[:4] for w in whole], [b"^" + w[:5] for w in whole])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows that are not held out. Several labels of a document: the largest."""
    known = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` narrow rows


def _counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, n): texts with the word, counted per batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen.update((w, toxic) for w in features(words(text)) if len(w) <= 64)
            yield pd.DataFrame([(w, int(t), n) for (w, t), n in seen.items()], columns=["word", "toxic", "n"])

    return sample.mapInPandas(run, "word binary, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def _chosen(counts: DataFrame, n: dict[int, int]) -> list[bytes]:
    """Words whose shares differ, by a two-proportion z; at most WORDS of them, and all identity terms."""
    per = counts.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"),
                                     F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"))
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    p = (F.col("c1") + F.col("c0")) / F.lit(n1 + n0)
    z = (F.col("c1") / F.lit(n1) - F.col("c0") / F.lit(n0)) / F.sqrt(p * (1 - p) * F.lit(1 / n1 + 1 / n0))
    strong = (per.filter(F.col("c1") + F.col("c0") >= LEAST_TEXTS).filter(p < 1).withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z)
              .orderBy(F.desc("z"), "word").limit(WORDS))
    return list(dict.fromkeys([bytes(r["word"]) for r in strong.select("word").collect()] + sorted(features(set(_NEXT)))))


def fit(x: np.ndarray, swapped: np.ndarray, y: np.ndarray, ridge: float = RIDGE, fairness: float = FAIRNESS, steps: int = 25) -> np.ndarray:
    """Weights and, last, the intercept by Newton steps.

    Minimises the log loss of all rows, ridge * |w|^2 / 2 and, over the rows whose counterfactual differs, the mean squared
    change of the linear score times fairness * rows / 2.
    """
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    gap = (x.astype(np.float64) - swapped)[(x != swapped).any(axis=1)]
    keep = np.eye(d + 1) * ridge
    keep[d, d] = 1e-6
    if len(gap):
        keep[:d, :d] += fairness * n / len(gap) * (gap.T @ gap)
    w = np.zeros(d + 1)
    p = (y.sum() + 0.5) / (n + 1.0)
    w[d] = np.log(p / (1 - p))
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * np.maximum(s * (1 - s), 1e-6)[:, None]) + keep, x1.T @ (s - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[dict[bytes, float], float]:
    """Word weights and intercept. Without labelled rows of both kinds the score is their smoothed share."""
    sample = cut_lineage(_sample(docs, labels, most))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        p = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1.0)
        return {}, float(np.log(p / (1 - p)))
    chosen = _chosen(_counts(sample), n)
    place = {w: i for i, w in enumerate(chosen)}

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                whole = words(text)
                sides = (features(whole) & place.keys(), features({_NEXT.get(w, w) for w in whole}) & place.keys())
                rows.append((*(sorted(place[f] for f in side) for side in sides), toxic))
            yield pd.DataFrame(rows, columns=["hits", "swapped", "toxic"])

    rows = sample.mapInPandas(found, "hits array<int>, swapped array<int>, toxic int")

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.loc[sorted(batch.index, key=lambda i: (*batch["hits"][i], -1, batch["toxic"][i]))]  # sums in one order, whatever the tasks
        x, s = np.zeros((len(batch), len(chosen)), np.float32), np.zeros((len(batch), len(chosen)), np.float32)
        for m, column in ((x, batch["hits"]), (s, batch["swapped"])):
            for i, at in enumerate(column):
                m[i, np.asarray(at, int)] = 1
        return pd.DataFrame({"w": [fit(x, s, batch["toxic"].to_numpy(float)).tolist()]})

    solved = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(solve, "w array<double>").first()["w"]  # at most ``most`` rows
    return {w: v for w, v in zip(chosen, solved[:-1], strict=True) if v}, solved[-1]


def scorer(weights: dict[bytes, float], intercept: float):
    """A pandas UDF: text to score between 0 and 1 (null and empty texts get the intercept)."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        keys = weights.keys()
        line = np.array([intercept + sum(weights[w] for w in sorted(features(words(t)) & keys)) for t in text], float)
        return pd.Series(1 / (1 + np.exp(-line)))

    return score


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1). Every row is scored by its whole text alone; repeated rows score alike.

    Null and empty texts get the intercept; an empty table stays empty. A column ``toxicity`` of the input is replaced, other columns stay.
    Words of more than 64 bytes are no features, and the ``WORDS`` strongest words are: both bound the model, not the texts.
    """
    return docs.withColumn("toxicity", scorer(*train(docs, labels, most))(F.col("text")))
