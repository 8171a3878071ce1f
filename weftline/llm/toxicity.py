"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its lower-cased words, of their beginnings (stems take many endings, most of them
seen in no label), of neighbouring pairs, and of pairs with one word between them, counted.  A text is judged by its windows of ``window`` words (half overlapping): its score is the highest of its
windows', so that a few words in a long text weigh as in a short one.

Training reads at most ``sample_docs`` labelled documents (half for either label, those with the smallest hashes of
their ids; equal texts once).  They are dealt to ``shards`` shards.  In each round a shard runs FTRL, with per-coordinate
rates and L1 sparsity, over its documents in order of their hash, in a task of its own, from the common state on; what
the shards added to the state (z and n are sums) is added up for the next round.  The first round learns from whole
texts, later ones from the window that scores highest so far.  The weights that L1 leaves are broadcast.  One more shard is not learnt from: slope and shift of the log odds are fitted to
its labels, so that a score is a probability for texts that the model has not seen.  Where the bound leaves out labels of
one kind more than of the other, the log odds are moved back to the ratio of all labels, so that the number of labels
taken changes how well texts are told apart, but not how many are called toxic.

Defined results: texts without words (null, empty) get the bias alone; with no labels, or labels of one kind only, all
scores are 0 and nothing is predicted toxic; rows with a null label or text are not learnt from; of the tables only the
id, text and label columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised

WORD = re.compile(r"\w+")
MICRO = 1_000_000


#: Code points of the beginnings of words that are features beside the words: stems that take many endings.
STEMS = (4, 5, 6)
#: How many words a feature of each kind reaches beyond its first.
LAGS = (0, *(0 for _ in STEMS), 1, 2)


def features(text: str | None, bits: int) -> tuple[np.ndarray, ...]:
    """The buckets of words, of their beginnings, of neighbouring pairs and pairs with a gap, each by the place of its first word."""
    import xxhash

    words = WORD.findall((text or "").lower())
    code = xxhash.xxh32_intdigest
    h = np.array([code(w) for w in words], np.uint64)
    fold = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    stems = [fold(np.array([code(w[:n]) for w in words], np.uint64) * np.uint64(8191) + np.uint64(n)) for n in STEMS]
    return fold(h), *stems, fold(h[:-1] * np.uint64(31) + h[1:]), fold(h[:-2] * np.uint64(127) + h[2:] + np.uint64(1))


def window_sums(grams: tuple[np.ndarray, ...], weights: np.ndarray, window: int) -> np.ndarray:
    """The sum of the weights in each window of words; one window if there are fewer words."""
    n = len(grams[0])
    starts = np.arange(0, max(1, n - window // 2), window // 2)
    total = np.zeros(len(starts))
    for lag, x in zip(LAGS, grams, strict=True):
        running = np.append(0.0, np.cumsum(weights[x]))
        ends = np.minimum(starts + window - lag, len(x))
        total += running[np.maximum(ends, 0)] - running[np.minimum(starts, len(x))] * (ends >= starts) - running[np.maximum(ends, 0)] * (ends < starts)
    return total


class Ftrl:
    """The last coordinate is the bias, which L1 does not shrink."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray, is_bias: np.ndarray) -> np.ndarray:
        l1 = np.where(is_bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n, np.arange(len(self.z)) == len(self.z) - 1)

    def learn(self, k: np.ndarray, count: np.ndarray, y: int) -> None:
        z, n = self.z[k], self.n[k]
        w = self._weights(z, n, k == len(self.z) - 1)
        margin = float(np.clip(w @ count, -30, 30))
        g = (1 / (1 + math.exp(-margin)) - y) * count
        self.z[k] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[k] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 6_000, shards: int = 4, rounds: int = 8, window: int = 24, bits: int = 20, alpha: float = 0.5, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias.

    The labelled ids are chosen first and their texts looked up by a broadcast of these ids: no text is shuffled but
    those that are learnt from.  What reaches the driver is bounded by the sample and by ``bits``.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    there = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_docs // 2) for y in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.xxhash64(F.col(text)).alias("h")).where(F.col("body").isNotNull())
    sample = rows.join(F.broadcast(halves[0].unionByName(halves[1])), "id").groupBy("h", "y").agg(F.min("body").alias("body"))
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards + 1)))
    dealt = materialised(dealt.repartition(shards + 1, "shard"))
    if dealt.select("y").distinct().count() < 2:
        return np.zeros(0, np.int64), np.zeros(0), float("-inf")
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for turn in range(rounds):
        known_k = np.flatnonzero((z != 0) | (n != 0))
        shared = docs.sparkSession.sparkContext.broadcast((known_k, z[known_k], n[known_k]))

        def trained(pdf: pd.DataFrame) -> pd.DataFrame:
            z0, n0 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
            at, z0[at], n0[at] = shared.value  # noqa: B023
            m = Ftrl(z0.copy(), n0.copy(), alpha, beta, l1, l2)
            w0 = m.weights()[:-1]  # windows are chosen by the common state
            for body, y in pdf.sort_values("h")[["body", "y"]].itertuples(index=False):
                grams = features(body, bits)
                if turn and len(grams[0]) > window:  # noqa: B023
                    at = int(np.argmax(window_sums(grams, w0, window))) * (window // 2)
                    grams = tuple(x[at : max(at, at + window - lag)] for lag, x in zip(LAGS, grams, strict=True))
                k, count = np.unique(np.concatenate(grams).astype(np.int64), return_counts=True)
                count = count if turn else np.ones(len(k))  # noqa: B023
                m.learn(np.append(k, 1 << bits), np.append(count, 1.0), y)
            k = np.flatnonzero(m.n != n0)
            whole = lambda x: np.rint(x * MICRO).astype(np.int64)
            return pd.DataFrame({"k": k, "z": whole(m.z[k] - z0[k]), "n": whole(m.n[k] - n0[k])})

        added = dealt.where(F.col("shard") < shards).groupBy("shard").applyInPandas(trained, "k long, z long, n long")
        got = added.groupBy("k").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        shared.destroy()  # its copies on the executors' disks go before the next round makes more
        k = got["k"].to_numpy()
        z[k] += got["z"].to_numpy() / MICRO / shards
        n[k] += got["n"].to_numpy() / MICRO / shards
    w = Ftrl(z, n, alpha, beta, l1, l2).weights()
    k = np.flatnonzero(w[:-1])
    model = k, w[k], float(w[-1])
    told = dealt.where(F.col("shard") == shards).select("y", scores(F.col("body"), model, docs.sparkSession, window=window, bits=bits).alias("p")).toPandas()
    slope, shift = calibrated(told["p"].to_numpy(), told["y"].to_numpy(float))
    # where one half takes a smaller share of its labels than the other, the sample's odds are not the labels'
    taken = {y: min(n, sample_docs // 2) / n for y, n in there.items()}
    return k, w[k] * slope, float(w[-1]) * slope + shift + math.log(taken[0] / taken[1])


def calibrated(p: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and shift of the log odds that make scores of documents not learnt from match their labels."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1)
    at = np.array([1.0, 0.0])
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    loss = lambda at: np.logaddexp(0, x @ at).sum() - y @ (x @ at) + ((at - [1.0, 0.0]) ** 2).sum() / 2
    for _ in range(steps):  # Newton's method; a prior of unit weight holds it near slope 1, shift 0
        q = 1 / (1 + np.exp(-np.clip(x @ at, -700, 700)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (y - q) - (at - [1.0, 0.0]))
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-9:  # a whole step may lead away
            step = step / 2
        at = at + step
    return max(float(at[0]), 0.1), float(at[1])


def scores(text: Column, model: tuple[np.ndarray, np.ndarray, float], spark, *, window: int = 24, bits: int = 20) -> Column:
    """The score of each whole text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        k, w, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[k] = w
        for texts in batches:
            top = np.array([window_sums(features(t, bits), weights, window).max() for t in texts], float)
            yield pd.Series(np.where(np.isfinite(bias), 1 / (1 + np.exp(-np.clip(top + bias, -700, 700))), 0.0))

    return score(text)
