"""Quality of a text by hashed word n-grams and logistic regression, trained online with follow-the-regularised-leader updates.

Words are runs of letters and digits and runs of other visible characters, so ``word!!`` gives two. Words and pairs of neighbours are hashed
into ``1 << BITS`` weights, and words equal to one of the two before them into a weight for each distance; the value of a weight's feature is its share of the text's n-grams. A score is one sparse dot product: the mean
of the weights that the text hits, times ``SCALE``, plus the bias, through the logistic function.

Training takes at most ``MAX_ROWS`` labelled rows (those with the smallest hash of the id; their ids are the only rows that are broadcast),
turned into features where they lie and streamed in hash order through one task that holds the features of the bounded sample. Each step
updates, for the weights hit, the sum of gradients z and of squared gradients n; the weights follow from both in closed form with L1 and L2 terms.

Null and empty texts have no n-grams: their score is the logistic of the bias. Repeated rows get the same score; an id that is labelled
repeatedly counts once, with its largest label. Without labels every score is 0.5. A null id is never learned from and counts as held out.
An empty table gives no rows. Columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm import textvec
from stageflow.llm.common import remainder, table

BITS = 18
SCALE = 40.0
#: Bound on the labelled rows that are learned from.
MAX_ROWS = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.1, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3
_ROWS = 256


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def hits(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(weight, index of the text) of every word and pair of words."""
    w = textvec.words(texts, "both", fold=False)
    pairs, at = w.grams(2)
    shift = np.uint64(64 - BITS)
    at_, owner = [w.hash >> shift, pairs >> shift], [w.text, w.text[at]]
    for k in (1, 2):  # a word that is the one k places before it: one n-gram for all words
        same = np.flatnonzero((w.hash[k:] == w.hash[:-k]) & (w.text[k:] == w.text[:-k]))
        at_.append(np.full(len(same), k, np.uint64))
        owner.append(w.text[same])
    return np.concatenate(at_).astype(np.int64), np.concatenate(owner)


def train(samples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """samples: (weights hit, values, label) in order. The last weight is the bias, hit by every sample."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, value, label in samples:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(slice(None))
    return Model(final[:-1].astype(np.float32), float(final[-1]))


def labelled_sample(labels: DataFrame, key: str, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(_key, _label) of at most ``max_rows`` ids, by the smallest hash."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_label"))
    return rows.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on a bounded sample of ``labels``; pass only rows that may be learned from."""
    sample = F.broadcast(labelled_sample(labels, key, label, max_rows))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sample, "_key").select(F.xxhash64("_key").alias("place"), "_label", "_text")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), _ROWS):
                part = frame.iloc[a : a + _ROWS]
                at, owner = hits(list(part._text))
                key = np.sort(owner * (1 << BITS) + at)
                new = np.flatnonzero(np.diff(key, prepend=-1))
                count = np.diff(np.append(new, len(key)))
                cut = np.searchsorted(key[new], np.arange(1, len(part)) << BITS)
                at = np.split((key[new] & ((1 << BITS) - 1)).astype(np.int32), cut)
                count = np.split(count.astype(np.int32), cut)
                yield pd.DataFrame({"place": part.place, "label": part._label, "at": [x.tobytes() for x in at], "n": [x.tobytes() for x in count]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples, seen = [], None
        for frame in frames:
            for place, label_, at, count in zip(frame.place, frame.label, frame["at"], frame.n, strict=True):
                if place == seen:
                    continue  # a repeated row
                seen = place
                at, count = np.frombuffer(at, np.int32), np.frombuffer(count, np.int32)
                value = SCALE * count / max(1, count.sum())
                samples.append((np.append(at, 1 << BITS), np.append(value, 1.0), label_))
        model = train(samples)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    made = rows.mapInPandas(features, "place long, label double, at binary, n binary")
    one = made.repartition(1).sortWithinPartitions("place").mapInPandas(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(one.weights, np.float32), one.bias) if one else Model(np.zeros(1 << BITS, np.float32), 0.0)


def scores(model: Model, texts: Sequence[str | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for a in range(0, len(texts), _ROWS):
        part = texts[a : a + _ROWS]
        at, owner = hits(part)
        total = np.bincount(owner, weights=model.weights[at], minlength=len(part))
        count = np.bincount(owner, minlength=len(part))
        out[a : a + _ROWS] = 1.0 / (1.0 + np.exp(-np.clip(model.bias + SCALE * total / np.maximum(count, 1), -35, 35)))
    return out


def classify(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 << BITS floats

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(scores(shared.value, list(part)))

    return docs.withColumn(name, F.pandas_udf(predict, "double")(F.col(text)))


def held_out(key: str = "doc_id"):
    return F.coalesce(remainder(F.col(key), 5) == 0, F.lit(True))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = classify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.drop("text").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
