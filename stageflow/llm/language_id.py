"""Language of a text by a string kernel.

The blended spectrum of a text is the set of its character n-grams of 1 to ``ORDER`` letters, folded to lower case, with every other character
as one blank. The kernel of two texts is the number of n-grams that both have, divided by the root of the product of their numbers. Texts are
compared with ``landmarks`` texts only (Nyström): the kernel of the landmarks is inverted on its large eigenvalues, and one ridge
regression a language, against the rest, is fitted on that feature map. Scoring a batch is two matrix products: presence of n-grams by
landmarks, then by languages.

n-grams are those most frequent in the fitting rows (``VOCABULARY``), found through a table of hashes; presence is one bit each, so a very long
text costs one row like any other and is read in pieces. The fitting rows are bounded (``PER_LANGUAGE`` for each language, taken by a hash of the
id) and written once as bits. The driver gets the landmarks' bits, ``landmarks`` rows or one a language if there are more languages, and sends them out; the tasks
sum the normal equations over the rows, so what comes back is ``_SUMS`` matrices of landmarks by landmarks and by languages. Its memory and the model
grow with the number of languages, not with the rows: a few megabytes for hundreds. More than 100,000 languages are refused.

A null text and a text without a letter are ``und`` with score 0. A text with no known n-gram, and ties, go to the first language in order.
Repeated rows get the same answer. A null id is never learned from and counts as held out. An empty or unlabelled table gives a model without
languages, and every text is ``und``. The columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stageflow.llm import textvec
from stageflow.llm.common import materialize, remainder, table
from stageflow.session import dictionary

ORDER = 4
VOCABULARY = 4096
LANDMARKS = 160
RIDGE = 0.3
#: Bound on the fitting rows of a language.
PER_LANGUAGE = 600
#: Partial sums of the normal equations that the driver adds up.
_SUMS = 16
#: Below this score the answer of a filter is "rejected".
MIN_SCORE = 0.15
UND = "und"
_BITS = 20
_LETTER = regex.compile(r"\p{L}")
_ROWS = 64


@dataclass(frozen=True)
class Model:
    """slots: column of each hash slot, ``VOCABULARY`` where there is none; landmarks: unit rows; weights: landmarks by languages."""

    slots: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]


@cache
def _folded() -> np.ndarray:
    """Code point in lower case, or a blank for all but letters."""
    low = textvec.lower().copy()
    low[~np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 32
    return low


def _slots_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, hash slot) of the n-grams of the texts, with repetitions, order by order and piece by piece."""
    fold = _folded()
    blank = np.zeros(0x110000, np.uint8)
    for ids, parts in textvec.batches(texts, blank):
        cp = fold[textvec.points("".join(parts))]
        owner = np.repeat(np.asarray(ids, np.int32), [len(p) for p in parts])
        first = np.flatnonzero(np.append(True, (cp[1:] != 32) | (cp[:-1] != 32) | (owner[1:] != owner[:-1]))) if len(cp) else np.empty(0, np.int64)
        cp, owner = cp[first], owner[first]  # runs of other characters are one blank
        h = np.zeros(len(cp), np.uint32)
        for k in range(ORDER):
            if k >= len(cp):
                break
            h = (h[: len(cp) - k] * np.uint32(0x01000193)) ^ (cp[k:] * np.uint32(0x85EBCA6B))
            slot = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _BITS)
            inside = owner[: len(h)] == owner[k:]  # not across the end of a text
            yield owner[: len(h)][inside], slot[inside]


def _presence(texts: list[str], slots: np.ndarray) -> np.ndarray:
    """1 where the text has the n-gram of the column; float, so that products run in BLAS."""
    width = VOCABULARY + 1
    seen = np.zeros(len(texts) * width, np.uint8)
    for owner, slot in _slots_of(texts):
        seen[owner * width + slots.take(slot)] = 1
    return seen.reshape(len(texts), width)[:, :VOCABULARY].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << _BITS, np.int64)
    for frame in frames:
        for text in frame.text:
            seen = np.zeros(1 << _BITS, bool)
            for _, slot in _slots_of([text]):
                seen[slot] = True
            total += seen
    at = np.flatnonzero(total)
    yield pd.DataFrame({"slot": at.astype(np.int64), "n": total[at]})


def fitting_rows(docs: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang) of at most about ``per_language`` rows of each language, those with a small hash of the id. One light count decides the rates."""
    named = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("_key").isNotNull())
    sizes = usable.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.join(dictionary(sizes, "language-sizes"), F.col("lang") == F.col("_lang")).where(place < F.lit(float(per_language)) / F.col("_n"))
    return chosen.where(F.col("text").rlike(r"\p{L}")).select("text", "lang")


def _landmark_rows(rows: DataFrame, languages: int, landmarks: int) -> DataFrame:
    """Rows of each language at equal steps of their order, so that every language has landmarks. A language has a bounded number of rows here."""
    order = Window.partitionBy("lang").orderBy("bits")
    numbered = rows.select("lang", "bits", (F.row_number().over(order) - 1).alias("k"), (F.count("*").over(Window.partitionBy("lang")) - 1).alias("last"))
    steps = F.least(F.lit(max(1, landmarks // languages) - 1), F.col("last"))
    step = F.ceil(F.col("k") * steps / F.greatest(F.col("last"), F.lit(1)))  # the first step at or after row k
    return numbered.where(F.when(steps == 0, F.col("k") == 0).otherwise(step * F.col("last") < (F.col("k") + 1) * steps)).select("lang", "bits")


def _rows_of(bits: list[bytes]) -> np.ndarray:
    return _unit(np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in bits]).astype(np.float32))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on a bounded sample of ``docs``; pass only rows that may be learned from."""
    chosen = fitting_rows(docs, key, text, lang)
    counts = chosen.mapInPandas(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    top = [r.slot for r in counts.orderBy(F.desc("n"), "slot").limit(VOCABULARY).collect()]
    slots = np.full(1 << _BITS, VOCABULARY, np.int16)
    slots[top] = np.arange(len(top), dtype=np.int16)

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), _ROWS):
                part = frame.iloc[a : a + _ROWS]
                seen = _presence(list(part.text), slots)
                yield pd.DataFrame({"lang": part.lang, "bits": [np.packbits(x > 0).tobytes() for x in seen]})

    rows = materialize(chosen.mapInPandas(bits, "lang string, bits binary"), "language-bits")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model(slots, np.zeros((0, VOCABULARY), np.float32), np.zeros((0, 0), np.float32), [])
    marks = _rows_of([bytes(b) for _, b in sorted((r.lang, bytes(r.bits)) for r in _landmark_rows(rows, len(languages), landmarks).collect())])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    large = values > 1e-6 * values.max()
    root = vectors[:, large] / np.sqrt(values[large])
    place = {lg: k for k, lg in enumerate(languages)}
    weight = np.array([sum(sizes.values()) / (len(languages) * sizes[lg]) for lg in languages])  # every language counts alike
    shared = docs.sparkSession.sparkContext.broadcast((marks, root, place, weight))  # landmarks x vocabulary, landmarks x landmarks

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, root, place, weight = shared.value
        square, target = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(place)))
        for frame in frames:
            for a in range(0, len(frame), _ROWS):
                part = frame.iloc[a : a + _ROWS]
                y = part.lang.map(place).to_numpy(np.int64)
                phi = (_rows_of(list(part.bits)) @ marks.T).astype(np.float64) @ root
                weighted = phi * weight[y][:, None]
                square += weighted.T @ phi
                np.add.at(target.T, y, weighted)
        yield pd.DataFrame({"square": [square.tobytes()], "target": [target.tobytes()]})

    dealt = rows.repartition(_SUMS, "bits").sortWithinPartitions("lang", "bits")  # a fixed order of additions
    square, target = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(languages)))
    for r in dealt.mapInPandas(sums, "square binary, target binary").collect():
        square += np.frombuffer(r.square).reshape(square.shape)
        target += np.frombuffer(r.target).reshape(target.shape)
    solved = np.linalg.solve(square + ridge * np.eye(root.shape[1]), target)
    return Model(slots, marks, (root @ solved).astype(np.float32), languages)


def _score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = [UND] * len(texts), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model.languages else []
    for a in range(0, len(real), _ROWS):
        part = real[a : a + _ROWS]
        kernel = _unit(_presence([texts[i] for i in part], model.slots)) @ model.landmarks.T
        f = kernel @ model.weights
        best = f.argmax(1)
        scores[part] = np.clip(f[np.arange(len(part)), best], 0, 1)
        for i, b in zip(part, best, strict=True):
            names[i] = model.languages[b]
    return names, scores


def classify(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """Adds the struct ``name`` of ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks x vocabulary

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, scores = _score(shared.value, list(part))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn(name, F.pandas_udf(predict, "lang_pred string, score double")(F.col(text)))


def held_out(key: str = "doc_id"):
    return F.coalesce(remainder(F.col(key), 4) == 2, F.lit(True))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    out = classify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, "language")
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")
