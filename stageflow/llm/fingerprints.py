"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (white space between them, A-Z lower-cased), weighted by their counts. For each of ``SAMPLES`` samples and each
term, two gamma variates of shape 2 (r, c) and a uniform one (b) follow from a hash of the term alone. With t = floor(ln w / r + b), the
sample takes the term with the least c exp(-r (t - b) - r), in single precision, and keeps a 16-bit hash of the term and t. Two texts keep the same
in a sample with the probability of their generalised Jaccard similarity: the sum over terms of the lesser count, by that of the greater. So
the share of equal samples (``likeness``) estimates it, with a standard deviation of at most 0.5 / sqrt(SAMPLES).

A fingerprint is the samples in hexadecimal; equal texts have equal ones. Texts without a word (null, empty, blank) have the empty one, which
is alike only to itself.

``edited`` meets each document with the next by ascending (doc_id, digest of the text), null ids first; after the last comes the first, which may be
the same one. Only ids and digests are sorted over the whole table; cut points of that order deal the texts to ranges, the first document of a
range goes to the range before as well, and a task reads its ranges in order. Rows with equal id and text follow each other, so
repeated rows are defined as a whole. Other columns are not read; an empty table gives no rows. The digest is 64 bits and only orders rows
of the same id.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stageflow.llm.common import materialize, table
from stageflow.llm.textvec import _powers, mix

SAMPLES = 128
#: Least rows of a range, and most ranges; characters of text, and terms, sampled at once.
RANGE, RANGES, STEP, TERMS = 1024, 1 << 16, 1 << 21, 1 << 14
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _term_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    up, down = _powers(1 << max(int(len(data)).bit_length(), 16))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        first = np.concatenate([[0], end[:-1]]).astype(np.int64)
        return mix((total[end] - total[first]) * down[first])


def _mixed(h: np.ndarray, number: int) -> np.ndarray:
    """32-bit hash of the upper and lower half of 64-bit hashes, another one for each number."""
    factor = np.uint32(int(mix(np.array([number + 1], np.uint64))[0]) >> 32 | 1)
    with np.errstate(over="ignore"):
        x = h[1] * factor + h[0]
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 from the upper 24 bits."""
    return ((x >> np.uint32(8)).view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def draws(terms: np.ndarray, log_weights: np.ndarray, sample: int) -> np.ndarray:
    """What each weighted term offers to a sample, as numbers whose least wins: the order of c exp(-r (t - b) - r) in single precision, and
    below it 16 bits of the hash of (term, t). terms: halves of the hashes, in two rows."""
    x = [_mixed(terms, 5 * sample + k) for k in range(5)]
    r, b = -np.log(_uniform(x[0]) * _uniform(x[1])), _uniform(x[4])
    t = np.floor(log_weights / r + b)
    value = np.log(-np.log(_uniform(x[2]) * _uniform(x[3]))) - r * (t - b + np.float32(1))
    bits = value.view(np.int32)
    order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.uint32) ^ np.uint32(1 << 31)
    with np.errstate(over="ignore"):
        kept = _mixed(np.stack([x[4], t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)]), 5 * sample) >> np.uint32(16)
    return order.astype(np.uint64) << np.uint64(16) | kept


def signatures(texts: list[str], samples: int = SAMPLES) -> list[np.ndarray]:
    """16-bit samples of each text; none for a text without words."""
    number: dict[tuple[bytes, int], int] = {}
    index, size = [], []
    for text in texts:
        counts = Counter(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
        index.extend([number.setdefault(term, len(number)) for term in counts.items()])
        size.append(len(counts))
    out = np.zeros((len(texts), samples), "<u2")
    at, count = np.array(index, np.int64), np.array(size, np.int64)
    full = np.flatnonzero(count)
    if len(full):
        hashes = _term_hashes([w for w, _ in number])
        terms = np.stack([hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        weights = np.log(np.array([n for _, n in number], np.float32))
        first = (np.cumsum(count) - count)[full]
        offers = np.empty(len(weights), np.uint64)
        for k in range(samples):
            for a in range(0, len(weights), TERMS):  # what a step computes stays in the cache
                offers[a : a + TERMS] = draws(terms[:, a : a + TERMS], weights[a : a + TERMS], k)
            out[full, k] = np.minimum.reduceat(offers[at], first) & np.uint64(0xFFFF)
    return [row if n else row[:0] for row, n in zip(out, size, strict=True)]


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def fingerprints(df: DataFrame, text_col: str = "text", name: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """Adds the fingerprint of a text column."""

    @F.pandas_udf("string")
    def signed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found: list[str] = []
            for group in _groups(texts.fillna("").tolist()):
                found += [text_of(s) for s in signatures(group, samples)]
            yield pd.Series(found, dtype=object)

    return df.withColumn(name, signed(F.col(text_col)))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n > STEP:
            yield held
            held, n = [], 0
    if held:
        yield held


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_ranges(docs: DataFrame, rows: int = RANGE) -> DataFrame:
    """(range, guest, has, doc_id, h, text): documents dealt to ranges of the order of (doc_id, h). The first document of a range comes as a guest
    at the end of the one before, that of the first range at the end of the last."""
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = key.withColumn("has", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    order = ["has", "doc_id", "h"]
    narrow = materialize(key.select(*order).distinct().repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "print-order")
    rows = max(rows, -(-narrow.count() // RANGES))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    cuts = narrow.withColumn("_at", place).where(F.col("_at") % rows == 0).select(*order)
    kinds = [("has", "?"), ("doc_id", "<i8"), ("h", "<i8")]
    bounds = np.array(sorted(map(tuple, cuts.collect())), dtype=kinds)  # 17 bytes a range; a partition adds one range at most
    sent = docs.sparkSession.sparkContext.broadcast(bounds)
    n = len(bounds)

    @F.pandas_udf("int")
    def range_of(has: pd.Series, doc_id: pd.Series, h: pd.Series) -> pd.Series:
        rows_ = np.empty(len(h), sent.value.dtype)
        rows_["has"], rows_["doc_id"], rows_["h"] = has, doc_id, h
        at = np.searchsorted(sent.value, rows_, "right") - 1
        first = sent.value[np.maximum(at, 0)] == rows_
        return pd.Series(np.where(first, -at - 1, at).astype(np.int32))  # negative: the first of its range

    at = key.withColumn("_at", range_of(*order))
    own = F.when(F.col("_at") < 0, -F.col("_at") - 1).otherwise(F.col("_at"))
    guest = F.struct(F.pmod(own - 1, F.lit(max(n, 1))).alias("range"), F.lit(True).alias("guest"))
    home = F.struct(own.alias("range"), F.lit(False).alias("guest"))
    dealt = at.withColumn("_to", F.explode(F.when(F.col("_at") < 0, F.array(home, guest)).otherwise(F.array(home))))
    return dealt.select("_to.range", "_to.guest", *order, "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, samples: int = SAMPLES, rows: int = RANGE) -> DataFrame:
    """One row a document, as in ``EDITED``: its fingerprint, that of its edited text, and their likeness to it and to the next document."""
    dealt = in_ranges(docs, rows)
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", "has", "doc_id", "h")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # rows of a step; the first is the one that still waits for its next
        n = 0
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                held.append(row)
                n += len(row[5])
                if n > STEP:
                    yield _compared(held, samples)
                    held, n = held[-1:], len(held[-1][5])
        if held:
            yield _compared(held, samples)

    return ordered.mapInPandas(compare, EDITED)


def _compared(held: list[tuple], samples: int) -> pd.DataFrame:
    """Output of consecutive rows but the last; a guest is only the next of the row before it."""
    pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i + 1][0] == held[i][0]]
    changed = [edit(held[i][5], held[i + 1][5]) for i in pairs]
    both = signatures([r[5] for r in held] + changed, samples)
    own, new = both[: len(held)], both[len(held) :]
    out = [
        (held[i][3] if held[i][2] else None, len(held[i][5]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own[i]), text_of(print_), likeness(own[i], print_), likeness(own[i], own[i + 1]))
        for i, text, print_ in zip(pairs, changed, new, strict=True)
    ]
    return pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")]).astype({"doc_id": "Int64"})


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
