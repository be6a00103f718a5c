"""Similarity join on sets of five-word shingles, with Bayesian pruning of candidates.

Words are runs without ASCII white space; the shingles of a text are its windows of five words, or all its words if it has fewer. Two texts
are linked if the Jaccard similarity of their shingle sets is at least ``threshold``.

1. Equal texts are one text with a number of copies, so copies cost nothing further.
2. MinHash values are computed where the text lies. ``BANDS`` bands of ``ROWS`` values make candidates of the texts that agree in a band: at 0.8 a
   pair is missed with probability 3e-5, above it far less.
3. Large bands are dealt in blocks of ``BLOCK`` texts, and each pair of blocks is a task of its own. A pair belongs to the first band in
   which it agrees, so it is looked at once. ``FRESH`` further MinHash values are compared in steps of ``STEP``; with a uniform prior the
   posterior of the similarity is a beta distribution, and a pair is dropped as soon as the posterior probability of reaching the
   threshold is below ``tolerance``. What leaves the task is the texts that still have a partner, not the pairs.
4. Only those texts are fetched, and the same pairs are verified exactly on their shingles. What leaves the task is, for each text, the number
   of documents that it links to and the smallest text of its group there. So no list of pairs exists, however many texts are alike.
5. Classes are the connected components of the links; the id of a class is its smallest document id.

Null texts and texts without words are linked to nothing, copies of them included. Repeated rows are copies of each other; a null id never
names a class unless all its documents have none. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm import textvec
from stageflow.llm.common import materialize, table
from stageflow.llm.components import components

SHINGLE = 5
BANDS, ROWS = 20, 4
FRESH, STEP = 48, 8
BLOCK = 256
TOLERANCE = 1e-5
_CHUNK = 256
#: Stands for a null id.
NO_ID = -(1 << 63)


@cache
def _hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    """Fixed random multipliers (odd) and masks of the MinHash functions."""
    seed = textvec.mix(np.arange(1, 2 * (BANDS * ROWS + FRESH) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[::2] | np.uint64(1), seed[1::2]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the shingles: ``hash[first[i]:first[i + 1]]`` belong to text i; repetitions are kept."""
    w = textvec.words(texts, "space")
    counts = np.diff(w.first)
    h, at = w.grams(SHINGLE)
    hashes, owner = [h], [w.text[at]]
    for n in range(1, SHINGLE):
        if (counts == n).any():
            h, at = w.grams(n)
            own = w.text[at]
            keep = counts[own] == n
            hashes.append(h[keep])
            owner.append(own[keep])
    owner_ = np.concatenate(owner)
    order = np.argsort(owner_, kind="stable") if len(hashes) > 1 else slice(None)
    return np.concatenate(hashes)[order], np.searchsorted(owner_[order], np.arange(len(texts) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, fresh) by text; of texts without shingles they mean nothing."""
    n, total = len(first) - 1, BANDS * ROWS + FRESH
    values = np.zeros((n, total), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        mult, mask = _hash_parameters()
        with np.errstate(over="ignore"):
            for k in range(total):
                v = (((h ^ mask[k]) * mult[k]) >> np.uint64(32)).astype(np.uint32)
                values[full, k] = np.minimum.reduceat(v, first[full])
    bands = np.zeros((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(n, b + 1, np.uint64)
            for r in range(ROWS):
                x = textvec.mix(x * np.uint64(0x9E3779B97F4A7C15) + values[:, b * ROWS + r])
            bands[:, b] = x
    return bands.view(np.int64), values[:, BANDS * ROWS :].astype(np.uint16)


@cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step, the fewest equal values with which P(similarity >= threshold) is still at least the tolerance.

    m of n values being equal, the posterior under a uniform prior is Beta(m + 1, n - m + 1), and its upper tail at t is the probability of at
    most m successes in n + 1 trials of probability t."""
    out = []
    for n in range(STEP, FRESH + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(bands: np.ndarray, fresh: np.ndarray, low: np.ndarray, high: np.ndarray, band: int, same: bool, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of low, row of high) that belong to this band and aren't dropped. same: low and high are one block."""
    i, j = np.triu_indices(len(low), 1) if same else (x.ravel() for x in np.indices((len(low), len(high))))
    i, j = low[i], high[j]
    own = bands[i, band] == bands[j, band]
    for b in range(band):
        own &= bands[i, b] != bands[j, b]
    i, j = i[own], j[own]
    equal = np.zeros(len(i), np.int32)
    for k, limit in enumerate(limits):
        cut = slice(k * STEP, (k + 1) * STEP)
        equal += (fresh[i, cut] == fresh[j, cut]).sum(1, dtype=np.int32)
        keep = equal >= limit
        i, j, equal = i[keep], j[keep], equal[keep]
    return i, j


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for a in range(0, len(frame), _CHUNK):
            part = frame.iloc[a : a + _CHUNK]
            h, first = shingles(list(part.text))
            bands, fresh = signatures(h, first)
            real = np.diff(first) > 0
            yield pd.DataFrame({"rid": part.rid, "key": part.key, "bands": [b if r else [] for b, r in zip(bands, real, strict=True)], "fresh": [x.tobytes() if r else b"" for x, r in zip(fresh, real, strict=True)]})


class _Groups:
    """Gathers rows, sorted by task, into complete tasks."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.task: tuple | None = None

    def add(self, rows: Iterator[tuple[tuple, tuple]]) -> Iterator[tuple[tuple, list[tuple]]]:
        for task, row in rows:
            if task != self.task:
                yield from self.end()
                self.task, self.rows = task, []
            self.rows.append(row)

    def end(self) -> Iterator[tuple[tuple, list[tuple]]]:
        if len(self.rows) > 1:
            yield self.task, self.rows


def _blocks(task: tuple, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    _, low, high = task
    return np.flatnonzero(block == low), np.flatnonzero(block == high), low == high


def _pruner(limits: list[int]):
    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _Groups()

        def kept(done: Iterator[tuple[tuple, list[tuple]]]) -> pd.DataFrame:
            out = []
            for task, rows in done:
                bands = np.array([r[3] for r in rows], np.int64)
                fresh = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), FRESH)
                i, j = surviving(bands, fresh, *_blocks(task, np.array([r[1] for r in rows]))[:2], rows[0][2], task[1] == task[2], limits)
                out += [(*task, rows[k][1], rows[k][2], rows[k][0]) for k in np.unique(np.concatenate([i, j]))]
            return pd.DataFrame(out, columns=["bucket", "low", "high", "block", "band", "key"])

        for frame in frames:
            rows = zip(zip(frame.bucket, frame.low, frame.high, strict=True), zip(frame.key, frame.block, frame.band, frame.bands, frame.fresh, strict=True), strict=True)
            yield kept(groups.add(rows))
        yield kept(groups.end())

    return prune


def links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Whether the sets of each pair reach the threshold, exactly. Pairs are taken by their first set, whose elements are marked once."""
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    size, mark, out = np.diff(first), np.zeros(len(flat), bool), np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        if not len(part):
            continue
        a = i[part[0]]
        mine = at[first[a] : first[a + 1]]
        mark[mine] = True
        for s in range(0, len(part), 64):  # bounds what is gathered at once
            js = j[part[s : s + 64]]
            hit = mark[np.concatenate([at[first[b] : first[b + 1]] for b in js])]
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[js])[:-1]]), dtype=np.int64)
            out[part[s : s + 64]] = both * (threshold.numerator + threshold.denominator) >= threshold.numerator * (size[a] + size[js])
        mark[mine] = False
    return out


def _verifier(threshold: Fraction, limits: list[int]):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _Groups()

        def found(done: Iterator[tuple[tuple, list[tuple]]]) -> pd.DataFrame:
            out = []
            for task, rows in done:
                rows = list({r[0]: r for r in rows}.values())  # the text of a repeated row comes twice
                bands = np.stack([r[4] for r in rows])
                fresh = np.stack([r[5] for r in rows])
                i, j = surviving(bands, fresh, *_blocks(task, np.array([r[1] for r in rows]))[:2], rows[0][2], task[1] == task[2], limits)
                if not len(i):
                    continue
                ok = links([r[6] for r in rows], i, j, threshold)
                i, j = i[ok], j[ok]
                copies = np.array([r[3] for r in rows], np.int64)
                count = np.zeros(len(rows), np.int64)
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                root = _smallest([r[0] for r in rows], i, j)
                out += [(rows[k][0], root[k], count[k]) for k in np.flatnonzero(count)]
            return pd.DataFrame(out, columns=["key", "root", "links"])

        def prepared(frame: pd.DataFrame) -> Iterator[tuple[tuple, tuple]]:
            for a in range(0, len(frame), _CHUNK):
                part = frame.iloc[a : a + _CHUNK]
                h, first = shingles(list(part.text))
                bands, fresh = signatures(h, first)
                for n, (bucket, low, high, *row) in enumerate(zip(part.bucket, part.low, part.high, part.key, part.block, part.band, part.copies, strict=True)):
                    yield (bucket, low, high), (*row, bands[n], fresh[n], np.unique(h[first[n] : first[n + 1]]))

        for frame in frames:
            yield found(groups.add(prepared(frame)))
        yield found(groups.end())

    return verify


def _smallest(keys: list[bytes], i: np.ndarray, j: np.ndarray) -> list[bytes]:
    """Smallest key of the component of each row under the links (i, j)."""
    parent = np.argsort(np.argsort(np.array(keys, object)))  # rank of the smallest known key
    names = sorted(keys)
    while True:
        least = np.minimum(parent[i], parent[j])
        new = parent.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == parent).all():
            return [names[p] for p in new]
        parent = new


def similarity_classes(df: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, key, class_key, class_id, n_links, n_copies) of each row. key: digest of the text; class_key: smallest key of the class;
    class_id: its smallest document id; n_links: other documents with a similarity of at least ``threshold``; n_copies: rows with the same text."""
    exact, limits = Fraction(str(threshold)), least_matches(threshold, tolerance)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("text"))
    signed = materialize(docs.mapInPandas(_signed, "rid long, key binary, bands array<long>, fresh binary"), "join-signed")
    texts = signed.groupBy("key").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.min(F.nullif(F.col("rid"), F.lit(NO_ID))).alias("id"), F.first("bands").alias("bands"), F.first("fresh").alias("fresh"))
    texts = materialize(texts, "join-texts")

    banded = texts.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(shared, "bucket").join(texts.select("key", "bands", "fresh"), "key")
    tasks = (
        members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "block", "band", "bands", "fresh")
    )
    where = ["bucket", "low", "high"]
    left = tasks.repartition(*where).sortWithinPartitions(*where).mapInPandas(_pruner(limits), "bucket long, low int, high int, block int, band int, key binary")
    left = materialize(left, "join-left")

    wanted = left.join(texts.select("key", "rid", "copies"), "key")
    with_text = docs.where("text IS NOT NULL").join(wanted, ["key", "rid"]).select(*where, "key", "block", "band", "copies", "text")
    found = with_text.repartition(*where).sortWithinPartitions(*where).mapInPandas(_verifier(exact, limits), "key binary, root binary, links long")
    found = materialize(found, "join-found")

    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = texts.select("key", "id", "copies", (F.size("bands") > 0).alias("real")).join(counts, "key", "left").join(roots, "key", "left")
    classes = known.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("class"))
    known = known.join(classes, "root", "left").select("key", F.coalesce("root", "key").alias("class_key"), "copies", "real", "links", F.when(F.col("root").isNotNull(), F.col("class")).otherwise(F.col("id")).alias("class"))
    return _spread(signed.select("rid", "key"), known, signed.count()).select(
        F.nullif(F.col("rid"), F.lit(NO_ID)).alias("doc_id"), "key", "class_key",
        F.when(F.col("real"), F.col("class")).otherwise(F.nullif(F.col("rid"), F.lit(NO_ID))).alias("class_id"),
        F.when(F.col("real"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies"),
    )


def _spread(rows: DataFrame, known: DataFrame, total: int, share: int = 1000) -> DataFrame:
    """Join of all rows with what is known of their text. Texts that hold at least 1 / share of the rows, of which there are at most ``share``, are
    broadcast, so no task gets all rows of one text."""
    hot = F.col("copies") * share >= max(total, share)
    few = F.broadcast(known.where(hot))
    return rows.join(few, "key").unionByName(rows.join(few.select("key"), "key", "left_anti").join(known.where(~hot), "key"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
