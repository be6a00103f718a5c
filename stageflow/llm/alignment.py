"""Tokens of two tokenizers aligned by bytes, each distinct text once.

Texts are grouped by their full text with the number of documents that hold each, and only distinct texts are encoded: by a byte-level
tokenizer (A, of a blank and the text) and by a piece model (B, which puts the blank in front itself). Byte offsets where tokens of both end
cut a text into groups. An A and a B token are linked where their byte ranges overlap; between two neighbouring ends of either kind there
is exactly one such pair. A link counts once for every document with the text, and the counts of id pairs over all documents come back to the
texts in a join on the pair. The measures of a text are joined to its documents by digest.

Both ends lie at every blank that begins a word (see ``tokens``), so words are aligned one by one and a task aligns a distinct word once.

Texts that are null or empty, or whose token bytes are not the blank and the text (it holds U+2581, which B writes for a blank), have no tokens:
zeros and an empty group digest. Strings of special tokens are plain text. Repeated rows count and are returned each; a null doc_id is kept. Other
columns are not read. An empty table gives no rows.

Texts held by more than one in ``HOT`` documents are fewer than ``HOT``, so they are broadcast to their documents; the others are joined by digest.
Pair counts are broadcast while there are at most ``PAIRS`` of them, else both sides are shuffled by the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm.common import materialize, table
from stageflow.llm.tokens import Coder, Known, byte_level, default_path, gather, in_order, joined, piece_level, runs, starts, steps, words_of

HOT, PAIRS = 1000, 2_000_000
#: Bytes of text aligned at once, and of words that a worker keeps.
STEP, KEEP = 1 << 21, 1 << 22
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = "key binary, m long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:long>>"
_FOREIGN = "▁"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _decimals(n: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(n)], f"S{len(str(n)) + 1}")


class Aligner:
    """Alignments of distinct words, kept by a worker."""

    def __init__(self, a: Coder, b: Coder) -> None:
        self.a, self.b = a, b
        self.text_a = {e: _decimals(len(a.tokens), e) for e in ",|"}
        self.text_b = {e: _decimals(len(b.tokens), e) for e in ",;"}
        self.known = Known(self.learn, KEEP)

    def _exact(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for all words, each with a blank in front; an error if the bytes of either are others."""
        text = " " + joined(words)
        out = []
        for coder, ids in ((self.a, self.a.encode(text)), (self.b, self.b.encode(text[1:]))):
            if b"".join(map(coder.tokens.__getitem__, ids.tolist())) != text.encode():
                raise ValueError("bytes differ")
            out.append(ids.astype(np.int64))
        return out[0], out[1]

    def _good(self, words: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Which words keep their bytes, and their ids."""
        ok = pc.invert(pc.match_substring(words, _FOREIGN)).to_numpy(zero_copy_only=False).copy()
        try:
            return ok, self._exact(words.filter(pa.array(ok)))
        except ValueError:
            for i in np.flatnonzero(ok):
                try:
                    self._exact(words.slice(i, 1))
                except ValueError:
                    ok[i] = False
        return ok, self._exact(words.filter(pa.array(ok))) if ok.any() else (np.empty(0, np.int64),) * 2

    def learn(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each word: pairs of linked ids, text of its groups, and its numbers of A tokens, B tokens and groups and whether it has tokens."""
        parts = [(at, self._learn(part)) for at, part in runs(words)]
        return [in_order([(at, *p[k]) for at, p in parts], t) for k, t in enumerate((np.int64, np.uint8, np.int64))]

    def _learn(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(words)
        ok, (ids_a, ids_b) = self._good(words)
        if not ok.any():
            return [(np.empty(0, np.int64), np.zeros(n, np.int64)), (np.empty(0, np.uint8), np.zeros(n, np.int64)), (np.zeros(4 * n, np.int64), np.full(n, 4))]
        good = words.filter(pa.array(ok))
        at = np.flatnonzero(ok)
        ends = np.cumsum(pc.binary_length(good).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        cuts, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        pairs = ids_a[np.searchsorted(end_a, cuts)] * len(self.b.tokens) + ids_b[np.searchsorted(end_b, cuts)]
        count = lambda x: np.bincount(at[np.searchsorted(ends, x)], minlength=n)
        last_a, last_b = np.isin(end_a, common, assume_unique=True), np.isin(end_b, common, assume_unique=True)
        written = np.concatenate([np.where(last_a, self.text_a["|"][ids_a], self.text_a[","][ids_a]), np.where(last_b, self.text_b[";"][ids_b], self.text_b[","][ids_b])])
        order = np.argsort(np.concatenate([np.searchsorted(common, end_a) * 2, np.searchsorted(common, end_b) * 2 + 1]), kind="stable")
        letters = written[order].view(np.uint8).reshape(len(order), -1)
        size = np.bincount(at[np.searchsorted(ends, np.concatenate([end_a, end_b])[order])], weights=(letters > 0).sum(1), minlength=n).astype(np.int64)
        numbers = np.stack([count(end_a), count(end_b), count(common), ok.astype(np.int64)], 1)
        return [(pairs, count(cuts)), (letters[letters > 0], size), (numbers.ravel(), np.full(n, 4))]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, list[str], pa.Array]:
        """(``MEASURES`` by text, group digests, links as lists of (pair, times))."""
        words, codes, first = words_of(texts)
        at = self.known.index(words)[codes]
        (pairs, pair_at), (letters, letter_at), (numbers, _) = self.known.values
        per_word = numbers.reshape(-1, 4)[at]
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        kept = (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0) & (np.bincount(owner, weights=1 - per_word[:, 3], minlength=len(texts)) == 0)
        sums = np.stack([np.bincount(owner, weights=per_word[:, k], minlength=len(texts)).astype(np.int64) for k in range(3)], 1) * kept[:, None]
        digests = []
        for i in range(len(texts)):
            text = letters[gather(letter_at, at[first[i] : first[i + 1]])][:-1] if kept[i] else None
            digests.append("" if text is None else hashlib.sha256(text.tobytes()).hexdigest())
        use = kept[owner]
        at, owner = at[use], owner[use]
        span = len(self.a.tokens) * len(self.b.tokens)
        linked = np.repeat(owner * span, pair_at[at + 1] - pair_at[at])
        linked += pairs[gather(pair_at, at)]
        linked.sort()
        new = np.flatnonzero(np.diff(linked, prepend=-1))
        times = np.diff(np.append(new, len(linked)))
        linked = linked[new]
        of = linked // span
        n_links = np.bincount(of, weights=times, minlength=len(texts)).astype(np.int64)
        offsets = starts(np.bincount(of, minlength=len(texts)))
        links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(linked % span), pa.array(times)], ["pair", "times"]))
        return np.concatenate([sums, n_links[:, None]], 1), digests, links


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    a = byte_level(path_a)
    if a is None:
        raise ValueError(f"{path_a} is not a plain byte-level tokenizer")
    return Aligner(a, piece_level(path_b))


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Measures and links of distinct texts (key, text, m). Written once."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in steps(batch["text"], STEP):
                part = batch.slice(i, j - i)
                numbers, digests, links = aligner(path_a, path_b).batch(part["text"])
                columns = [part["key"], part["m"], *[pa.array(numbers[:, k]) for k in range(4)], pa.array(digests, pa.string()), links]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return materialize(texts.mapInArrow(align, SCHEMA), "align-texts", compression="zstd")


def pair_counts(measures: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): links over all documents, and whether no other pair of the B id has more. Written once."""
    counts = materialize(measures.select("m", F.inline("links")).groupBy("pair").agg(F.sum(F.col("m") * F.col("times")).alias("count")), "align-pairs")
    b = (F.col("pair") % n_b).alias("b")
    top = counts.groupBy(b).agg(F.max("count").alias("top"))  # at most one row an entry of the vocabulary
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, pairs: int = PAIRS, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    path_a, path_b = path_a or default_path(), path_b or piece_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    texts = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("m")).select(digest.alias("key"), "text", "m")
    measures = aligned(texts, path_a, path_b)
    counts = pair_counts(measures, len(piece_level(path_b).tokens))
    few = counts.select("pair").limit(pairs + 1).count() <= pairs
    scored = (
        measures.select("key", F.inline("links")).join(F.broadcast(counts) if few else counts, "pair")
        .groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    whole = materialize(measures.drop("links").join(scored, "key", "left").select("key", "m", *MEASURES, zero("n_best"), zero("count_sum"), "groups_sha256"), "align-measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", digest.alias("key"))
    total = whole.agg(F.sum("m")).first()[0] or 0
    common = whole.where(F.col("m") * hot > total).drop("m")  # fewer than ``hot`` rows
    rare = whole.where(F.col("m") * hot <= total).drop("m")
    rows = materialize(rows, "align-rows")
    found = rows.join(F.broadcast(common), "key").unionByName(rows.join(F.broadcast(common.select("key")), "key", "left_anti").join(rare, "key"))
    return found.select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
