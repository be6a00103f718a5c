"""Phrases whose words occur together more often than apart, from a prefix-free parse of the texts.

A-Z are lower-cased; separators cut a text into pieces and blanks cut those into words. A piece is parsed into chunks: where the hash of two
consecutive words is divisible by ``MODULUS`` the chunk ends, and the next one begins with those two words; so equal passages give
equal chunks wherever they stand. ``LONGEST`` words without a trigger end a chunk as well. The distinct chunks of a language with their
frequencies are the dictionary. Every run of up to three words lies in a chunk; those that begin in the last two words of a chunk that
goes on belong to the next chunk, so each run is counted once, in its distinct chunk, weighted by the chunk's frequency.

A run of three words can only reach the least count if both its pairs do. So pairs are first counted by hash, and the pairs that may be
frequent go to the tasks as a Bloom filter of at most ``FILTER_BITS`` bits; then words, such pairs and the triples made of them are counted by their
text. A collision of hashes or in the filter costs work, never a count: what is counted by text is exact.

Each language has its own counts. A null lang is ``und``; a null text is empty. Repeated rows count each. Very long texts are parsed in slices that
overlap by two words. doc_id and other columns are not read. An empty table gives no rows. Ranks go by score, count and phrase, so there are no
ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stageflow.llm.common import materialize, table
from stageflow.llm.textvec import _powers, mix
from stageflow.llm.tokens import starts, steps

MODULUS, LONGEST, WORDS = 16, 512, 3
LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes of text parsed or counted at once; bits of the filter of frequent pairs.
SLICE, FILTER_BITS = 1 << 22, 1 << 28
#: Parts of a language that are ranked by themselves first.
PARTS = 64
UND = "und"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(SEPARATORS))


def _slices(piece: bytes, size: int) -> Iterator[tuple[list[bytes], bool]]:
    """(words, whether the piece ends there) of a piece; slices overlap by two words."""
    kept, at = [], 0
    while len(piece) - at > size:
        cut = piece.find(b" ", at + size)
        if cut < 0:
            break
        words = kept + piece[at:cut].split()
        at = cut
        if len(words) < WORDS:
            kept = words
            continue
        yield words, False
        kept = words[1 - WORDS :]
    words = kept + piece[at:].split()
    if words:
        yield words, True


def _runs(texts: list[bytes], size: int) -> Iterator[tuple[list[bytes], list[int], list[bool]]]:
    """Pieces of texts, gathered to about ``size`` bytes: their words, the number of words of each and whether it ends there."""
    words, counts, ends, held = [], [], [], 0
    for text in texts:
        for piece in text.translate(_FOLD).split(b"\n"):
            if len(piece) <= size:
                w = piece.split()
                if w:
                    words += w
                    counts.append(len(w))
                    ends.append(True)
            else:
                for w, last in _slices(piece, size):
                    words += w
                    counts.append(len(w))
                    ends.append(last)
                    if len(words) * 8 > size:
                        yield words, counts, ends
                        words, counts, ends = [], [], []
            held += len(piece)
            if held > size and words:
                yield words, counts, ends
                words, counts, ends, held = [], [], [], 0
    if words:
        yield words, counts, ends


def _chunks(words: list[bytes], counts: list[int], ends: list[bool], modulus: int) -> Iterator[tuple[bytes, bool]]:
    """(chunk, whether its piece ends there)."""
    code = np.fromiter(map(crc32, words), np.uint64, len(words))
    count = np.array(counts, np.int64)
    begin = np.cumsum(count) - count
    place = np.arange(len(words)) - np.repeat(begin, count)
    with np.errstate(over="ignore"):
        pair = mix((code[:-1] << np.uint64(32)) ^ code[1:])
    cut = np.zeros(len(words), bool)
    cut[1:] = pair % np.uint64(modulus) == 0
    cut |= place % LONGEST == LONGEST - 1
    cut &= (place >= WORDS - 2) & (place < np.repeat(count, count) - 1)  # a pair within the piece, and words after it
    at = np.flatnonzero(cut)
    first = np.concatenate([begin, at - (WORDS - 2)])
    order = np.argsort(first, kind="stable")
    stop = np.sort(np.concatenate([begin + count, at + 1]), kind="stable")
    last = np.zeros(len(words) + 1, bool)
    last[(begin + count)[np.array(ends, bool)]] = True
    for a, b in zip(first[order].tolist(), stop.tolist(), strict=True):
        yield b" ".join(words[a:b]), bool(last[b])


def dictionary_of_chunks(docs: DataFrame, modulus: int = MODULUS, size: int = SLICE) -> DataFrame:
    """(lang, last, chunk, n): distinct chunks with the number of times they occur. Written once."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch["text"]):
                lang = batch["lang"].slice(a, b - a).dictionary_encode()
                texts, of = batch["text"].slice(a, b - a).cast(pa.binary()), lang.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(lang.dictionary):
                    for run in _runs(texts.filter(pa.array(of == k)).to_pylist(), size):
                        found = Counter(_chunks(*run, modulus))
                        chunk = pa.array([c for c, _ in found], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(name, len(found)), pa.array([x for _, x in found], pa.bool_()), chunk, pa.array(list(found.values()), pa.int64())], ["lang", "last", "chunk", "n"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = rows.mapInArrow(parse, "lang string, last boolean, chunk string, n long")
    return materialize(found.groupBy("lang", "last", "chunk").agg(F.sum("n").alias("n")), "phrase-chunks", compression="zstd")


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    end = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    data = np.frombuffer("".join(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "").to_pylist()).encode(), np.uint8)
    up, down = _powers(1 << max(int(len(data)).bit_length(), 10))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        first = np.concatenate([[0], end[:-1]])
        return mix((total[end] - total[first]) * down[first])


class Runs:
    """Word numbers of some chunks of the dictionary, and where runs of words may begin."""

    def __init__(self, rows: pa.Table) -> None:
        lists = pc.split_pattern(rows["chunk"].combine_chunks(), " ")
        coded = lists.flatten().dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        last, n = rows["last"].to_numpy(), rows["n"].to_numpy()
        langs = rows["lang"].combine_chunks().dictionary_encode()
        self.langs, lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        left = np.repeat(starts(count)[1:], count) - np.arange(len(self.code))  # words from here to the chunk's end
        self.left, self.lang, weight = left, np.repeat(lang, count), np.repeat(n, count)
        self.weight = np.where(np.repeat(last, count) | (left >= WORDS), weight, 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each pair, distinct pairs as (lang, first, second), number of the distinct pair at each place)."""
        at = np.flatnonzero(self.left >= 2)
        n = len(self.words)
        key, which = np.unique((self.lang[at] * n + self.code[at]) * n + self.code[at + 1], return_inverse=True)
        return at, np.stack([key // n // n, key // n % n, key % n]), which

    def pair_hashes(self, pairs: np.ndarray) -> np.ndarray:
        h, g = _hashes(self.words), _hashes(self.langs)
        with np.errstate(over="ignore"):
            return mix(mix(h[pairs[1]] + g[pairs[0]]) * np.uint64(3) + h[pairs[2]])


def _gathered(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[Runs]:
    """Rows taken together up to ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        for a, b in steps(batch["chunk"]):
            held.append(batch.slice(a, b - a))
            n += held[-1].nbytes
            if n > size:
                yield Runs(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield Runs(pa.Table.from_batches(held))


def frequent_pairs(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """Hashes of pairs that occur often enough, and perhaps a few others. Written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _gathered(batches):
            at, pairs, which = runs.pairs()
            n = np.bincount(which, weights=runs.weight[at], minlength=pairs.shape[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(runs.pair_hashes(pairs)[n > 0].view(np.int64)), pa.array(n[n > 0])], ["h", "n"])

    seen = chunks.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return materialize(seen.where(F.col("n") >= least).select("h"), "phrase-pairs")


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of a hash in a filter of a power of two of bits."""
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [(low + np.uint64(k) * high) & np.uint64(bits - 1) for k in range(4)]


def bloom(pairs: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Filter of the hashes as 64-bit words: 16 to 32 bits a hash up to ``most`` bits in all. The words are put together in tasks."""
    bits = min(most, 1 << max(10, (16 * pairs.count()).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_slots(batch["h"].to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    filled = pairs.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


def _holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _slots(h, len(words) * 64):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def phrase_counts(chunks: DataFrame, least: int = LEAST, most: int = FILTER_BITS) -> DataFrame:
    """(lang, k, phrase, a): all words, and the phrases of two and three words with a >= least. Written once."""
    sent = chunks.sparkSession.sparkContext.broadcast(bloom(frequent_pairs(chunks, least), most))  # at most ``most`` bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _gathered(batches):
            n_words, weight = len(runs.words), runs.weight

            def rows(lang: np.ndarray, parts: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
                use = n > 0
                texts = [runs.words.take(pa.array(p[use])) for p in parts]
                phrase = pc.binary_join_element_wise(*texts, " ") if len(texts) > 1 else texts[0]
                return pa.RecordBatch.from_arrays([runs.langs.take(pa.array(lang[use])), pa.array(np.full(use.sum(), len(parts), np.int32)), phrase, pa.array(n[use])], ["lang", "k", "phrase", "n"])  # noqa: B023

            key, which = np.unique(runs.lang * n_words + runs.code, return_inverse=True)
            yield rows(key // n_words, [key % n_words], np.bincount(which, weights=weight).astype(np.int64))
            at, pairs, which = runs.pairs()
            if not len(at):
                continue
            often = _holds(sent.value, runs.pair_hashes(pairs))
            n = np.bincount(which, weights=weight[at], minlength=pairs.shape[1]).astype(np.int64)
            yield rows(pairs[0], [pairs[1], pairs[2]], np.where(often, n, 0))
            pair_at = np.full(len(runs.code) + 1, -1)
            pair_at[at] = np.where(often[which], which, -1)
            first = np.flatnonzero((runs.left >= 3) & (pair_at[:-1] >= 0) & (pair_at[1:] >= 0))
            if len(first):
                key, which = np.unique(pair_at[first] * n_words + runs.code[first + 2], return_inverse=True)
                lead = pairs[:, key // n_words]
                yield rows(lead[0], [lead[1], lead[2], key % n_words], np.bincount(which, weights=weight[first]).astype(np.int64))

    counted = chunks.mapInArrow(count, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("a"))
    return materialize(counted.where((F.col("k") == 1) | (F.col("a") >= least)), "phrase-counts")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(10**6 a a / (l r)) in whole numbers of up to 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (big(l) * big(r)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, modulus: int = MODULUS, size: int = SLICE, most: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(dictionary_of_chunks(docs, modulus, size), least, most)
    found = counts.where("k > 1").withColumn("w", F.split("phrase", " "))
    inside = (
        found.where("k = 3").select("lang", F.explode(F.array(*[F.array_join(F.slice("w", i, 2), " ") for i in (1, 2)])).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    part = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("k = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH p AS (SELECT coalesce(lang, '{UND}') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
  c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {least}),
  o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
  d AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {share} * c.a),
  x AS (SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM d)),
  y AS (SELECT x.*, l.a AS l, r.a AS r, 1000000::HUGEINT * x.a * x.a // (l.a::HUGEINT * r.a) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
  z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
  SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN t ON t.lang = z.lang
  QUALIFY rank <= {top}"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
