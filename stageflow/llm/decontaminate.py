"""Documents that hold passages of a benchmark.

Words are runs of letters and digits in lower case; shingles are windows of five words. The weight of a shingle is
its number of letters and digits, so runs of function words count little. A document window as long as an item, in words, is a
match if the weighted Jaccard similarity of their shingle multisets is at least ``threshold``. A document with fewer words than the item is one window.

1. An exact filter: a window can only reach the threshold if shingles of the benchmark make up at least that share of its weight. Prefix sums
   of weights give this share for every window of every item length, so only windows around benchmark text go further. It drops no match.
2. The SimHash of a window is the sign of the weighted sum of its shingles' 64 random signs.
3. Fingerprints of the items of one length are indexed by eight blocks of 8 bits. Two fingerprints within ``RADIUS`` differ by at most
   RADIUS // 8 bits in some block. For each block and each of its 256 values the index has the items that near, so eight lookups
   give all items within the radius; full distances are then compared.
4. The remaining pairs of window and item are verified exactly, each from the window before it: only the shingles that left and entered
   are counted, so the work grows with the text's length, also where a passage is repeated over megabytes. Of overlapping windows for an item
   the best is returned (ties: the first).

The benchmark is small next to the corpus. Its items are sent to the tasks in slices of at most ``SLICE`` rows, each slice a pass over the
documents, so what is sent has a bound whatever the benchmark's size. The documents are neither shuffled nor collected.

Null texts and items, and those of fewer than five words, have no shingles and match nothing. Repeated documents give a row each, repeated items a match each with their
own id. Texts are read whole; fingerprints are summed over ``PIECE`` shingles at a time, with an overlap of the longest item, so memory beside the
text itself does not grow with its length. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm import textvec
from stageflow.llm.common import table

SHINGLE = 5
THRESHOLD = 0.8
#: 64-bit fingerprints of texts with a similarity of 0.8 differ by 10 bits on average, and by more than this in one of a thousand.
RADIUS = 19
_BLOCKS, _BLOCK_BITS = 8, 8
#: Most benchmark rows sent to the tasks at once.
SLICE = 20_000
#: Texts hashed together: at most this many, and about this many characters unless one text is longer.
_ROWS, _CHARS = 128, 4_000_000
#: Shingles whose signs are held at once, if no item is longer than a quarter of it.
PIECE = 16_384
#: Pairs of a fingerprint and an item compared at once.
_PAIRS = 1 << 24
MATCHES = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int"


def _shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, text, place of the first word) of the shingles of five words."""
    w = textvec.words(texts, "word", fold=True)
    h, at = w.grams(SHINGLE)
    upto = np.concatenate([[0], np.cumsum(w.chars, dtype=np.int64)])
    return h, upto[at + SHINGLE] - upto[at], w.text[at], at - w.first[w.text[at]]


def _signs(h: np.ndarray) -> np.ndarray:
    """64 signs of each shingle, from a second mix of its hash."""
    bits = np.unpackbits(textvec.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class Index:
    """Items by the blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str | None], radius: int = RADIUS) -> None:
        texts = [t or "" for t in texts]
        self.radius = radius
        w = textvec.words(texts, "word", fold=True)
        count = np.diff(w.first)
        short = count < SHINGLE
        h, weight, text, _ = _shingles(texts)
        self.ids, self.words, self.sets = [], [], []
        prints = []
        for i in np.flatnonzero(~short):  # items of fewer than five words have no shingle to be found by
            mine = text == i
            self.ids.append(ids[i])
            self.words.append(int(count[i]))
            self.sets.append(_multiset(h[mine], weight[mine]))
            prints.append(_fingerprints((_signs(h[mine]) * weight[mine][:, None]).sum(0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint64)
        self.words = np.array(self.words, np.int64)
        self.lengths = np.unique(self.words)
        total = np.array([x[1].sum() for x in self.sets])
        self.lightest = {int(n): total[self.words == n].min() for n in self.lengths}
        self.known = np.unique(np.concatenate([s[0] for s in self.sets])) if self.sets else np.empty(0, np.uint64)
        self.bloom = np.zeros(1 << 20, bool)  # spares most lookups in ``known``
        self.bloom[(self.known >> np.uint64(44)).astype(np.int64)] = True
        values = np.arange(1 << _BLOCK_BITS, dtype=np.uint8)
        self.by_length = {}
        for words in self.lengths:
            items = np.flatnonzero(self.words == words)
            blocks = _blocks_of(self.prints[items])
            self.by_length[int(words)] = items, [np.bitwise_count(values[:, None] ^ blocks[:, b]) <= radius // _BLOCKS for b in range(_BLOCKS)]

    def contains(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bloom[(h >> np.uint64(44)).astype(np.int64)])
        out = np.zeros(len(h), bool)
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            out[maybe] = self.known[at] == h[maybe]
        return out

    def near(self, prints: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of prints, item of ``words`` words, distance) of all pairs within the radius."""
        items, tables = self.by_length[words]
        step = max(1, _PAIRS // len(items))
        if len(prints) > step:
            parts = [(a, self.near(prints[a : a + step], words)) for a in range(0, len(prints), step)]
            return tuple(np.concatenate(x) for x in zip(*[(row + a, k, far) for a, (row, k, far) in parts], strict=True))
        blocks = _blocks_of(prints)
        maybe = np.zeros((len(prints), len(items)), bool)
        for b, table_ in enumerate(tables):
            maybe |= table_[blocks[:, b]]
        row, k = np.nonzero(maybe)
        far = np.bitwise_count(prints[row] ^ self.prints[items[k]])
        keep = far <= self.radius
        return row[keep], items[k[keep]], far[keep]


def _blocks_of(prints: np.ndarray) -> np.ndarray:
    """The eight bytes of each fingerprint."""
    return np.ascontiguousarray(prints).view(np.uint8).reshape(-1, _BLOCKS)


def _multiset(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, their total weights)."""
    keys, back = np.unique(h, return_inverse=True)
    return keys, np.bincount(back, weights=weight, minlength=len(keys))


def _similarities(h: np.ndarray, weight: np.ndarray, upto: np.ndarray, start: np.ndarray, size: int, item: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of an item's multiset to those of the windows of ``size`` shingles at ``start`` (ascending)."""
    both = np.zeros(len(start))
    breaks = np.flatnonzero(np.diff(start) >= size) + 1  # windows before and after share no shingle
    for run in np.split(np.arange(len(start)), breaks):
        a, b = start[run[0]], start[run[-1]] + size
        key = np.minimum(np.searchsorted(item[0], h[a:b]), len(item[0]) - 1)
        mine = np.flatnonzero(item[0][key] == h[a:b])
        places, keys, weights = (mine + a).tolist(), key[mine].tolist(), weight[a:b][mine].tolist()
        limit, have, shared, left, entered = item[1].tolist(), [0] * len(item[0]), 0.0, 0, 0
        for n in run.tolist():
            s = int(start[n])
            while entered < len(places) and places[entered] < s + size:
                k, old = keys[entered], have[keys[entered]]
                have[k] = old + weights[entered]
                shared += min(have[k], limit[k]) - min(old, limit[k])
                entered += 1
            while left < entered and places[left] < s:
                k, old = keys[left], have[keys[left]]
                have[k] = old - weights[left]
                shared += min(have[k], limit[k]) - min(old, limit[k])
                left += 1
            both[n] = shared
    return both / (upto[start + size] - upto[start] + item[1].sum() - both)


def _apart(found: list[tuple[float, int, int]], words: int) -> Iterator[tuple[float, int, int]]:
    """Of (-similarity, first word, distance), the best ones that don't overlap; all windows have ``words`` words."""
    taken: list[int] = []
    for value, s, distance in sorted(found):
        at = bisect_left(taken, s)
        if (at == 0 or taken[at - 1] + words <= s) and (at == len(taken) or s + words <= taken[at]):
            taken.insert(at, s)
            yield -value, s, distance


def _candidates(h: np.ndarray, weight: np.ndarray, windows: list[tuple[int, int, np.ndarray]], index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, shingles of a window, starts, distances) of the windows whose fingerprint is within the radius of the item's."""
    held = np.zeros(len(h) + 1, np.int64)  # shingles that some window holds
    for _, size, start in windows:
        np.add.at(held, start, 1)
        np.add.at(held, start + size, -1)
    near = np.flatnonzero(np.cumsum(held[:-1]))
    longest = max(size for _, size, _ in windows)
    piece = max(PIECE, 4 * longest)
    places = [np.searchsorted(near, start) for _, _, start in windows]
    for a in range(0, len(near), piece):
        part = near[a : a + piece + longest]
        total = np.zeros((len(part) + 1, 64))
        np.cumsum(_signs(h[part]) * weight[part][:, None], axis=0, out=total[1:])
        for (words, size, start), place in zip(windows, places, strict=True):
            inside = slice(*np.searchsorted(place, [a, a + piece]))
            at = place[inside] - a
            if not len(at):
                continue
            row, item, distance = index.near(_fingerprints(total[at + size] - total[at]), words)
            order = np.argsort(item, kind="stable")
            row, item, distance = row[order], item[order], distance[order]
            for rows in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else []:
                yield int(item[rows[0]]), size, start[inside][row[rows]], distance[rows]


def _matches_of(h: np.ndarray, weight: np.ndarray, index: Index, threshold: float) -> list[tuple[int, int, int, float, int]]:
    """(item, first word, words, similarity, distance) in one text, given its shingles in order."""
    known = index.contains(h)
    if not known.any():
        return []
    all_, hit = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, weight * known))
    windows = []
    for words in index.lengths:
        size = min(int(words) - SHINGLE + 1, len(h))  # a shorter document is one window
        if all_[-1] < threshold * index.lightest[int(words)] - 1e-9:
            continue
        share = hit[size:] - hit[:-size]
        start = np.flatnonzero((share > 0) & (share >= threshold * (all_[size:] - all_[:-size]) - 1e-9))
        if len(start):
            windows.append((int(words), size, start))
    if not windows:
        return []
    best: dict[int, list[tuple[float, int, int]]] = {}
    sizes: dict[int, int] = {}
    for item, size, start, distance in _candidates(h, weight, windows, index):
        value = _similarities(h, weight, all_, start, size, index.sets[item])
        good = value >= threshold
        if good.any():
            sizes[item] = size + SHINGLE - 1
            best.setdefault(item, []).extend(zip((-value[good]).tolist(), start[good].tolist(), distance[good].tolist(), strict=True))
    return sorted((index.ids[i], s, sizes[i], value, far) for i, found in best.items() for value, s, far in _apart(found, sizes[i]))


def _parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in runs of at most ``_ROWS`` rows and about ``_CHARS`` characters."""
    first, chars = 0, 0
    for n, size in enumerate(frame.text.str.len().fillna(0).astype(np.int64)):
        if n > first and (n - first == _ROWS or chars + size > _CHARS):
            yield frame.iloc[first:n]
            first, chars = n, 0
        chars += size
    yield frame.iloc[first:]


def _searcher(index: Index, threshold: float):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part in _parts(frame):
                h, weight, text, _ = _shingles(list(part.text))
                cut = np.searchsorted(text, np.arange(len(part) + 1))
                touched = np.unique(text[index.contains(h)])
                for n in touched:
                    doc = part.doc_id.iloc[n]
                    span = slice(cut[n], cut[n + 1])
                    out += [(None if pd.isna(doc) else int(doc), *m) for m in _matches_of(h[span], weight[span], index, threshold)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCHES.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return search


def slices(benchmark: DataFrame, item_col: str, text_col: str, size: int = SLICE) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows, at most ``size`` at a time."""
    batch: list[tuple[int, str]] = []
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        batch.append((r[0], r[1]))
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a match, as in ``MATCHES``: the document, the item, the window's first word and number of words, similarity and distance."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    passes = []
    for batch in slices(benchmark, item_col, item_text):
        index = Index([i for i, _ in batch], [t for _, t in batch], radius)
        passes.append(docs.mapInPandas(_searcher(index, threshold), MATCHES))
    return reduce(DataFrame.unionAll, passes) if passes else spark.createDataFrame([], MATCHES)


def _flagger(index: Index, threshold: float):
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = np.zeros(len(part), bool)
            for frame in _searcher(index, threshold)(iter([pd.DataFrame({"doc_id": np.arange(len(part)), "text": part.to_numpy()})])):
                out[frame.doc_id.to_numpy(np.int64)] = True
            yield pd.Series(out)

    return F.pandas_udf(found, "boolean")


def flagged(df: DataFrame, benchmark: DataFrame, name: str, threshold: float = THRESHOLD, radius: int = RADIUS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` with the boolean ``name``: whether the text matches an item. Nothing is shuffled."""
    hit = F.lit(False)
    for batch in slices(benchmark, item_col, item_text):
        hit = hit | _flagger(Index([i for i, _ in batch], [t for _, t in batch], radius), threshold)(F.col(text_col))
    return df.withColumn(name, hit)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
