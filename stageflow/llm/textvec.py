"""Vectorised hashing of words and characters inside Spark tasks.

A batch of texts becomes one array of code points. Runs of one character class are the words, a polynomial prefix hash gives every word a
64-bit value without a Python loop over words, and texts longer than ``PIECE`` characters are taken in pieces cut between words, so the
memory of a step depends on ``PIECE``, not on the longest text. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Characters hashed in one step.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SPACES = " \t\n\x0b\x0c\r"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64)) * inverse
        down = np.cumprod(np.full(n, inverse, np.uint64)) * base
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output (multiply and shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@cache
def classes(kind: str) -> np.ndarray:
    """Class of each code point; 0 separates words. ``space``: all but ASCII white space; ``word``: letters and digits; ``both``: runs of
    letters and digits (1) and runs of other visible characters (2)."""
    table = np.ones(0x110000, np.uint8)
    if kind == "space":
        table[[ord(c) for c in SPACES]] = 0
        return table
    word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    word[ord("_")] = True
    if kind == "word":
        return word.astype(np.uint8)
    blank = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    return np.where(word, 1, np.where(blank, 0, 2)).astype(np.uint8)


@cache
def lower() -> np.ndarray:
    """Lower case of each code point that has one of a single code point, else itself."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: Sequence[str | None], table: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of the text, piece), cut where no word is cut."""
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while len(text) - at > PIECE:
            cut = at + PIECE
            while cut < len(text) and table[ord(text[cut])]:
                cut += 1
            yield i, text[at:cut]
            at = cut
        yield i, text[at:]


def batches(texts: Sequence[str | None], table: np.ndarray) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces gathered up to ``PIECE`` characters."""
    ids, parts, size = [], [], 0
    for i, part in _pieces(texts, table):
        if parts and size + len(part) > PIECE:
            yield ids, parts
            ids, parts, size = [], [], 0
        ids.append(i)
        parts.append(part)
        size += len(part) + 1
    if parts:
        yield ids, parts


class Words:
    """Word hashes of a batch of texts: ``hash`` and ``chars`` by word, ``first[i]:first[i + 1]`` the words of text i, ``text`` its index by word."""

    def __init__(self, hash_: np.ndarray, chars: np.ndarray, first: np.ndarray) -> None:
        self.hash, self.chars, self.first = hash_, chars, first
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words and the index of their first words; none cross texts."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.text[:size] == self.text[n - 1 :])
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h + self.hash[at + k]) * np.uint64(_BASE)
        return mix(h), at


def words(texts: Sequence[str | None], kind: str, fold: bool = False) -> Words:
    """Words of the texts. kind: as in ``classes``; fold: compare in lower case."""
    table = classes(kind)
    hashes, lengths, counts = [], [], np.zeros(len(texts), np.int64)
    for ids, parts in batches(texts, table):
        cp = points("\n".join(parts) + "\n")
        c = table[cp]
        if fold:
            cp = lower()[cp]
        starts_at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        change = np.flatnonzero(c[1:] != c[:-1]) + 1
        begin = np.concatenate([[0], change])
        end = np.concatenate([change, [len(cp)]])
        real = c[begin] > 0
        begin, end = begin[real], end[real]
        up, down = _powers(1 << int(np.ceil(np.log2(max(len(cp), PIECE)))))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)])])
            hashes.append(mix((total[end] - total[begin]) * down[begin]))
        lengths.append((end - begin).astype(np.int32))
        upto = np.searchsorted(begin, np.append(starts_at, len(cp)))
        np.add.at(counts, ids, np.diff(upto))
    first = np.concatenate([[0], np.cumsum(counts)])
    return Words(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(lengths) if lengths else np.empty(0, np.int32), first)


def totals(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values by index of the text."""
    return np.bincount(text, weights=values, minlength=n)
