"""Token ids of texts by public tokenizer files, a distinct word at a time.

Both kinds of tokenizer here work on stretches of text that begin at a blank: a byte-level tokenizer begins a new piece at a blank that is
followed by a visible character, and a piece model whose entries never hold a blank inside merges nothing across one that follows a visible
character. So a text is cut at its blanks, every distinct word of a batch is encoded once, and the ids of a text are gathered from those
of its words. A text that begins or ends with a blank, or has one next to other white space, is one word. The ids are those of the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: how byte-level tokenizers of this kind split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the characters with the Unicode property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
# A blank that may not be cut at; words that may not be put after others.
_UNSURE, _ALONE = f"^ | ([{BLANKS}]|$)", f"^$|^[{BLANKS}]| "
#: Bytes of text taken at once, and of words that a task keeps before it starts anew.
STEP, KEEP = 1 << 23, 1 << 24


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """Printable Latin-1 bytes are written as themselves; the other bytes, in order, as the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """A tokenizer: ``encode`` gives the ids of a text, strings of special tokens being plain text; ``size`` the bytes of each id."""

    def __init__(self, encode: Callable[[str], np.ndarray], tokens: Sequence[bytes]) -> None:
        self.encode, self.tokens = encode, tokens
        self.size = np.array([len(t) for t in tokens], np.int64)


@cache
def byte_level(path: str) -> Coder | None:
    """A plain byte-level file whose ids follow the order of merges, run by ``tiktoken``, which gives the same ids as ``tokenizers`` several
    times as fast; None for another kind of file. Loaded once a worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    plain = (
        model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if not plain:
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    first = len({t for t in vocab if t not in added}) - len(merged)
    if [vocab[m] for m in merged] != list(range(first, first + len(merged))):
        return None
    import tiktoken

    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return Coder(lambda text: fast.encode_to_numpy(text, disallowed_special=()), tokens)


def added_tokens(path: str) -> dict[str, int] | None:
    """Strings that the file's tokenizer takes out of a text before all else, and their ids; None if it does so in a way of its own
    (stripping blanks, whole words)."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return None
    return {t["content"]: t["id"] for t in added}


@cache
def piece_level(path: str) -> Coder:
    """A piece model with an unchanged text, a blank put in front and no entry with a blank after another character. Loaded once a worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces) or model.encode_as_pieces("a  b") != ["▁a", "▁", "▁b"]:
        raise ValueError(f"{path} merges across blanks or changes them")
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Coder(lambda text: np.array(model.encode(text, num_threads=1), np.uint32), tokens)


def gather(first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i + 1] - 1 for each i of index, one after the other."""
    size = first[index + 1] - first[index]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((first[index] - (ends - size)).astype(np.int32), size)


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, number of the word at each place, and first place of each text; joined by blanks, the words are the text. No nulls."""
    unsure = pc.match_substring_regex(texts, _UNSURE)
    lists = pc.split_pattern(texts, " ")
    if pc.any(unsure).as_py():
        rows, odd = np.arange(len(texts)), unsure.to_numpy(zero_copy_only=False)
        whole = pa.ListArray.from_arrays(pa.array(np.arange(odd.sum() + 1), pa.int32()), texts.filter(unsure))
        order = np.argsort(np.concatenate([rows[~odd], rows[odd]]))
        lists = pa.concat_arrays([lists.filter(pc.invert(unsure)), whole]).take(pa.array(order))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts(pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def steps(texts: pa.Array, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def joined(words: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


def runs(words: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places, words): words that can be encoded as one text, or a single word."""
    alone = pc.match_substring_regex(words, _ALONE)
    rest = pc.invert(alone)
    at = np.flatnonzero(rest.to_numpy(zero_copy_only=False))
    kept = words.filter(rest)
    for a, b in steps(kept):
        yield at[a:b], kept.slice(a, b - a)
    for i in np.flatnonzero(alone.to_numpy(zero_copy_only=False)):
        yield np.array([i]), words.slice(i, 1)


def in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Ragged array (flat values, counts) by place, from parts (places, flat values, counts)."""
    if not parts:
        return np.empty(0, dtype), np.empty(0, np.int64)
    at, flat, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(at)
    return flat[gather(starts(counts), order)] if len(parts) > 1 else flat, counts[order].astype(np.int64)


def word_ids(coder: Coder, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a blank in front, and the number of ids of each."""
    parts = []
    for at, part in runs(words):
        got = coder.encode(" " + joined(part))
        ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        parts.append((at, got, np.diff(np.searchsorted(np.cumsum(coder.size[got]), ends, "right"), prepend=0)))
    return in_order(parts, np.uint32)


def joined(words: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


def word_ids(coder: Coder, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a blank in front, and the number of ids of each."""
    ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for a, b in steps(words):
        part = words.slice(a, b - a)
        got = coder.encode(" " + joined(part))
        ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ids.append(got)
        counts.append(np.diff(np.searchsorted(np.cumsum(coder.size[got]), ends, "right"), prepend=0))
    return np.concatenate(ids), np.concatenate(counts)


class Known:
    """Words that a task has met, with values of each that ``learn`` computes for fresh ones: ragged arrays (flat values, counts)."""

    def __init__(self, learn: Callable[[pa.Array], list[tuple[np.ndarray, np.ndarray]]], keep: int | None = None) -> None:
        self.learn, self.keep = learn, keep
        self.words = pa.array([], pa.string())
        self.values = [(flat, starts(counts)) for flat, counts in learn(self.words)]

    def index(self, words: pa.Array) -> np.ndarray:
        """Number of each of some distinct words."""
        if self.words.nbytes > (self.keep or KEEP):
            self.__init__(self.learn, self.keep)
        known = pc.index_in(words, value_set=self.words)
        at = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if known.null_count:
            fresh = words.filter(pc.is_null(known))
            at[at < 0] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, fresh])
            self.values = [(np.concatenate([flat, f]), np.concatenate([first, first[-1] + np.cumsum(c)])) for (flat, first), (f, c) in zip(self.values, self.learn(fresh), strict=True)]
        return at


class Encoder:
    """Ids of whole batches of texts by a tokenizer file, as ``tokenizers`` gives them with add_special_tokens=False: strings of its added
    tokens become their ids."""

    def __init__(self, path: str) -> None:
        self.coder, self.added, self.slow, self.cut = byte_level(path), added_tokens(path), None, None
        if self.coder is None or self.added is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            return
        self.known = Known(lambda words: [word_ids(self.coder, words)])
        if self.added:
            self.cut = "(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")"

    def one(self, text: str) -> np.ndarray:
        """Ids of a text by itself."""
        if self.slow is not None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if not self.cut:
            return self.coder.encode(text)
        parts = re.split(self.cut, text)
        return np.concatenate([np.array([self.added[p]], np.uint32) if k % 2 else self.coder.encode(p) for k, p in enumerate(parts)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each. The first word has no blank in front."""
        if self.slow is not None:
            lists = [self.one(t) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *lists]), np.array([len(x) for x in lists], np.int64)
        special = pc.match_substring_regex(texts, self.cut).to_numpy(zero_copy_only=False) if self.cut else np.zeros(len(texts), bool)
        plain = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)
        words, codes, first = words_of(plain)
        heads = [self.one(t) if s else self.coder.encode(h) for t, s, h in zip(_where(texts, special), special, words.take(pa.array(codes[first[:-1]])).to_pylist(), strict=True)]
        used, rest = np.unique(np.delete(codes, first[:-1]), return_inverse=True)
        rest = self.known.index(words.take(pa.array(used)))[rest]
        ((ids, at),) = self.known.values
        head_size, tail = np.array([len(h) for h in heads], np.int64), np.diff(starts(np.diff(at)[rest])[first - np.arange(len(first))])
        out = np.empty(head_size.sum() + tail.sum(), np.uint32)
        is_head = np.repeat(np.tile([True, False], len(heads)), np.stack([head_size, tail], 1).ravel())
        out[is_head] = np.concatenate([np.empty(0, np.uint32), *heads])
        out[~is_head] = ids[gather(at, rest)]
        return out, head_size + tail


def _where(texts: pa.Array, mask: np.ndarray) -> list[str | None]:
    return texts.to_pylist() if mask.any() else [None] * len(texts)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
