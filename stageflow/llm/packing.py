"""Documents packed into training sequences along a space-filling curve.

A document's vector counts its token ids in ``BINS`` hash bins, on the unit sphere. Fixed random directions project it to ``DIMS`` numbers, whose
cells lie in the order of a Hilbert curve, so documents near each other on the curve use similar tokens. All documents are put end to end in that
order, and the stream is cut every ``length`` tokens; each document ends with id ``END``. So every sequence but the last is full.

Token ids are those of ``tokenizers`` with add_special_tokens=False, so strings of the file's added tokens in a text become their ids. They are
computed once, equal texts of a batch together, and written with a row number. Only (key, row number, tokens) are sorted by range to get each document's place
in the stream from prefix sums; the places come back in a join on the row number, whose keys are distinct. So equal documents don't meet
in a task, however many they are. A piece is computed from its document and its place alone.

Null texts count as empty: one token. Repeated rows are packed each. Ties on the curve go by row number. An empty table gives no rows. Other
columns are not read. A long text becomes as many pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm import textvec
from stageflow.llm.common import materialize, table
from stageflow.llm.prefix import prefix_sums
from stageflow.llm.tokens import default_path, encoder, gather, starts, steps

LENGTH, END = 1024, 0
BINS, DIMS, CELL_BITS = 256, 3, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ROWS = 64


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points x (points by dimensions, below 2**bits)."""
    axes = [x[:, k].astype(np.uint64) for k in range(x.shape[1])]
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections of the coarser cells
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k, axis in enumerate(axes):
            upper = (axis & bit) > 0
            swap = np.where(upper, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):  # Gray code
        axes[k] = axes[k] ^ axes[k - 1]
    flip = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] >> np.uint64(level)) & np.uint64(1) > 0, flip ^ np.uint64((1 << level) - 1), flip)
    key = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ flip) >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


def _bins(n: int = 1 << 17) -> np.ndarray:
    """Hash bin of each token id."""
    return (textvec.mix(np.arange(n, dtype=np.uint64) + np.uint64(1)) >> np.uint64(56)).astype(np.int64)


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert key of each document; ids of all documents and the number of ids of each."""
    cells = np.repeat(np.arange(len(counts)) * BINS, counts) + _bins()[ids & 0x1FFFF]
    seen = np.bincount(cells, minlength=len(counts) * BINS).reshape(len(counts), BINS).astype(np.float64)
    unit = seen / np.maximum(np.sqrt((seen**2).sum(1, keepdims=True)), 1)
    directions = np.random.default_rng(7).standard_normal((BINS, DIMS))
    directions /= np.sqrt((directions**2).sum(0))
    cell = np.clip((unit @ directions + 1) / 2 * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1)
    return hilbert(cell.astype(np.uint64), CELL_BITS)


def _encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text with the end id, one after the other, and the number of ids of each; equal texts are encoded once."""
    coded = texts.dictionary_encode()
    ids, counts = encoder(path).batch(coded.dictionary)
    ids = np.insert(ids, np.cumsum(counts), END).astype("<u4")
    index = coded.indices.to_numpy(zero_copy_only=False)
    return (ids if len(coded.dictionary) == len(texts) else ids[gather(starts(counts + 1), index)]), (counts + 1)[index]


def tokenized(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, key, tokens, ids): ids as 32-bit integers with the end id. Written once."""
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch["text"]):
                ids, counts = _encoded(batch["text"].slice(a, b - a), path)
                offsets = pa.py_buffer(4 * starts(counts).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(curve_keys(ids, counts)), pa.array(counts), column], ["doc_id", "key", "tokens", "ids"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = docs.mapInArrow(encode, "doc_id long, key long, tokens long, ids binary")
    return materialize(made.withColumn("uid", F.monotonically_increasing_id()), "pack-tokens", compression="zstd")


def placed(tokens: DataFrame) -> DataFrame:
    """(doc_id, ids, at): ``at`` is the number of tokens before the document in the stream."""
    places, _ = prefix_sums(tokens.select("key", "uid", "tokens"), ["key", "uid"], "tokens", "pack")
    return tokens.select("uid", "doc_id", "ids").join(places.select("uid", "at"), "uid").drop("uid")


def _cut(length: int, with_ids: bool):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        for frame in frames:
            for a in range(0, len(frame), _ROWS):
                part, out = frame.iloc[a : a + _ROWS], []
                for doc, ids, at in zip(part.doc_id, part.ids, part["at"], strict=True):
                    n, start = len(ids) // 4, 0
                    while start < n:
                        sequence, offset = divmod(int(at) + start, length)
                        size = min(n - start, length - offset)
                        piece = bytes(ids[4 * start : 4 * (start + size)])
                        out.append((None if pd.isna(doc) else int(doc), start, size, zlib.crc32(piece), n, sequence, offset, *([piece] if with_ids else [])))
                        start += size
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return cut


def pack(df: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece, as in ``PIECES``; with_ids adds the ids (32-bit, little-endian)."""
    rows = placed(tokenized(df, path))
    return rows.mapInPandas(_cut(length, with_ids), PIECES + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """(sequence_id, used, ids) from pieces with ids: padded to ``length``, unless the used length is a power of two."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(frame.sort_values("offset").ids), "<u4")
        used = len(ids)
        full = ids if used & (used - 1) == 0 else np.append(ids, np.full(length - used, pad, np.uint32))
        return pd.DataFrame({"sequence_id": [frame.sequence_id.iloc[0]], "used": [used], "ids": [full.astype(np.int64).tolist()]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, used long, ids array<long>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
