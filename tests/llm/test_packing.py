import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stageflow.llm import packing as P
from stageflow.llm import tokens
from stageflow.llm.tokens import default_path, encoder


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = (
    "Hello world's  double  blanks\n\n\ttab 123,456!! l'été ß \U0001f600   x", "<|endoftext|>", "<|endoftext|>a b", "a <|endoftext|> b", "a b<|endoftext|>", "x <|endoftext|><|endoftext|>  <|endoftext",
    "", " ", "  ", " a", "a ", "a  b", "a \n b", "　  b", "!\x1c? \x1cx", " \xa0c", "\x00\x1f\x7f ", "a" * 5000, "日本語 русский عربى", "I'll we've 'S", " word" * 3000,
)


def test_ids_equal_the_tokenizer(plain):
    """In one batch, one by one, and by words that the task knows already."""
    fast = encoder(default_path())
    for texts in (ODD, ODD[::-1], *[[t] for t in ODD]):
        ids, counts = fast.batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


def test_words_of_earlier_batches_are_forgotten_at_a_bound(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 200)
    fast = tokens.Encoder(default_path())
    for k in range(20):
        text = " ".join(f"word{i}" for i in range(k, k + 30))
        assert fast.batch(pa.array([text]))[0].tolist() == plain(text)
        assert len(fast.known.words) < 100


def test_hilbert_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = P.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def check(rows, docs, length, ids_of):
    """Pieces cover every document once; sequences are gapless and full but for the last."""
    want = sorted((-1 if d is None else d, ids_of(t or "") + [0]) for d, t in docs)
    spans = sorted((r.sequence_id * length + r.offset, r) for r in rows)
    at, got, ids, left = 0, [], [], 0
    for place, r in spans:
        assert place == at and r.offset + r.length <= length and r.length > 0
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert r.start == len(ids)
        ids += np.frombuffer(bytes(r.ids), "<u4").tolist()
        at += r.length
        if len(ids) == r.doc_tokens:
            got.append((-1 if r.doc_id is None else r.doc_id, ids))
            ids = []
    assert not ids and sorted(got) == want


def test_pieces(spark, plain, odd_docs):
    odd_docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(P.pack(odd_docs, with_ids=True).collect(), docs, 1024, plain)
    small = [(i % 40, f"text number {i % 7} " * (i % 9)) for i in range(200)]
    check(P.pack(spark.createDataFrame(small, "doc_id long, text string").repartition(6), 64, with_ids=True).collect(), small, 64, plain)


def test_sequences_are_padded_except_at_powers_of_two(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(10)], "doc_id long, text string")
    pieces = P.pack(df, 16, with_ids=True).cache()
    for r in P.sequences(pieces, 16).collect():
        assert len(r.ids) == (r.used if r.used & (r.used - 1) == 0 else 16) and not any(r.ids[r.used :])
    assert sum(r.used for r in P.sequences(pieces, 16).collect()) == pieces.groupBy().sum("length").first()[0]


def test_neighbours_on_the_curve_are_alike(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = P.pack(data).join(data.select("doc_id", "lang"), "doc_id")
    from pyspark.sql import functions as F

    mixed = pieces.groupBy("sequence_id").agg(F.countDistinct("lang").alias("k")).agg(F.avg("k")).first()[0]
    assert mixed < 1.5


def test_empty(no_docs):
    assert P.pack(no_docs).count() == 0
