import bisect
import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stageflow.llm import alignment as A
from stageflow.llm import tokens
from stageflow.llm.tokens import default_path

ODD = [
    "Hello world's  double  blanks\n\n\ttab 123,456!! l'été ß \U0001f600   x", "<|endoftext|> a<|endoftext|>", "<s> </s><unk> <0x41>", " ", "  ", " a", "a ", "a \n b", "　  b", "!\x1c? \x1cx",
    "\x00\x1f\x7f ", "▁", "a▁b", "aaaa" * 500, "日本語 русский عربى \xa0", "I'll we've 'S", "ﬁ ① ́x �", " word" * 700, "\r\n\r\n", "x" * 70 + " y",
]


def plain_tokens(text, tok, model, letters):
    """Ids and byte ranges of both, None where the bytes are not a blank and the text."""
    if not text:
        return None
    whole = (" " + text).encode()
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
    return (a, bytes_a, b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def brute(rows):
    """Contract rows, token by token."""
    tok = Tokenizer.from_file(default_path())
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=A.piece_path())
    letters = tokens._bytes_of_letters()
    found, counts = [], Counter()
    for _, text in rows:
        got = plain_tokens(text, tok, model, letters)
        if got is None:
            found.append(None)
            continue
        a, bytes_a, b, bytes_b = got
        spans = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((i, at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(a) < 100 else None
        if links is None:  # two pointers for long texts
            links, j = [], 0
            for i, s, e in spans[0]:
                while spans[1][j][2] <= s:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][1] < e:
                    links.append((i, spans[1][k][0]))
                    k += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        sides = [[[] for _ in cuts] for _ in spans]
        for side, out in zip(spans, sides, strict=True):
            for i, _, e in side:
                out[bisect.bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(",".join(side[k]) for side in sides) for k in range(len(cuts))]
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, j), c in counts.items():
        top[j] = max(top.get(j, 0), c)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = f
            out.append((doc, n_a, n_b, n_groups, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("pairs", "hot"), [(A.PAIRS, A.HOT), (0, 4)])
def test_equals_brute_force(spark, odd_docs, pairs, hot):
    """Odd texts, repeats and a hot text; pair counts broadcast or shuffled, hot texts broadcast or joined."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 9000 else r.text[:9000]) for r in odd_docs.collect()]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, "the same text in many documents") for i in range(60)]
    rows += [(300 + i, " ".join(rng.choice(["the", "of", "tokenizer", "Straße", "naïve,", "x1y2", "don't", "..."]) for _ in range(rng.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(A.align(df, pairs=pairs, hot=hot)) == brute(rows)


def test_whole_texts_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(A.op12(spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_text_with_clashing_columns(spark, odd_docs):
    rows = {r.doc_id: r for r in A.align(odd_docs).collect()}
    assert rows[6].n_links == rows[6].n_a + rows[6].n_b - rows[6].n_groups > 200_000 and rows[6][1:] == rows[7][1:]


def test_empty(no_docs):
    assert A.align(no_docs).count() == 0


def test_words_whose_bytes_change_are_found_one_by_one():
    """A coder that loses a byte spoils only the words that hold it."""
    b = A.piece_level(A.piece_path())
    lossy = tokens.Coder(lambda text: b.encode(text.replace("q", "")), b.tokens)
    a = A.Aligner(tokens.byte_level(default_path()), lossy)
    numbers, digests, links = a.batch(pa.array(["some plain words", "a queen here", "more words"]))
    assert [bool(d) for d in digests] == [True, False, True] and numbers[1].tolist() == [0, 0, 0, 0] and len(links[1]) == 0
