import random
import re
from collections import Counter

import duckdb
import pytest

from stageflow.llm import collocations as C
from tests.check_oracle import compare, connect


def brute(rows, least, share, top):
    """Contract rows, word by word."""
    f, n = {}, Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cands.items():
            if any(100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def sample(seed=5):
    rng = random.Random(seed)
    words = ["New", "York", "new", "york", "city", "the", "of", "Été", "x\x1cy", "　", "a-b", "z" * 30]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", "of the city of the city of the city " * 300)] + [("fr", None), (None, ""), ("fr", " .. \n")] + [("en", "the same line in many documents.")] * 40


@pytest.mark.parametrize(("modulus", "size", "most"), [(C.MODULUS, C.SLICE, C.FILTER_BITS), (2, 200, 64), (1, 50, 1024)])
def test_equals_brute_force(spark, modulus, size, most):
    """Also with many chunks, slices within a piece, long runs without a trigger and a filter that holds almost everything."""
    rows = sample()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    out = C.collocations(df, least=5, top=25, modulus=modulus, size=size, most=most)
    assert got(out) == brute(rows, 5, C.SHARE, 25)


@pytest.mark.parametrize("longest", [3, 4, 512])
def test_chunks_hold_every_run_once(monkeypatch, longest):
    monkeypatch.setattr(C, "LONGEST", longest)
    for modulus, size in ((1, 10), (2, 40), (3, 1 << 20)):
        for text in ("a", "a b", "a b c", "x y z " * 50, "one two three four five six, seven eight nine ten. a a a a a a a a"):
            counted = Counter()
            for run in C._runs([text.encode()], size):
                for chunk, last in C._chunks(*run, modulus):
                    w = chunk.decode().split(" ")
                    counted.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1) if last or i < len(w) - 2)
            plain = Counter()
            for piece in re.split("[.,]", text):
                w = piece.split()
                plain.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
            assert counted == plain


def test_odd_rows(spark, odd_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert got(C.collocations(odd_docs)) == brute(rows, C.LEAST, C.SHARE, C.TOP)


def test_empty(no_docs):
    assert C.collocations(no_docs).count() == 0


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000, 3_500_000_000, 4_000_000_000)], "a long, l long, r long")
    score = df.select(C._score(df.a, df.l, df.r)).first()[0]
    assert score == 10**6 * 3_000_000_000**2 // (3_500_000_000 * 4_000_000_000)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(C.op13(spark, sf).toPandas(), connect(sf).execute(C.sql()).df()) is None
    con = duckdb.connect()
    rows = sample()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(C.sql(5, top=25)).df()
    assert sorted(want.itertuples(index=False, name=None)) == brute(rows, 5, C.SHARE, 25)
