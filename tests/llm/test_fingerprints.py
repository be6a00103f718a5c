import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stageflow.llm import fingerprints as P


def plain_words(text):
    return Counter(text.encode().translate(P._LOWER).split())


def similarity(a, b):
    x, y = plain_words(a), plain_words(b)
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def plain_signature(text, samples):
    """Term by term, sample by sample."""
    terms = sorted(plain_words(text).items())
    if not terms:
        return []
    h = P._term_hashes([w for w, _ in terms])
    halves = np.stack([h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
    offers = [[int(P.draws(halves[:, i : i + 1], np.log(np.array([n], np.float32)), k)[0]) for i, (_, n) in enumerate(terms)] for k in range(samples)]
    return [min(o) & 0xFFFF for o in offers]


def texts(n=80, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(n)]


def test_signature_equals_the_plain_one_in_any_batch():
    all_ = [*texts(20), "", " \n", "One word", "ONE word", "ünï \U0001f600 x"]
    whole = P.signatures(all_, 32)
    for i, t in enumerate(all_):
        assert whole[i].tolist() == plain_signature(t, 32) == P.signatures([t], 32)[0].tolist()
    assert P.text_of(P.signatures(["One word"])[0]) == P.text_of(P.signatures([" one\nWORD "])[0]) and P.text_of(whole[20]) == ""


def test_collision_rate_is_the_generalised_jaccard_similarity():
    """Mean error over many pairs within what independent samples leave, for counts of all sizes."""
    rng = random.Random(9)
    errors = []
    for _ in range(60):
        a = Counter({f"t{i}": rng.choice([1, 1, 2, 3, 10, 40]) for i in range(40)})
        b = Counter({w: max(1, n + rng.choice([-3, 0, 0, 1, 9])) for w, n in a.items() if rng.random() < 0.8}) + Counter({f"u{i}": 2 for i in range(rng.randrange(20))})
        x, y = (" ".join(w for w, n in c.items() for _ in range(n)) for c in (a, b))
        s = P.signatures([x, y], 512)
        errors.append(P.likeness(*s) - similarity(x, y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def want(rows):
    """(doc_id, n_chars, sha, edited text, next text) in order, with plain lists."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = []
    for i, (doc, text, _) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        a, b, c = P.signatures([text, new, following])
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), P.text_of(a), P.text_of(b), P.likeness(a, b), P.likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_edited_equals_brute_force(spark, odd_docs, rows, monkeypatch):
    data = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(50 - i, t) for i, t in enumerate(texts(40))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumn("range", F.lit("x")).withColumn("h", F.lit("y"))
    hashed = [(r.doc_id, r.text, r.k) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()]
    got = sorted(map(tuple, P.edited(df, rows=rows).collect()), key=repr)
    assert got == want(hashed)


def test_single_document_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(3, "some text of a single document")], "doc_id long, text string")
    (r,) = P.edited(df).collect()
    assert r.near_next == 1.0 and r.doc_id == 3 and r.n_chars == 30
    assert P.edited(no_docs).count() == 0


def test_fingerprints_of_a_column(spark, odd_docs):
    rows = P.fingerprints(odd_docs, name="print").select("text", "print").collect()
    for r in rows:
        if r.text is None or len(r.text) < 1000:
            assert r.print == P.text_of(P.signatures([r.text or ""])[0])
    assert len({r.print for r in rows if r.text and len(r.text) > 1000}) == 1


def test_the_edited_text_is_nearer_than_the_next(spark):
    r = P.op11(spark, "/root/testdata/sf0.01").where("n_chars >= 200").agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.count("*")).first()
    print(r)
    assert r[0] > 0.6 and r[1] < 0.35 and r[2] > 0.97
