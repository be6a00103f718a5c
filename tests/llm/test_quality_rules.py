import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from stageflow.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c, cov = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            cov |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(cov)


def bucket(n, *parts):
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return (seed - (1 << 64) if seed >= 1 << 63 else seed) % n


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark, odd_docs):
    texts = ["a b c a b c", "x x x x x", "a b\na b\n\n \na b", "# * $ %&|<>\n", "\x0b\x0c\r\n", "a b c d a b c a b c d", "\u00a0a\u2003b"] + [r.text for r in odd_docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in Q.shape(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_filter_on_a_count_stays_linear(odd_docs):
    assert Q.shape(odd_docs).where("n_repeat_words > 10").count() == 2


def test_likelihood_ratio(spark):
    docs = [(1, "good words here"), (2, "good words there"), (3, "bad noise $$$ noise"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    n = 50
    grams = {i: [bucket(n, x) for x in (t or "").split()] + [bucket(n, *p) for p in zip((t or "").split(), [*(t or "").split()[1:], None], strict=False)] for i, t in docs}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in (1, 2) for b in grams[i])
    counts = Q.bucket_counts(df, spark.createDataFrame([(1,), (2,)], "id long"), n)
    assert {r.bucket: (r.raw, r.target) for r in counts.collect()} == {b: (raw[b], target[b]) for b in raw}
    ratios = Q.log_ratios(counts, n)
    t, r = sum(target.values()), sum(raw.values())
    for b in range(n):
        assert math.isclose(ratios[b], math.log((target[b] + 1) / (t + n)) - math.log((raw[b] + 1) / (r + n)), abs_tol=1e-8)
    got = {x.doc_id: x.llr for x in Q.judge(df, ratios).collect()}
    for i, g in grams.items():
        assert math.isclose(got[i], sum(ratios[b] for b in g) / len(g) if g else 0.0, abs_tol=1e-9)


def test_verdicts(spark, odd_docs, no_docs):
    out = Q.judge(odd_docs, [0.0] * 10, threshold=-0.1)
    assert out.count() == odd_docs.count() and out.where("base_failed AND kept").count() == 0
    assert out.where("n_words = 0 AND NOT base_failed").count() == 0
    assert Q.judge(no_docs, [0.0] * 10).count() == 0
    assert Q.log_ratios(Q.bucket_counts(no_docs, no_docs.select("doc_id")), 10) == [0.0] * 10


def test_no_python_and_no_text_shuffle(spark, odd_docs):
    plan = Q.judge(odd_docs, [0.1] * 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_all_trusted_rows_count_however_they_are_joined(spark):
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    trusted = Q.trusted_ids(labels.unionAll(labels))
    assert trusted.count() == 300
    for most in (Q.BROADCAST_IDS, 10):
        found = Q.bucket_counts(docs, trusted, most=most).agg(F.sum("raw"), F.sum("target")).first()
        assert tuple(found) == (1600, 1200)
