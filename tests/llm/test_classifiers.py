import random

import numpy as np
from pyspark.sql import functions as F

from stageflow.llm import language_id as L
from stageflow.llm import quality_classifier as Q

SMALL = "/root/testdata/sf0.01"


def test_kernel_scores_equal_plain_kernel():
    """Batched products equal the kernel written out with sets."""
    rng = np.random.default_rng(1)
    slots = np.full(1 << 20, L.VOCABULARY, np.int16)
    texts = ["the cat sat", "der hund läuft!", "", "12 34", "le chat. le chat"]
    used = np.unique(np.concatenate([s for _, s in L._slots_of(texts)]))[: L.VOCABULARY]
    slots[used] = np.arange(len(used))
    sets = [{int(x) for o, s in L._slots_of([t]) for x in slots[s] if x < L.VOCABULARY} for t in texts]
    marks = np.zeros((2, L.VOCABULARY), np.float32)
    for row, t in zip(marks, (0, 1), strict=True):
        row[list(sets[t])] = 1 / np.sqrt(len(sets[t]))
    model = L.Model(slots, marks, rng.standard_normal((2, 3)).astype(np.float32), ["a", "b", "c"])
    names, scores = L._score(model, texts)
    for t, name, score in zip(range(5), names, scores, strict=True):
        if t in (2, 3):
            assert (name, score) == ("und", 0)
            continue
        kernel = np.array([len(sets[t] & sets[m]) / np.sqrt(len(sets[t]) * len(sets[m])) for m in (0, 1)])
        f = kernel @ model.weights
        assert name == model.languages[int(f.argmax())] and abs(score - np.clip(f.max(), 0, 1)) < 1e-5


def test_language_features_do_not_depend_on_the_batch():
    """Each text of a batch has the features it has alone."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij klmnopqrs") for _ in range(rng.randrange(1, 30))) for _ in range(64)] + ["a", "ab", "", "!", "x" * 300]
    slots = np.arange(1 << L._BITS).astype(np.int64) % (L.VOCABULARY + 1)
    alone = np.concatenate([L._presence([t], slots) for t in texts])
    for order in (range(len(texts)), rng.sample(range(len(texts)), len(texts))):
        assert (L._presence([texts[i] for i in order], slots) == alone[list(order)]).all()


def test_language_held_out_accuracy(spark):
    out = L.op1(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = L.fit(odd_docs)
    rows = L.classify(odd_docs, model, "out").select("text", "out.*", "language").collect()
    assert len(rows) == odd_docs.count() and all(r.language == "extra language" for r in rows)
    for r in rows:
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") != letter and (letter or r.score == 0)
    empty = L.fit(no_docs)
    assert empty.languages == [] and {r.out.lang_pred for r in L.classify(odd_docs, empty, "out").select("out").collect()} == {"und"}
    assert L.classify(no_docs, model, "out").count() == 0


def test_fitting_rows_are_bounded_and_never_held_out(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("en").alias("lang"))
    assert L.fitting_rows(df, "doc_id", "text", "lang", 100).count() < 200
    assert df.select(L.held_out().alias("h")).where("h IS NULL").count() == 0
    assert spark.createDataFrame([(None,)], "doc_id long").select(L.held_out()).first()[0] is True


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = Q.op3(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").toPandas()
    rank = out.score.rank()
    good, bad = (out.quality == 1).sum(), (out.quality == 0).sum()
    assert (rank[out.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.99
    assert (out.predicted == out.quality).mean() > 0.98 and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_training_reaches_the_optimum_of_separable_data():
    random.seed(3)
    samples = [(np.array([k % 2, 2 + random.randrange(50), 1 << Q.BITS]), np.array([4.0, 1.0, 1.0]), float(k % 2)) for k in range(400)]
    model = Q.train(samples, alpha=0.5)
    assert model.weights[1] > 0.5 > -0.5 > model.weights[0]


def test_scores_equal_plain_dot_product():
    model = Q.Model(np.random.default_rng(2).standard_normal(1 << Q.BITS).astype(np.float32), 0.25)
    texts = ["a b a!!", None, "", "x", "word " * 50_000]
    for t, s in zip(texts, Q.scores(model, texts), strict=True):
        at, _ = Q.hits([t])
        z = 0.25 + (Q.SCALE * model.weights[at].astype(float).mean() if len(at) else 0)
        assert abs(s - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 0), (None, 1), (6, None), (77, 1)], "doc_id long, quality int")
    model = Q.fit(odd_docs, labels)
    rows = Q.classify(odd_docs, model, name="out").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.out <= 1 and r.score == "extra score" for r in rows)
    assert len({r.out for r in rows if not (r.text or "").strip()}) == 1
    none = Q.fit(odd_docs, labels.limit(0))
    assert {r.out for r in Q.classify(odd_docs, none, name="out").select("out").collect()} == {0.5}
    assert Q.classify(no_docs, model, name="out").count() == 0


def test_language_fit_is_the_ridge_optimum(spark):
    """The gradient of the weighted squared error plus the penalty is zero, for rows counted one by one."""
    rng = random.Random(3)
    words = {lg: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for lg, letters in {"aa": "abcde", "bb": "cdefg", "cc": "xyzab"}.items()}
    rows = [(n, " ".join(rng.choice(words[lg]) for _ in range(8)), lg) for n, lg in enumerate(["aa"] * 60 + ["bb"] * 25 + ["cc"])]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=9)
    assert model.languages == ["aa", "bb", "cc"] and len(model.landmarks) == 7  # three of the first two, the only one of the third
    kernel = (L._unit(L._presence([t for _, t, _ in rows], model.slots)) @ model.landmarks.T).astype(float)
    target = np.array([[lg == k for k in model.languages] for _, _, lg in rows], float)
    weight = len(rows) / (3 * target.sum(0)) @ target.T
    gram = (model.landmarks @ model.landmarks.T).astype(float)
    w = model.weights.astype(float)
    gradient = kernel.T @ (weight[:, None] * (kernel @ w - target)) + L.RIDGE * gram @ w
    assert np.abs(gradient).max() < 1e-3 * np.abs(kernel.T @ target).max()


def test_more_languages_than_landmarks(spark):
    """Every language is learned, also rare ones among hundreds."""
    rng = random.Random(4)
    rows = []
    for k in range(420):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)]
        rows += [(len(rows) + n, " ".join(rng.sample(words, 3)), f"l{k:03d}") for n in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert len(model.languages) == 420 and len(model.landmarks) == 420
    got = L.classify(df, model, "out").where("out.lang_pred = lang").count()
    assert got >= 0.95 * len(rows)
