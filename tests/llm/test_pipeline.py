import corpus_pipeline as C
from pyspark.sql import functions as F

from stageflow.llm import language_id, quality_classifier
from tests.llm.test_similarity import brute_classes

SMALL = "/root/testdata/sf0.001"


def stage(name):
    return dict(C.STAGES)[name]


def test_stages_and_registration(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and len(names) == 10 and "pipeline" in e.queries()
    assert len(C.STAGES) == 5


def test_near_duplicates_keep_one_of_each_class(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[50:]), "alone here", "alone here", None, None, "", ""]
    docs = [(10 - i, t) for i, t in enumerate(texts)] + [(2, "other"), (2, "other"), (None, " ".join(base)), (None, "nameless text"), (None, "nameless text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_key", F.lit("extra")).withColumn("rows", F.lit(1))
    out = stage("n-gram Jaccard join")(spark, df, SMALL)
    assert out.columns == df.columns
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.where("text <> ''").collect())
    assert rows == [(-1, "nameless text"), (2, "other"), (6, "alone here"), (8, texts[2]), (9, texts[1])]
    assert out.where("text IS NULL OR text = ''").count() == 4
    assert len(brute_classes([(i, t) for i, (_, t) in enumerate(docs) if t])) == 10


def test_whole_run_equals_its_parts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = language_id.fit(docs.where(~language_id.held_out()))
    names, scores = language_id._score(model, list(texts.values()))
    left = {d for d, n, s in zip(texts, names, scores, strict=True) if n != "und" and s >= language_id.MIN_SCORE}
    after = stage("language ID")(spark, docs, SMALL).cache()
    assert {r.doc_id for r in after.collect()} == left and after.columns == docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(~quality_classifier.held_out())
    model = quality_classifier.fit(after, labels)
    left = {d for d in left if quality_classifier.scores(model, [texts[d]])[0] >= quality_classifier.THRESHOLD}
    after = stage("quality classifier")(spark, after, SMALL).cache()
    assert {r.doc_id for r in after.collect()} == left
    left = {c for _, c, _ in brute_classes([(d, texts[d]) for d in sorted(left)])}
    after = stage("n-gram Jaccard join")(spark, after, SMALL).cache()
    assert {r.doc_id for r in after.collect()} == left
    final = C.run(spark, SMALL)
    clean = {r.doc_id for r in stage("benchmark decontamination")(spark, after, SMALL).collect()}
    assert clean <= left and {r.doc_id for r in final.select("doc_id").distinct().collect()} == clean


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for _, f in C.STAGES[:-1]:
        assert f(spark, odd_docs, SMALL).columns == odd_docs.columns
        assert f(spark, no_docs, SMALL).count() == 0
        f(spark, odd_docs, SMALL).collect()
