"""Stages that turn raw documents into packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it again as the next stage's
documents. All but the last return the columns of the documents as they came.

1. language ID: drops texts without a letter and those whose score is below ``language_id.MIN_SCORE``.
2. quality classifier: drops texts that score below ``quality_classifier.THRESHOLD``.
3. n-gram Jaccard join: keeps the row with the smallest id of each class (null ids last; of rows with
   equal id and text one).
4. benchmark decontamination: drops documents with a match.
5. packing: pieces of sequences.

Models learn from the rows that their queries may learn from, as far as those reach the stage. Rows with a null id can be
dropped by the filters like others; decontamination judges them by their text. No rows in: no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm import decontaminate, language_id, ngram_join, packing, quality_classifier
from stageflow.llm.common import fresh, materialize, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "language")
    named = language_id.classify(docs, language_id.fit(docs.where(~language_id.held_out())), name)
    return named.where((F.col(f"{name}.lang_pred") != language_id.UND) & (F.col(f"{name}.score") >= language_id.MIN_SCORE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "quality_score")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~quality_classifier.held_out()))
    return quality_classifier.classify(docs, model, name=name).where(F.col(name) >= quality_classifier.THRESHOLD).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows to keep are found among ids and digests; the texts meet them in one join."""
    rid, key = fresh(docs, "_rid"), fresh(docs, "_key")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(ngram_join.NO_ID))
    seen = materialize(ngram_join.similarity_classes(docs).select(id_.alias(rid), F.col("key").alias(key), "class_key", "n_links"), "unique-classes")
    linked = seen.where("n_links > 0").groupBy("class_key", rid, key).agg(F.count("*").alias("rows"))
    order = F.struct(F.col(rid) == ngram_join.NO_ID, rid, key)
    first = materialize(linked.groupBy("class_key").agg(F.min_by(F.struct(rid, key, "rows"), order).alias("w")).select("w.*"), "unique-first")
    keep = seen.where("n_links = 0").select(rid, key).distinct().unionByName(first.where("rows = 1").select(rid, key))
    rows = docs.withColumn(rid, id_).withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    repeated = rows.join(first.where("rows > 1").select(rid, key), [rid, key], "left_semi").dropDuplicates([rid, key])
    return rows.join(keep, [rid, key], "left_semi").unionByName(repeated).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "contaminated")
    return decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), name).where(~F.col(name)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", identified), ("quality classifier", good), ("n-gram Jaccard join", unique), ("benchmark decontamination", clean), ("packing", packed)]
#: No SQL: the stages are models, hashes and a tokenizer. They are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
