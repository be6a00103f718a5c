import hashlib
import zlib
from bisect import bisect_right

from pyspark.sql import functions as F

from stageflow.llm import sharding


def check(rows, docs, n):
    texts = [(t or "").encode() for _, t in docs]
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(0 <= r.shard < n for r in rows)


def test_contract_on_odd_rows(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for n in (1, 3, 16):
        check(sharding.shard(odd_docs, n).collect(), docs, n)


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0


def test_equals_plain_cuts_without_copies(spark):
    docs = [(i, f"text {i} " * (1 + i * 7 % 23)) for i in range(400)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 8, whole=0.0).collect()
    check(rows, docs, 8)
    order = sorted(docs, key=lambda d: (hashlib.md5(d[1].encode()).digest(), d[0]))
    sizes = [len(t) + 1 for _, t in order]
    targets, at, expected = [sum(sizes) * k // 8 for k in range(1, 8)], 0, {}
    for (i, _), s in zip(order, sizes, strict=True):
        expected[i] = bisect_right([2 * t for t in targets], 2 * at + s)
        at += s
    assert {r.doc_id: r.shard for r in rows} == expected


def test_equal_texts_stay_together_unless_large(spark):
    docs = [(i, f"text {i // 2}") for i in range(2000)] + [(10_000 + i, "hot " * 4) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard(df, 8)
    sizes = [r.s for r in rows.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.12 * sum(sizes) / 8
    pairs = rows.where("doc_id < 10000").groupBy((F.col("doc_id") / 2).cast("long")).agg(F.countDistinct("shard").alias("k"))
    assert pairs.where("k > 1").count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, sharding.shard(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4
