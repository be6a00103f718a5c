"""Rules on the shape of a text, and a hashed n-gram likelihood ratio between trusted and raw text.

Only DataFrame functions run here. The words of a text are the runs without ASCII white space.

* Repeated words: three-word windows are hashed to 64 bits. Each hash is packed with its position into one long (upper bits of the hash, lower
  bits the position), the longs are sorted, and neighbours with equal upper bits whose full hashes are equal are repeats. So a text costs
  n log n however often its windows repeat, and nothing is shuffled. A text whose hashes are all distinct has no repeats and isn't sorted.
* Likelihood ratio: words and pairs of words fall into ``buckets`` hash buckets. One pass counts the buckets over all documents and over the
  trusted ones; partial counts make the shuffle a matter of buckets, not of words. The score of a text is the mean of
  log(p_trusted / p_raw) over its words and pairs, and every text at or above ``threshold`` passes.

The trusted ids are a bounded set (``max_trusted``, taken by a hash of the id) and the only rows that are broadcast; the raw counts cover
every document. Null texts, empty texts and texts of blanks have no words: all counts are 0, the base rule fails, the score is 0. Repeated
rows are judged alike, each in its own row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm.common import pin, table

BUCKETS = 10_000
#: Most trusted ids that are broadcast; more are joined by a shuffle. All count.
BROADCAST_IDS = 1_000_000
THRESHOLD = -0.03
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"
_BLANKS = "\t\n\x0b\x0c\r"
#: Bits of a packed long that hold the position of a window.
_PLACE = 26


def words(text: Column) -> Column:
    """Runs without ASCII white space, in order."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS)), " "), "")


def with_repeats(df: DataFrame, w: str = "w") -> DataFrame:
    """Adds ``n_repeat_words``: words in three-word windows that occur twice or more in the text."""
    low = F.lit((1 << _PLACE) - 1).cast("long")
    df = df.withColumn("_g", pin(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    packed = F.sort_array(F.transform("_g", lambda h, i: F.shiftleft(F.shiftright(h, _PLACE), _PLACE).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_p", pin(F.when(F.size(F.array_distinct("_g")) < F.size("_g"), packed).otherwise(F.array().cast("array<bigint>"))))
    head = lambda x: F.shiftright(x, _PLACE)
    df = df.withColumn("_q", pin(F.filter("_p", lambda x, i: F.coalesce(head(x) == head(F.get("_p", i + 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get("_p", i - 1)), F.lit(False)))))
    full = lambda x: F.get("_g", x.bitwiseAND(low).cast("int"))
    df = df.withColumn("_r", pin(F.sort_array(F.transform(
        F.filter("_q", lambda x, i: F.coalesce(full(x) == full(F.get("_q", i + 1)), F.lit(False)) | F.coalesce(full(x) == full(F.get("_q", i - 1)), F.lit(False))),
        lambda x: x.bitwiseAND(low)))))
    covered = F.transform("_r", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_r", i + 1) - x, F.lit(3).cast("long"))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_g", "_p", "_q", "_r")


def shape(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the words ``w`` and the five counts; drops the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, f" {_BLANKS}", "")) > 0)
    df = df.withColumn("w", pin(words(F.col(text_col)))).withColumn("_lines", pin(lines))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(text, f" {_BLANKS}", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return with_repeats(df.drop("_lines", text_col))


def _bucket(buckets: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _next(w: str) -> Column:
    """The words from the second on; zipped with all, each meets the one after it and the last meets null."""
    return F.slice(w, 2, F.size(w))


def bucket_counts(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_IDS) -> DataFrame:
    """(bucket, raw, target): how often each bucket occurs over all rows and over those whose id is in ``trusted`` (distinct)."""
    mark = trusted.select(F.col(trusted.columns[0]).alias("_id"), F.lit(1).alias("_hit"))
    few = mark.limit(most + 1).count() <= most
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(mark) if few else mark, "_id", "left").select("_hit", pin(words(F.col("_t"))).alias("w"))
    pairs = rows.select(F.coalesce("_hit", F.lit(0)).alias("hit"), F.explode(F.arrays_zip(F.col("w").alias("x"), _next("w").alias("y"))).alias("p"))
    return (
        pairs.select("hit", F.explode(F.array(_bucket(buckets, F.col("p.x")), _bucket(buckets, F.col("p.x"), F.col("p.y")))).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target"))
    )


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) of each bucket, with additive smoothing; at most ``buckets`` rows come to the driver."""
    rows = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw, target = (sum(x[k] for x in rows.values()) for k in (0, 1))
    if not target:
        return [0.0] * buckets
    out = []
    for b in range(buckets):
        r, t = rows.get(b, (0, 0))
        out.append(round(math.log((t + smoothing) / (target + smoothing * buckets)) - math.log((r + smoothing) / (raw + smoothing * buckets)), 9))
    return out


def score(w: str, ratios: list[float]) -> Column:
    """Mean log ratio over words and pairs of words (the last word is paired with the end); 0 for a text without words."""
    ratio = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one constant of ``buckets`` doubles
    n = len(ratios)
    total = F.aggregate(
        F.zip_with(w, _next(w), lambda x, y: F.get(ratio, _bucket(n, x)) + F.get(ratio, _bucket(n, x, y))), F.lit(0.0), lambda a, x: a + x
    )
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(total / (2 * F.size(w)))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The distinct ids labelled good."""
    return labels.where(F.col("quality") == 1).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()


def judge(df: DataFrame, ratios: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Adds the five counts, ``base_failed``, ``llr`` and ``kept``; drops the text."""
    out = shape(df, text_col).withColumn("llr", score("w", ratios)).drop("w")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = log_ratios(bucket_counts(docs, trusted_ids(table(spark, sf_dir, "labels"))))
    return judge(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
