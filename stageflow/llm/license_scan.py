"""Licences found by the digest of canonical text.

A text is put in lower case, its copyright lines are dropped, every run of characters that are neither letters nor digits becomes one blank,
and equivalent spellings are made equal. The SHA-256 of what is left is looked up in the digests of known licences, which are computed by
the same expression. The lookup is a hash join with the known digests as the broadcast side; their number is checked
(``MAX_KNOWN``), and no document is shuffled. Each whole line is looked up in the same way, which finds notices inside longer documents.

Null, empty and blank texts, and texts of copyright lines only, have no licence and no notice. Repeated rows keep their number. If two known
texts have the same canonical form, the first identifier in order wins. An empty table gives no rows; other columns are not read.

Whole licences are known in the forms of ``licence_variants``; the SQL knows only ``TEXTS``, so the two agree where no document is such a form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm.common import pin, table
from stageflow.llm.licence_variants import whole_texts
from stageflow.llm.licences import SPELLINGS, TEXTS

#: Most known texts that may be broadcast.
MAX_KNOWN = 20_000
COPYRIGHT = r"(?m)^[^\p{L}\n(©]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that has one; copyright lines have none."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, ""), NOT_WORD, " ")
    for variant, usual in SPELLINGS:
        t = F.replace(t, F.lit(variant), F.lit(usual))
    return F.array_remove(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "")


def known_digests(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license, chars) of the known texts."""
    rows = [(name, t) for name, versions in (whole_texts() if texts is None else texts).items() for t in versions]
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"{len(rows)} known texts; at most {MAX_KNOWN} may be broadcast")
    df = spark.createDataFrame(rows, "license string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return df.select("license", whole.alias("t")).where("t <> ''").groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("t")).alias("chars"))


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license, notices): digest of the canonical text (null if that is empty), the licence it is, or null, and the licences
    that single whole lines name, sorted and joined by commas. known: see ``known_digests``."""
    rows = known.select("digest", "license", "chars").orderBy("digest").limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known digests may be broadcast")
    docs = df.select(F.col(id_col).alias("doc_id"), pin(canonical_lines(F.col(text_col))).alias("lines"))
    docs = docs.select("doc_id", F.sha2(F.nullif(F.array_join("lines", " "), F.lit("")), 256).alias("digest"), "lines")
    if rows:
        names = F.create_map(*[F.lit(x) for r in rows for x in (r["digest"], r["license"])])
        lengths = F.array(*[F.lit(n) for n in sorted({r["chars"] for r in rows})])
        few = F.filter("lines", lambda x: F.array_contains(lengths, F.length(x)))
        found = F.array_sort(F.array_distinct(F.filter(F.transform(few, lambda x: F.try_element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())))
    else:
        found = F.array().cast("array<string>")
    docs = docs.withColumn("notices", F.array_join(found, ",")).drop("lines")
    return docs.join(F.broadcast(known.select("digest", "license")), "digest", "left").select("doc_id", "digest", "license", "notices")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT)}, '', 'g'), {_quoted(NOT_WORD)}, ' ', 'g')"
    for variant, usual in SPELLINGS:
        t = f"replace({t}, {_quoted(variant)}, {_quoted(usual)})"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def sql() -> str:
    rows = ", ".join(f"({_quoted(name)}, {_quoted(t)})" for name, versions in TEXTS.items() for t in versions)
    return f"""WITH known AS (SELECT sha256(t) AS digest, min(license) AS license FROM (SELECT license, array_to_string({_sql_lines('text')}, ' ') AS t FROM (VALUES {rows}) v(license, text)) GROUP BY 1),
docs AS (SELECT doc_id, row_number() OVER () AS k, {_sql_lines('text')} AS lines FROM documents),
whole AS (SELECT doc_id, k, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest FROM docs),
notes AS (SELECT k, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT k, license FROM (SELECT k, unnest(lines) AS line FROM docs) JOIN known ON sha256(line) = digest) GROUP BY k)
SELECT doc_id, whole.digest, license, coalesce(notices, '') AS notices FROM whole LEFT JOIN known ON known.digest = whole.digest LEFT JOIN notes USING (k)"""
