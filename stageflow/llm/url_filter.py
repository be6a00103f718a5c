"""Allow or block pages by their addresses: given rules first, then a tree of path templates by host.

Only DataFrame functions run here. Every host has a tree of path segments. Level by level, a segment stays literal if it has
``support`` pages below its parent, however many the parent has, and if its labelled pages differ from the parent's by more than
``deviations`` standard errors; all others become the wildcard ``*``, since rare values are variable and a branch like its parent says nothing of its own. The literal branches
of a parent are put in order of their share of good pages, and neighbours whose shares don't differ by ``deviations`` standard errors
are merged into one branch ``a|b``. Wildcards below ``levels`` that no literal segment follows become one ``**``; the tree goes on there while a node has good and
bad labels. A template is rejected if its smoothed purity (good + weight * prior) / (labelled + weight) is below
``purity``, with the share of good pages over all labels as the prior. Pages of other templates are allowed.

The statistics of a level are counts by (host, template, segment) with partial sums in the map stage. Rows meet them in a join whose
keys are salted with a hash of the path (``SALTS``), so a host with a third of the pages is spread; the statistics are repeated by salt, after
the filter on support. Nothing but two totals reaches the driver.

The SQL also asks for ``SHARE`` of the parent's pages and ends at ``LEVELS``; it agrees where no smaller branch and no deeper one stays literal, as in the test data.

Null addresses and those without ``://`` have empty host and path. Repeated rows are judged alike and each weighs in the counts; labels of ids
that occur repeatedly are summed. Without labels the prior is one half, nothing differs, and purity equals the prior. An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stageflow.llm.common import materialize, table

#: (host, path, verdict) of the rules; the longest that fits decides.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LEVELS, SUPPORT, SHARE, DEVIATIONS, WEIGHT, PURITY = 4, 5, 0.05, 2.0, 5.0, 0.5  # SHARE is a bound of the SQL only
#: Most merged branches whose name lists them all.
NAMED = 20
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains, start of the path) and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _salted(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe equal keys, spread over ``SALTS`` parts of each key."""
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(small, [*keys, "_salt"], "left")


def _merged(branches: DataFrame, deviations: float) -> DataFrame:
    """(host, template, _seg, _name): literal branches with the name of the branch they are merged into.

    Neighbours are compared in order of (rate, segment). Branches of one rate never differ, so only the first and the last of each rate are ordered:
    a parent with m labelled pages has less than m ** (2 / 3) * 2 rates. More than ``NAMED`` merged branches are named by the least and their number."""
    keys = ["host", "template"]
    branches = branches.withColumn("_rate", F.col("g") / F.col("m"))
    pair = F.struct("m", "g")
    rates = branches.groupBy(*keys, "_rate").agg(F.count("*").alias("_n"), F.min("_seg").alias("_least"), F.min_by(pair, "_seg").alias("_first"), F.max_by(pair, "_seg").alias("_last"))
    w, group = Window.partitionBy(*keys).orderBy("_rate"), Window.partitionBy(*keys, "_group")
    rates = rates.withColumn("_before", F.lag("_last").over(w))
    m, g, _m, _g = F.col("_first.m"), F.col("_first.g"), F.col("_before.m"), F.col("_before.g")
    p = (g + _g + 1.0) / (m + _m + 2.0)
    apart = F.abs(F.col("_rate") - _g / _m) > deviations * F.sqrt(p * (1.0 - p) * (1.0 / m + 1.0 / _m))
    rates = rates.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_group", F.sum("_new").over(w))
    rates = rates.select(*keys, "_rate", "_group", F.sum("_n").over(group).alias("_n"), F.min("_least").over(group).alias("_least"))
    rows = materialize(_salted(branches.select(*keys, "_seg", "_rate", "_salt"), rates, [*keys, "_rate"]), "url-branches")  # it is read twice
    few = rows.where(F.col("_n") <= NAMED).groupBy(*keys, "_group").agg(F.sort_array(F.collect_list("_seg")).alias("_segs"))
    few = few.select(*keys, F.explode("_segs").alias("_seg"), F.array_join("_segs", "|").alias("_name"))
    return few.unionByName(rows.where(F.col("_n") > NAMED).select(*keys, "_seg", F.concat("_least", F.lit("|+"), (F.col("_n") - 1).cast("string")).alias("_name")))


def templates(pages: DataFrame, levels: int = LEVELS, support: int = SUPPORT, deviations: float = DEVIATIONS) -> DataFrame:
    """pages: (…, host, path, labelled, good) with counts of labels by row. Adds ``template``."""
    segments = F.array_remove(F.split("path", "/"), "")
    rows = pages.withColumn("_s", segments).withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).withColumn("template", F.lit(""))
    rows = rows.withColumn("_kept", F.lit("")).withColumn("_depth", F.lit(levels))  # the template without wildcards at its end below ``levels``
    done: list[DataFrame] = []
    for d in count():
        rows = materialize(rows.withColumn("_seg", F.get("_s", F.lit(d))), "url-level")  # it is read twice
        stats = rows.where("_seg IS NOT NULL").groupBy("host", "template", "_seg").agg(F.count("*").alias("n"), F.sum("labelled").alias("m"), F.sum("good").alias("g"))
        parent = stats.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"), F.sum("g").alias("all_g"))
        if d >= levels:  # only parents with good and bad labels can have a branch that differs
            open_ = materialize(parent.where((F.col("all_n") >= support) & (F.col("all_g") > 0) & (F.col("all_g") < F.col("all_m"))).select("host", "template", F.lit(True).alias("_open")), "url-open")
            if open_.isEmpty():
                done.append(rows)
                break
            rows = _salted(rows, open_, ["host", "template"])
            on = F.col("_seg").isNotNull() & F.col("_open").isNotNull()
            done.append(rows.where(~on).drop("_open"))
            rows = rows.where(on).drop("_open")
        p = (F.col("all_g") + 1.0) / (F.col("all_m") + 2.0)
        literal = F.abs(F.col("g") - F.col("m") * p) > deviations * F.sqrt(F.col("m") * p * (1.0 - p))
        frequent = stats.where(F.col("n") >= support).withColumn("_salt", F.pmod(F.xxhash64("_seg"), F.lit(SALTS)).cast("int"))
        keep = _merged(_salted(frequent, parent, ["host", "template"]).where(literal), deviations)
        rows = _salted(rows, keep, ["host", "template", "_seg"])
        step = F.when(F.col("_seg").isNull(), "").when(F.col("_name").isNotNull(), F.concat(F.lit("/"), "_name")).otherwise("/*")
        rows = rows.withColumn("template", F.concat("template", step))
        ends = F.lit(True) if d < levels else F.col("_name").isNotNull()
        rows = rows.withColumn("_kept", F.when(ends, F.col("template")).otherwise(F.col("_kept"))).withColumn("_depth", F.when(ends, F.lit(max(levels, d + 1))).otherwise(F.col("_depth"))).drop("_name")
    rows = reduce(DataFrame.unionByName, done)
    return rows.withColumn("template", F.when(F.size("_s") > F.col("_depth"), F.concat("_kept", F.lit("/**"))).otherwise(F.col("_kept"))).drop("_s", "_seg", "_kept", "_depth")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, weight: float = WEIGHT, purity: float = PURITY, **tree: float) -> DataFrame:
    """pages: (page_id, url, labelled, good). Returns (page_id, host, path, rule, verdict, template)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("good", F.lit(0)).alias("good"))
    labelled, good = rows.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = (good + 1.0) / (labelled + 2.0)
    rows = materialize(templates(rows, **tree), "url-templates")
    smoothed = (F.sum("good") + weight * prior) / (F.sum("labelled") + weight)
    rejected = rows.groupBy("host", "template").agg(smoothed.alias("purity")).where(F.col("purity") < purity).select("host", "template", F.lit("block").alias("_tree"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    out = _salted(rows, rejected, ["host", "template"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "_tree", F.lit("allow")).alias("verdict"), "template")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the label counts of the document that a page shows: the number in the last segment of its path is the document's id."""
    path = host_and_path(F.col("url"))[1]
    by_doc = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("labelled"), F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    rows = pages.select("page_id", "url", F.regexp_extract(path, "/([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("bigint").alias("_doc"))
    return rows.join(by_doc, "_doc", "left").drop("_doc")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))


def sql() -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True)) + " END"
    out = f"""WITH u AS (SELECT page_id, {rest} AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, count(*) AS labelled, sum(CAST(quality = 1 AND toxic = 0 AS INTEGER)) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
r0 AS (SELECT page_id, host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s, coalesce(labelled, 0) AS labelled, coalesce(good, 0) AS good, '' AS template
  FROM p LEFT JOIN l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})[^0-9/]*/?$', 1) AS BIGINT)),
t AS (SELECT (coalesce(sum(good), 0) + 1e0) / (coalesce(sum(labelled), 0) + 2e0) AS prior FROM r0)"""
    for d in range(LEVELS):
        out += f""",
x{d} AS (SELECT *, s[{d + 1}] AS seg FROM r{d}),
c{d} AS (SELECT host, template, seg, count(*) AS n, sum(labelled) AS m, sum(good) AS g FROM x{d} WHERE seg IS NOT NULL GROUP BY ALL),
d{d} AS (SELECT host, template, sum(n) AS nn, sum(m) AS mm, (sum(g) + 1e0) / (sum(m) + 2e0) AS q FROM c{d} GROUP BY ALL),
k{d} AS (SELECT host, template, seg, m, g FROM c{d} JOIN d{d} USING (host, template) WHERE n >= {SUPPORT} AND n >= CAST({SHARE} AS DOUBLE) * nn AND abs(g - m * q) > {DEVIATIONS:e} * sqrt(m * q * (1e0 - q))),
l{d} AS (SELECT *, lag(m) OVER w AS pm, lag(g) OVER w AS pg FROM k{d} WINDOW w AS (PARTITION BY host, template ORDER BY g / m, seg)),
a{d} AS (SELECT *, (g + pg + 1e0) / (m + pm + 2e0) AS q FROM l{d}),
g{d} AS (SELECT *, sum(CAST(coalesce(abs(g / m - pg / pm) > {DEVIATIONS:e} * sqrt(q * (1e0 - q) * (1e0 / m + 1e0 / pm)), false) AS INTEGER)) OVER (PARTITION BY host, template ORDER BY g / m, seg) AS grp FROM a{d}),
n{d} AS (SELECT host, template, unnest(list(seg)) AS seg, string_agg(seg, '|' ORDER BY seg) AS name FROM g{d} GROUP BY host, template, grp),
r{d + 1} AS (SELECT x{d}.* EXCLUDE (seg, template), x{d}.template || CASE WHEN x{d}.seg IS NULL THEN '' WHEN n{d}.seg IS NOT NULL THEN '/' || n{d}.name ELSE '/*' END AS template
  FROM x{d} LEFT JOIN n{d} ON n{d}.host = x{d}.host AND n{d}.template = x{d}.template AND n{d}.seg = x{d}.seg)"""
    return out + f""",
f AS (SELECT page_id, host, path, labelled, good, template || CASE WHEN len(s) > {LEVELS} THEN '/**' ELSE '' END AS template FROM r{LEVELS}),
b AS (SELECT host, template FROM f, t GROUP BY host, template, prior HAVING (sum(good) + {WEIGHT:e} * prior) / (sum(labelled) + {WEIGHT:e}) < {PURITY:e})
SELECT page_id, f.host, path, {rule.replace('host', 'f.host')} AS rule, coalesce({verdict.replace('host', 'f.host')}, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict, f.template
FROM f LEFT JOIN b ON b.host = f.host AND b.template = f.template"""
