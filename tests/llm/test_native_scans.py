import duckdb
import pytest
from pyspark.sql import functions as F

from stageflow.llm import license_scan as L
from stageflow.llm import url_filter as U
from stageflow.llm.licence_variants import TITLE_LINES, packaged
from stageflow.llm.licences import TEXTS
from tests.check_oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_licences_match_sql(spark, duck):
    assert compare(L.op7(spark, SMALL).toPandas(), duck.execute(L.sql()).df()) is None


def test_urls_match_sql(spark, duck):
    assert compare(U.op5(spark, SMALL).toPandas(), duck.execute(U.sql()).df()) is None


def test_licence_variants(spark):
    mit = TEXTS["MIT"][0]
    texts = [mit, "Copyright (c) 2020 A. Nobody\n\n" + mit.upper().replace(" ", "\n "), mit.replace("sublicense", "sub-licence").replace('"', "'"), mit + " And more.", "text\nReleased under the MIT licence!\nmore\nLICENSED UNDER CC BY 4.0", "© 2021 X"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in L.scan(df, L.known_digests(spark)).collect()}
    assert got[0][0] == got[1][0] == got[2][0] == "MIT"
    assert got[3] == (None, "") and got[4] == (None, "CC-BY-4.0,MIT") and got[5] == (None, "")


def test_whole_licence_files(spark):
    """Files as they are found: title, copyright lines, body; long licences as packaged, without title or appendix, and unwrapped."""
    packed = {name: packaged(name) for name in TITLE_LINES}
    owner = "\n\nCopyright (c) 2020 A. Nobody\nAll rights reserved.\n\n"
    two = TEXTS["BSD-2-Clause"][0]
    texts = [(name, packed[name]) for name in packed]
    texts += [(name, title + owner + TEXTS[name][0]) for name, title in [("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("Zlib", "zlib License")]]
    texts += [("BSD-2-Clause", "# BSD 2-Clause License" + owner + two.replace("1. R", "* R").replace("2. R", "* R"))]
    texts += [("BSD-3-Clause", "BSD 3-Clause License" + owner + two.replace("THIS SOFTWARE", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE", 1))]
    apache, gpl = packed["Apache-2.0"], packed["GPL-2.0"]
    texts += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 A. Nobody")), ("Apache-2.0", apache.split("   APPENDIX")[0]), ("Apache-2.0", apache.split("licenses/", 1)[1])]
    texts += [("Apache-2.0", "\n".join(" ".join(p.split()) for p in apache.split("\n\n"))), ("GPL-2.0", gpl.split("How to Apply")[0]), ("GPL-2.0", gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307"))]
    texts += [("Unlicense", "The Unlicense\n\n" + packed["Unlicense"]), (None, "MIT License" + owner + two), (None, apache.split("   7. ")[0])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in L.scan(df, L.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_licence_odd_rows(spark, odd_docs, no_docs):
    known = L.known_digests(spark)
    rows = L.scan(odd_docs, known).collect()
    assert len(rows) == odd_docs.count() and all(r.license is None for r in rows)
    assert L.scan(no_docs, known).count() == 0
    assert L.scan(odd_docs, L.known_digests(spark, {"X": ["", "the cat sat on the mat and looked at the dog near the door"]})).where("license = 'X'").count() == 2
    assert L.scan(odd_docs, known.limit(0)).count() == odd_docs.count()


def test_host_path_and_rules(spark):
    urls = ["http://A.Example.ORG/es/1?x=/y", "https://example.org/en/19#t", "https://x.org", "ftp://org/", "http://b.com/de/5", "http://com/fr/", "no scheme", None, "http://h?q", "a://b://c/d", "http://notexample.org/es/"]
    df = spark.createDataFrame([(i, u, 0, 0) for i, u in enumerate(urls)], "page_id long, url string, labelled int, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/19", "example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3] == ("org", "/", "org/", "allow") and got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("h", "", None, "allow") and got[9] == ("b:", "//c/d", None, "allow") and got[10][2:] == ("org/", "allow")


def test_template_tree(spark):
    pages = [(i, f"http://h.net/shop/item/{i}", 1, 0) for i in range(40)] + [(100 + i, f"http://h.net/blog/post/{i}/a/b/c", 1, 1) for i in range(40)] + [(200 + i, f"http://h.net/{x}/{i}", 1, 1) for i, x in enumerate("ab" * 20)]
    out = U.judge(spark.createDataFrame([*pages, (999, None, None, None)], "page_id long, url string, labelled int, good int").repartition(5)).collect()
    by = {r.page_id: r for r in out}
    assert by[3].template.startswith("/shop/") and by[3].verdict == "block"
    assert by[103].verdict == "allow" and by[103].template.endswith("/**")
    assert by[200].template == by[201].template == '/a|b|blog/*'  # branches that can't be told apart
    assert by[999].verdict == "allow" and len(out) == len(pages) + 1


def verdicts(spark, pages):
    rows = U.judge(spark.createDataFrame([(i, u, 1, good) for i, (u, good) in enumerate(pages)], "page_id long, url string, labelled int, good int").repartition(5), [])
    return {(u, r.verdict, r.template) for r in rows.collect() for u in [pages[r.page_id][0].rsplit("/", 1)[0]]}


def test_small_branches_of_a_hot_host(spark):
    """41 sections of about 2.4 % each: one of bad pages only among good ones, and the reverse."""
    pages = [(f"http://{host}.net/s{k}/{i}", good ^ (k == 7)) for host, good in [("good", 1), ("bad", 0)] for k in range(41) for i in range(20)]
    got = {u: (v, t) for u, v, t in verdicts(spark, pages)}
    assert got["http://good.net/s7"] == ("block", "/s7/*") and got["http://good.net/s3"][0] == "allow"
    assert got["http://bad.net/s7"] == ("allow", "/s7/*") and got["http://bad.net/s3"][0] == "block"


def test_branches_below_the_levels(spark):
    pages = [(f"http://h.net/a/b/c/d/x{i}/{'bad' if i % 5 == 0 else 'fine'}/{i}", int(i % 5 > 0)) for i in range(200)]
    got = {(u.rsplit("/", 1)[1], v, t) for u, v, t in verdicts(spark, pages)}
    assert got == {("bad", "block", "/*/*/*/*/*/bad/**"), ("fine", "allow", "/*/*/*/*/*/fine/**")}


def test_many_merged_branches(spark):
    """Names stay short, and equal those of a walk over all neighbours."""
    rows = [("h", "", f"s{k:03}", m, g) for k in range(300) for m in [5 + k % 40] for g in [m if k % 3 else k % 2]] + [("h2", "", f"t{k}", 30, 3 * k) for k in range(9)]
    df = spark.createDataFrame(rows, "host string, template string, _seg string, m long, g long").withColumn("_salt", F.lit(3))
    got = {(r.host, r._seg): r._name for r in U._merged(df, 2.0).collect()}
    expected = {}
    for host in ("h", "h2"):
        groups, last = [], None
        for rate, seg, m, g in sorted((g / m, s, m, g) for h, _, s, m, g in rows if h == host):
            if last:
                p = (g + last[1] + 1) / (m + last[0] + 2)
            if not last or abs(rate - last[1] / last[0]) > 2 * (p * (1 - p) * (1 / m + 1 / last[0])) ** 0.5:
                groups.append([])
            groups[-1].append(seg)
            last = (m, g)
        expected |= {(host, x): "|".join(sorted(c)) if len(c) <= U.NAMED else f"{min(c)}|+{len(c) - 1}" for c in groups for x in c}
    assert got == expected and len(set(got.values())) > 2


def test_no_labels_and_no_pages(spark):
    df = spark.createDataFrame([(1, "http://h.net/a", None, None)] * 2, "page_id long, url string, labelled int, good int")
    assert [r.verdict for r in U.judge(df).collect()] == ["allow"] * 2
    assert U.judge(df.limit(0)).count() == 0


def test_native(spark):
    for plan in (L.op7(spark, SMALL), U.op5(spark, SMALL)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text
