"""Navigation links are found in one pass over the pages, whatever the channels."""

from pyspark.sql import functions as F

import __spark_entry__ as contract

from pagequarry.operators import extract, topics, vendors
from pagequarry.functions.text import clean_text

HTML = """<UL><LI><A HREF="/news.php?cat_id=3"><img src="m.gif" ALT="Menu"></A></LI></UL><lİ>x</lİ>
<a href="javascript:popup('/view.php?id=5')">open</a><td data-url="/d?id=1">d</td><div onclick="window.open('/o.php?id=2')">o</div>
<meta http-equiv="refresh" content="0;url=/r"><form action="/f?a=1"><input name="q" value="z"></form><FORM method=post action="/p"></FORM>"""


def _pages(spark):
    return spark.createDataFrame([(1, "http://a.example.org/", HTML), (2, "http://a.example.org/", None)], "page_id long, url string, html string")


def test_one_pass(spark, tmp_path):
    _pages(spark).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    links = extract.navigation_links(pages)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    found = {r["canon"].removeprefix("http://a.example.org"): (r["via"], r["text"]) for r in links.collect()}
    assert found == {
        "/news.php?cat_id=3": ("href+href-loose+javascript-string", ""),
        "/view.php?id=5": ("href-javascript+href-loose-javascript+javascript-string", "open"),
        "/d?id=1": ("data-url+javascript-string", ""), "/o.php?id=2": ("onclick+javascript-string", ""), "/r": ("meta-refresh", ""), "/f?a=1&q=z": ("form-get", ""),
    }


def test_topics_keep_their_pages(spark):
    pages = _pages(spark)
    got = topics.category_links(extract.navigation_links(pages, with_context=False), topics.menu_labels(pages)).collect()
    assert [(r["page_id"], r["topic_url"], r["title"]) for r in got] == [(1, "http://a.example.org/news.php?cat_id=3", "Menu")]


def test_clean_text_keeps_its_order(spark):
    texts = ["&lt;b&gt;x&lt;/b&gt; &AMP;lt; y", "a<SCRIPT>1</SCRIPT>b<style>2</style>c", "", None, "1 &#60;i&#62; 2&nbsp;&#38;lt;3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", clean_text(F.col("t")).alias("c"))
    assert [r["c"] for r in rows.orderBy("i").collect()] == ["x &lt; y", "a b c", "", "", "1 2 &lt;3"]


def test_vendor_text_once(spark):
    text = vendors.vendor_matches(_pages(spark))._jdf.queryExecution().analyzed().toString()
    assert text.count("(?i)<style[\\s\\S]*?</style>") == 1


def test_frontier_links_once(spark):
    query = contract.queries()["frontier"](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    # the page key comes out of a generator, through which no filter goes
    assert any("Generate" in line and "mc_cid" in line for line in plan.split("\n"))
