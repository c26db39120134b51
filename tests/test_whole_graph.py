"""Sitemaps, closures and crawls beyond the sizes that used to be cut."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pagequarry.operators import graph as G
from pagequarry.plans.link_queries import seeds_view
from pagequarry.plans.views import Tables
from pagequarry.sources.buckets import BucketStore, KnownKeys

SITE = "http://a.example.org"


def test_sitemap_of_6000_pages_and_33_levels(spark):
    def loc(u):
        return f"<url><loc>{u}</loc></url>"

    urls = "".join(loc(f"{SITE}/p/{i}") for i in range(6_000))
    rows = [(f"{SITE}/m{i}.xml", loc(f"{SITE}/m{i + 1}.xml") + loc(f"{SITE}/q/{i}")) for i in range(33)] + [(f"{SITE}/m0.xml", urls)]
    maps = spark.createDataFrame(rows, "map_url string, xml string")
    starts = spark.createDataFrame([("a.example.org", f"{SITE}/m0.xml")], "site string, map_url string")
    got = [r["loc"] for r in G.sitemap_urls(maps, starts).collect()]
    want = {f"{SITE}/p/{i}" for i in range(6_000)} | {f"{SITE}/q/{i}" for i in range(33)}
    assert len(got) == len(want) and set(got) == want
    maps = maps.where(f"map_url < '{SITE}/m1.xml' OR map_url IN ('{SITE}/m1.xml', '{SITE}/m2.xml', '{SITE}/m3.xml')")
    assert G.sitemap_urls(maps, starts, 1, 5_000).count() == 5_000
    some = {r["loc"] for r in G.sitemap_urls(maps, starts, max_maps=3).collect()}
    assert some == {f"{SITE}/p/{i}" for i in range(6_000)} | {f"{SITE}/q/{i}" for i in range(3)}


def test_reach_of_15_levels(spark):
    edges = spark.createDataFrame([("h", i, i + 1) for i in range(15)] + [("h", 15, 3)], "host string, src long, dst long")
    roots = spark.createDataFrame([("h", 0, 0)], "host string, node long, depth int")
    want = [(i, i, i - 1 if i else None) for i in range(16)]
    pick = lambda df: sorted((r["node"], r["depth"], r["discovered_from"]) for r in df.collect())
    assert pick(G.reach(edges, roots, ["host"])) == want
    assert pick(G.reach(edges, roots, ["host"], max_depth=12)) == want[:13]


def test_css_closure_broadcasts_nothing(spark, monkeypatch):
    levels, cut = [], G.cut_lineage

    def watched(df):
        out = cut(df)
        if "depth" in df.columns and "discovered_from" in df.columns:
            levels.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(G, "cut_lineage", watched)
    sheets = [(f"{SITE}/{i}.css", f"@import '{SITE}/{2 * i + 1}.css'; @import '{SITE}/{2 * i + 2}.css'; a{{b:url(/i/{i % 3}.png)}}") for i in range(6)]
    start = spark.createDataFrame([(f"{SITE}/0.css",)], "url string")
    out = G.css_closure(spark.createDataFrame(sheets, "url string, css string"), start)
    got = {r["node"]: r["depth"] for r in out.collect()}
    want = {f"{SITE}/{i}.css": (i + 1).bit_length() - 1 for i in range(13)} | {f"{SITE}/i/{k}.png": d for k, d in ((0, 1), (1, 2), (2, 2))}
    assert got == want
    # an address is small when shuffled and large in the driver's memory
    assert levels and not any("Broadcast" in p for p in levels)


def test_crawl_of_20_levels_resumes_behind_the_last(spark, tmp_path):
    page = lambda i: f"{SITE}/p/{i}"
    pairs = [(page(i), page(i + 1)) for i in range(20)] + [(page(20), page(3)), (page(5), page(0)), (page(2), page(4))]
    links = spark.createDataFrame(pairs + [(f"{SITE}/s/1", f"{SITE}/s/2")], "src string, dst string")
    roots = spark.createDataFrame([(page(0),), ("",), (None,)], "node string")
    listed = spark.createDataFrame([(f"{SITE}/s/1",), (page(1),), (page(0),), ("",)], "node string")
    got = {r["node"]: (r["depth"], r["discovered_from"]) for r in G.crawl(links, roots, listed, f"{tmp_path}/a").collect()}
    want = {page(0): (0, None), page(1): (1, "sitemap"), f"{SITE}/s/1": (1, "sitemap"), f"{SITE}/s/2": (2, f"{SITE}/s/1")}
    want |= {page(2): (2, page(1)), page(3): (3, page(2)), page(4): (3, page(2))} | {page(i): (i - 1, page(i - 1)) for i in range(5, 21)}
    assert got == want
    assert G.crawl(links, roots, listed, f"{tmp_path}/b", max_depth=4).count() == sum(d <= 4 for d, _ in want.values())
    # what an attempt that broke off has left is not read
    spark.range(3).write.parquet(f"{tmp_path}/b/level-5-broken")
    again = G.crawl(links.limit(0), roots, listed, f"{tmp_path}/b")
    assert {r["node"]: (r["depth"], r["discovered_from"]) for r in again.collect()} == want
    with pytest.raises(ValueError, match="other roots"):
        G.crawl(links, listed, None, f"{tmp_path}/b")


def test_levels_move_no_links_and_no_known_pages(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s")
    links = store.save(spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(50)], "src string, dst string"), "links", "src")
    level = store.save(spark.createDataFrame([("a1",)], "node string"), "level", "node")
    known = KnownKeys(store, "node")
    for i in range(9):
        known.add(store.save(spark.createDataFrame([(f"a{i}",)], "node string"), f"k{i}", "node"), 1)
    assert len(known.parts) <= 4 and sum(n for n, _ in known.parts) == 9
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = level.select(F.col("node").alias("src")).join(links, "src").groupBy(F.col("dst").alias("node")).count()
        fresh = known.unknown(found)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        # the only exchange is that of the found pages
        assert plan.count("Exchange") == 1, plan
        assert [r["node"] for r in level.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).collect()] == ["a2"]
        assert fresh.isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pagination_of_all_categories_against_brute_force(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    seeds = {r["seed_url"] for r in seeds_view(t).collect()}
    edges = {}
    for url, html in ((r["url"], r["html"]) for r in t.html.select("url", "html").collect()):
        listing = url.split("&id=")[0]
        found = re.findall(r'href="/news/\?cid=(\d)&amp;page=(\d)"', html) + re.findall(r'name="cid" value="(\d)"><input name="page" value="(\d)"', html)
        edges.setdefault(listing, set()).update(f"{listing}&page={page}" for cid, page in found if listing.endswith(f"cid={cid}"))
    want = {(s, s, 0) for s in seeds} | {(s, n, 1) for s in seeds for n in edges.get(s, ())}
    got = [(r["seed_url"], r["node"], r["depth"]) for r in contract.queries()["pagination_closure"](spark, t.sf_dir).collect()]
    assert {s.rsplit("cid=", 1)[1] for s in seeds} == set("01234")
    assert sorted(got) == sorted(want)
