"""Pages with very many links and forms, and streams whose batches fall differently."""

import time

import pytest

from pagequarry.operators import extract, vendors
from pagequarry.streaming import jobs as S


@pytest.mark.parametrize("n", [10_000])
def test_page_with_many_links(spark, n):
    rows = "".join(f'<tr><td><a href="/news.php?id={i}">Record number {i}</a></td></tr>' for i in range(n))
    pages = spark.createDataFrame([(1, "http://a.example.org/", f"<html><table>{rows}</table></html>")], "page_id long, url string, html string")
    start = time.time()
    links = extract.navigation_links(pages).select("href", "text", "context_text").collect()
    assert len(links) == n
    assert all(r["text"] == r["context_text"] and r["text"].startswith("Record number") for r in links)
    assert time.time() - start < 90


def test_page_with_many_forms(spark):
    forms = "".join(f'<p>x</p><form action="/find.php"><input name="q" value="{i}"></form>' for i in range(2_000))
    pages = spark.createDataFrame(
        [(1, "http://a.example.org/", forms), (2, "http://a.example.org/", forms[8:]), (3, "http://a.example.org/", None)],
        "page_id long, url string, html string",
    )
    start = time.time()
    links = extract.navigation_links(pages, with_context=False).select("page_id", "href", "pos").collect()
    assert sorted((r["page_id"], r["pos"]) for r in links)[:2] == [(1, 3), (1, 8)]
    assert sorted(r["pos"] for r in links if r["page_id"] == 2)[:2] == [1, 6]
    assert len(links) == 4_000
    assert time.time() - start < 90


FETCHED = [  # seq, url, local_path, sha256
    (1, "http://a/1", "/d/1", "x"), (2, "http://a/1", "/d/2", "y"), (3, "http://a/3", "/d/3", "y"),
    (4, "http://a/4", "/d/4", None), (5, "http://a/5", "/d/5", None), (6, "http://a/6", "/d/6", "x"), (7, "http://a/3", "/d/7", "z"),
]


@pytest.mark.parametrize("sizes", [(7,), (3, 4), (1, 1, 2, 2, 1)])
def test_index_stream_does_not_depend_on_batches(spark, tmp_path, sizes):
    schema = "seq long, url string, final_url string, local_path string, sha256 string, file_size long, mime_type string, added_at timestamp_ntz"
    rows = [(s, u, u, p, h, 1, "", None) for s, u, p, h in FETCHED]
    at = 0
    for size in sizes:  # one batch a call
        spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        at += size
        S.index_stream(S.table_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/results").orderBy("seq").select("seq", "status", "stored_path").collect()
    want = {1: None, 2: "/d/1", 3: "/d/1", 4: None, 5: None, 6: "/d/1", 7: "/d/1"}
    assert {r["seq"]: r["stored_path"] for r in got} == want
    assert all((r["status"] == "downloaded") == (want[r["seq"]] is None) for r in got)
    index = S.indexed_files(spark, f"{tmp_path}/out").select("local_path").distinct().collect()
    assert {r["local_path"] for r in index} == {"/d/1", "/d/4", "/d/5"}


def test_site_without_hits_is_generic(spark):
    pages = spark.createDataFrame([(1, "http://plain.example.org/", "<p>x</p>")], "page_id long, url string, html string")
    site = pages.selectExpr("'plain.example.org' AS site")
    scores = vendors.vendor_scores(vendors.vendor_matches(pages), sites=site)
    top = vendors.vendor_winner(scores).collect()
    assert [(r["site"], r["vendor_id"], r["score"]) for r in top] == [("plain.example.org", "generic", 0)]
    chosen = scores.limit(1).select("site", "vendor_id")
    bonus = vendors.vendor_scores(vendors.vendor_matches(pages), chosen, site).where("score > 0").collect()
    assert len(bonus) == 1
