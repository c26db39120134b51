"""The frontier leaves out the resources of raw pages too, each for the page that holds it."""

import duckdb

import __spark_entry__ as contract
import oracle

from pagequarry import fixed_values as fv
from pagequarry.operators import media

HOST = "https://odd.example.net"
PAGES = [
    (1, "/a", '<a href="/get?id=1">Download the form</a><a href="/plain?id=2">view</a><a href="/watch?id=3" class="video-link">x</a>'),
    (2, "/b", '<a href="/get?id=1">see</a><img src="/image/4"><a href="/image/4">photo</a><img src="/i?id=7"><a href="/i?id=7">seven</a>'),
    (3, "/c", '<video src="/stream/5"></video><a href="/stream/5">s</a><div style="background:url(/image/bg)"><a href="/image/bg">bg</a>'),
    (4, "/d", '<A class="attachment" HREF="/w?id=1&utm_source=z#top">w</A><a href="/logo?id=1" title="video icon">n</a>'),
    (5, "/e", None),
]


def test_resources_of_raw_pages(spark, tmp_path):
    rows = [(i, HOST + path, html) for i, path, html in PAGES]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(12).write.parquet(f"{tmp_path}/part.parquet")
    got = contract.queries()["frontier"](spark, str(tmp_path))
    found = {(r["link"].removeprefix(HOST), r["discovered_from"].removeprefix(HOST)) for r in got.where(f"link LIKE '{HOST}%'").collect()}
    assert found == {("/plain?id=2", "/a"), ("/get?id=1", "/b"), ("/i?id=7", "/b"), ("/logo?id=1", "/d")}
    con = duckdb.connect()
    for name in ("pages", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ok, message = oracle.compare(got, con, contract.oracle_sql()["frontier"])
    assert ok, message


def test_page_like_assets_are_those_without_extension(spark):
    odd = [(9, "/f", '<a href="/y#z.pdf">y</a><script>var a = "/q#r.pdf";</script><a href="/k.pdf?utm_source=1">file</a><a data-video="/v" href="/u">u</a>')]
    rows = [(i, HOST + path, html) for i, path, html in PAGES + odd]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = media.page_assets(pages).where(f"file_key <> '' AND NOT file_key RLIKE r'(?i){fv.CRAWL_ASSET_EXT}'").select("page_id", "file_key")
    got = media.page_like_assets(pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert (9, HOST + "/q") in set(map(tuple, got.collect()))
    # only labelled anchors are read beside the media
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "data-lazy-src" not in plan and "download-anchor" in plan
