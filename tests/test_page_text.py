"""Texts of pages with and without a content block."""

import duckdb
from pyspark.sql import functions as F

from pagequarry.operators import content
from pagequarry.plans import content_queries
from pagequarry.plans.registry import CHECKS
from pagequarry.plans.views import Tables

SF = "/root/testdata/sf0.001"


def test_pages_without_a_block_keep_their_text(spark):
    words = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, "<html><body><nav>menu</nav><p>alone in the body</p><footer>end</footer></body></html>", None), (2, "<body><main>in <b>main</b></main>out</body>", "short"),
        (3, f"<body><p>{words}</p></body>", ""), (4, "<body>x</body>", f"<div>{words}</div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, html string, block string")
    got = {r[0]: r[1] for r in pages.select("page_id", content.page_text(F.col("html"), F.col("block"), F.lit(""))).collect()}
    assert got == {1: "alone in the body", 2: "in main", 3: words, 4: words}
    cut = pages.select("page_id", content.page_text(F.col("html"), F.col("block"), F.lit(""), 50_000)).where("page_id > 2").collect()
    assert [r[1] for r in cut] == [words[:50_000]] * 2


def test_query_gives_the_fallback(spark, monkeypatch):
    class Few(Tables):
        all_pages = spark.createDataFrame(
            [(1, "http://a.example.org/", "<body><nav>menu</nav><p>alone in the body</p></body>"), (2, "http://a.example.org/", "<body><article><p>twenty characters and more</p></article></body>")],
            "page_id long, url string, html string",
        )

    rows = content_queries.page_text(Few(spark, SF)).collect()
    assert {r["page_id"]: (r["from_block"], r["detail_text"]) for r in rows} == {1: (False, "alone in the body"), 2: (True, "twenty characters and more")}


def test_query_equals_its_sql_on_short_articles(spark, tmp_path):
    head, menu = "<html><head><title>Short.</title><style>p{}</style></head>", "<nav>menu</nav><div>advert</div>"
    pages = [
        (1, "http://a.example.org/1", f"{head}<body>{menu}<article><h1>Short.</h1></article><footer>end</footer></body></html>"),
        (2, "http://a.example.org/2", f"{head}<body>{menu}<article><h1>Short.</h1></article><footer>end</footer>"),
        (3, "http://a.example.org/3", f"{head}<body>{menu}<article>twenty characters and more</article></body></html>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{SF}/part.parquet").limit(3).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    for name in ("pages", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(CHECKS["page_text"]).fetchall())
    rows = content_queries.page_text(Tables(spark, str(tmp_path))).collect()
    assert sorted((r["page_id"], r["from_block"], r["detail_text"]) for r in rows) == want
    assert (1, False, "Short. advert Short.") in want
