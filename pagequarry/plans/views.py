"""Inputs of the named queries: tables and deterministic views over them.

The views turn the benchmark tables into the row shapes the jobs expect
(pages with media and forms, audit rows, file bodies, ...).  Each is a plain
projection, so a job's work grows with the table behind it.  The SQL text is
shared with the DuckDB checks, which differ only in the dialect arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AUDIT = """
SELECT event_id AS seq,
       CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS run_id,
       concat('section_', CAST(user_id % 4 AS VARCHAR(20))) AS section_key,
       concat('https://h', CAST(user_id % 10 AS VARCHAR(20)), '.example.org/files/',
              CAST(user_id AS VARCHAR(20)), '-', CAST(k % 3 AS VARCHAR(20)),
              CASE k % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.docx' ELSE '.mp4' END,
              CASE WHEN event_id % 3 = 0 THEN '#p' ELSE '' END) AS file_url,
       CASE event_type
         WHEN 'click' THEN 'downloaded' WHEN 'view' THEN 'already_exists' WHEN 'signup' THEN 'not_found'
         WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'referenced_embed' WHEN 1 THEN 'skipped_external' ELSE 'invalid_content' END
         ELSE CASE k % 6 WHEN 0 THEN 'forbidden' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'server_error'
                         WHEN 3 THEN 'timeout' WHEN 4 THEN 'network_error' ELSE 'empty_file' END
       END AS status,
       CASE event_type WHEN 'signup' THEN 'HTTP 404 on file'
         WHEN 'error' THEN CASE k % 6 WHEN 0 THEN 'HTTP 403 on file' WHEN 1 THEN 'HTTP 429 on file' WHEN 2 THEN 'HTTP 503 on file'
                                      WHEN 3 THEN 'connect ETIMEDOUT' WHEN 4 THEN 'read ECONNRESET' ELSE 'empty body' END
       END AS error_message,
       value AS file_kb, ts AS checked_at
FROM (SELECT event_id, ts, user_id, event_type, value,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

ASSETS = """
SELECT doc_id AS seq, concat('https://', source, '.example.org/d/', CAST(doc_id AS VARCHAR(20))) AS url,
       text AS content, n_chars AS file_size, lang, source AS site
FROM documents
"""

DATES = """
SELECT o_orderkey AS rec_id, CAST(o_orderdate AS DATE) AS expected_date,
       concat(CAST(day(o_orderdate) AS VARCHAR(2)), ' ',
         CASE month(o_orderdate) WHEN 1 THEN 'มกราคม' WHEN 2 THEN 'ก.พ.' WHEN 3 THEN 'มีนาคม' WHEN 4 THEN 'เม.ย.'
           WHEN 5 THEN 'พฤษภาคม' WHEN 6 THEN 'มิ.ย.' WHEN 7 THEN 'กรกฎาคม' WHEN 8 THEN 'ส.ค.' WHEN 9 THEN 'กันยายน'
           WHEN 10 THEN 'ต.ค.' WHEN 11 THEN 'พฤศจิกายน' ELSE 'ธ.ค.' END, ' ',
         CAST(year(o_orderdate) + 543 AS VARCHAR(4))) AS raw_text
FROM orders
"""

IDS = """
SELECT concat('cat_', CAST(o_custkey % 20 AS VARCHAR(20))) AS category, o_orderkey AS detail_id
FROM orders WHERE o_orderkey % 7 <> 0
"""

ALBUM = """
SELECT DISTINCT l_orderkey AS album_id, l_linenumber AS pos,
       concat(CASE WHEN l_linenumber % 2 = 0 THEN 't_' ELSE '' END, 'img_',
              CAST(CAST(ceil(l_linenumber / 2.0) AS INT) AS VARCHAR(20)), '.jpg') AS image_name
FROM lineitem
"""

BODIES = """
SELECT p_partkey AS seq, concat('file_', CAST(p_size AS VARCHAR(20))) AS file_name, p_brand AS directory,
       unhex(CASE p_partkey % 9 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '504B03040000' WHEN 2 THEN 'D0CF11E0A1B11AE1'
         WHEN 3 THEN 'FFD8FFE0' WHEN 4 THEN '89504E470D0A1A0A' WHEN 5 THEN '474946383961' WHEN 6 THEN '3C68746D6C3E'
         WHEN 7 THEN '00000018667479706D703432' ELSE '010203' END) AS content,
       CASE p_partkey % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' ELSE '' END AS declared_type
FROM part
"""

REGISTRY = """
SELECT p_partkey AS seq, p_brand AS table_name, p_name AS full_title,
       concat('https://', lower(p_type), '.example.org/?cat_id=', CAST(p_size AS VARCHAR(20))) AS source_url
FROM part
"""

HTML = """
SELECT p_partkey AS page_id,
       concat('https://www.site', CAST(p_size % 10 AS VARCHAR(20)), '.example.org/news/?cid=',
              CAST(p_size % 5 AS VARCHAR(20)), '&id=', CAST(p_partkey AS VARCHAR(20))) AS url,
       concat('<html><head><title>', p_name, ' | site</title><meta property="og:title" content="', p_name, '"></head><body>',
         '<div class="breadcrumb"><a href="/">Home</a> » <a href="/news/?cid=', CAST(p_size % 5 AS VARCHAR(20)), '">', p_type, '</a></div>',
         '<h1>', p_name, '</h1><div class="detail">total ', CAST(p_size AS VARCHAR(20)), ' about ', p_brand, '</div>',
         '<table><tr><td><a href="?cid=', CAST(p_size % 5 AS VARCHAR(20)), '&amp;id=', CAST(p_partkey + 1 AS VARCHAR(20)), '">',
         p_name, ' item</a> เมื่อ ', CAST(p_partkey % 28 + 1 AS VARCHAR(20)), ' มิ.ย. 2569</td></tr></table>',
         CASE p_partkey % 6
           WHEN 0 THEN concat('<a href="/files/doc', CAST(p_partkey % 50 AS VARCHAR(20)), '.pdf">download</a>')
           WHEN 1 THEN concat('<a class="glightbox" href="/gallery/a/img_', CAST(p_partkey AS VARCHAR(20)), '.jpg"><img src="/gallery/a/thumb/t_img_',
                              CAST(p_partkey AS VARCHAR(20)), '.jpg" width="120" height="90"></a>')
           WHEN 2 THEN concat('<video><source src="/media/v', CAST(p_size AS VARCHAR(20)), '.mp4" type="video/mp4"></video>')
           WHEN 3 THEN concat('<iframe src="https://www.youtube.com/embed/x', CAST(p_size AS VARCHAR(20)), '"></iframe>')
           WHEN 4 THEN concat('<div onclick="window.open(', chr(39), '/news/view.php?id=77', chr(39), ')">open record</div><img src="/images/logo.png">')
           ELSE '<style>body{background:url(/img/page.png)}</style><form method="get" action="/news/"><input name="cid" value="2"><input name="page" value="3"></form>'
         END,
         '<a href="https://other.example.net/x', CAST(p_size AS VARCHAR(20)), '.docx?utm_source=a#s">attachment</a>',
         '<a href="/news/?cid=', CAST(p_size % 5 AS VARCHAR(20)), '&amp;page=2">2</a><footer>',
         CASE WHEN p_size % 10 = 3 THEN 'PASWORLD COMMUNICATION' ELSE 'site' END, '</footer></body></html>') AS html
FROM part
"""

_SPARK_DIALECT = {"VARCHAR(20)": "STRING", "VARCHAR(10)": "STRING", "VARCHAR(4)": "STRING", "VARCHAR(2)": "STRING"}


class Tables:
    """Benchmark tables of one scale folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, sql: str, *tables: str) -> DataFrame:
        """Run view SQL with its tables bound by name to this folder."""
        for wide, plain in _SPARK_DIALECT.items():
            sql = sql.replace(wide, plain)
        for name in tables:
            sql = sql.replace(f"FROM {name}", f"FROM parquet.`{self.sf_dir}/{name}.parquet`")
        return self.spark.sql(sql)

    @property
    def pages(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", "html")

    @property
    def html(self) -> DataFrame:
        return self.built_pages(HTML)

    def built_pages(self, sql: str) -> DataFrame:
        """Pages built from ``part``, whose few files are spread over the
        cores first, while the rows are still a few bytes each."""
        rows, cores = self.table("part"), self.spark.sparkContext.defaultParallelism
        rows.repartition(cores, "p_partkey").createOrReplaceTempView("part_rows")
        return self.view(sql.replace("FROM part", "FROM part_rows"))

    @property
    def all_pages(self) -> DataFrame:
        """Raw pages and constructed ones; constructed ids are negative."""
        return self.pages.unionByName(self.html.selectExpr("-page_id - 1 AS page_id", "url", "html"))

    @property
    def audit(self) -> DataFrame:
        return self.view(AUDIT, "events")

    @property
    def assets(self) -> DataFrame:
        return self.view(ASSETS, "documents")

    @property
    def dates(self) -> DataFrame:
        return self.view(DATES, "orders")

    @property
    def ids(self) -> DataFrame:
        return self.view(IDS, "orders")

    @property
    def album(self) -> DataFrame:
        return self.view(ALBUM, "lineitem")

    @property
    def bodies(self) -> DataFrame:
        return self.view(BODIES, "part")

    @property
    def registry(self) -> DataFrame:
        return self.view(REGISTRY, "part")
