"""Queries over stored tables: sinks read back, registry, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pagequarry.functions import urls as U
from pagequarry.operators import file_index as X
from pagequarry.operators import files as I
from pagequarry.operators import reconcile as R
from pagequarry.plans import duck as D
from pagequarry.plans import views as V
from pagequarry.plans.audit_queries import _FETCHED, _MEASURES, index_view
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables
from pagequarry.session import work_dir
from pagequarry.sources import corpus, sinks

c = F.col
_LINE = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' , https://s' || p_size || '.example.org/?cat_id=' || p_partkey WHEN 1 THEN p_name || chr(9) || 'https://s' || p_size || '.example.org/' || p_partkey WHEN 2 THEN '  https://s' || p_size || '.example.org/x ' WHEN 3 THEN 'no link here' WHEN 4 THEN p_name || ' https://a b' ELSE '' END"


@plan(f"""WITH l AS (SELECT p_partkey AS seq, trim({_LINE}) AS line FROM part), s AS (SELECT seq, CASE WHEN {D.rx('line', r'^(.*?)[,|\t]\s*(https?://\S+)$')} THEN trim({D.extract('line', r'^(.*?)[,|\t]\s*https?://\S+$')}) ELSE '' END AS title,
  {D.extract('line', r'(https?://\S+)$')} AS url FROM l WHERE {D.rx('line', r'^(?:.*?[,|\t]\s*)?https?://\S+$')}), h AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM s)
SELECT seq, title, url, CASE WHEN n > 200 THEN 'over_limit' WHEN title <> '' AND row_number() OVER (PARTITION BY lower(title) ORDER BY seq) > 1 THEN 'duplicate_title' END AS error FROM h""")
def seed_import(t: Tables):
    """Seed lines parsed and validated."""
    key, size = c("p_partkey").cast("string"), c("p_size").cast("string")
    base = F.concat(F.lit("https://s"), size, F.lit(".example.org/"))
    line = (
        F.when(c("p_partkey") % 6 == 0, F.concat("p_name", F.lit(" , "), base, F.lit("?cat_id="), key))
        .when(c("p_partkey") % 6 == 1, F.concat("p_name", F.lit("\t"), base, key))
        .when(c("p_partkey") % 6 == 2, F.concat(F.lit("  "), base, F.lit("x ")))
        .when(c("p_partkey") % 6 == 3, "no link here")
        .when(c("p_partkey") % 6 == 4, F.concat("p_name", F.lit(" https://a b")))
        .otherwise("")
    )
    lines = t.table("part").select(c("p_partkey").alias("seq"), line.alias("line"))
    return corpus.validate_seeds(corpus.parse_seed_lines(lines))


@plan(f"""WITH {D.AUDIT} SELECT run_id, section_key, file_url, status, coalesce(error_message, '') AS error_message, '' AS title, 'two lines' AS link_text FROM audit""")
def audit_csv(t: Tables):
    """Audit report written as CSV and read back."""
    path = sinks.new_path(work_dir(t.spark), "audit-csv")
    sinks.write_audit_csv(t.audit.withColumn("link_text", F.lit("two\r\nlines")), path)
    back = sinks.read_audit_csv(t.spark, path).fillna("")
    return back.select("run_id", "section_key", "file_url", "status", "error_message", "title", "link_text")


@plan(f"""WITH {D.AUDIT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, file_key ORDER BY prio DESC, seq) AS rn, count(*) OVER (PARTITION BY run_id, file_key) AS n_references FROM audit)
SELECT run_id, {_MEASURES} FROM ranked WHERE rn = 1 GROUP BY run_id""")
def audit_json(t: Tables):
    """Audit summary written as JSON and read back."""
    path = sinks.new_path(work_dir(t.spark), "audit-json")
    sinks.write_audit_json(t.audit, path)
    return t.spark.read.json(f"{path}/summary").drop("generated_at")


@plan(f"""WITH d AS ({V.DATES}) SELECT CAST(rec_id AS VARCHAR) AS detail_id, CASE WHEN rec_id % 3 = 0 THEN '' ELSE 'title ' || rec_id END AS title, '/news/?id=' || rec_id AS detail_path, expected_date AS published_text,
  raw_text AS published_raw, CAST(expected_date AS TIMESTAMP) AS published_at, rec_id % 2 = 0 AS is_downloaded, 'document' AS media_type FROM d""")
def record_append(t: Tables):
    """Announcement records appended with their defaults and read back."""
    d, key = t.dates, c("rec_id").cast("string")
    records = d.select(
        key.alias("detail_id"), F.when(c("rec_id") % 3 != 0, F.concat(F.lit("title "), key)).alias("title"),
        F.concat(F.lit("https://a.example.org/news/?id="), key).alias("detail_url"), c("raw_text").alias("published_raw"),
        F.when(c("rec_id") % 2 == 0, F.concat(F.lit("/data/"), key)).alias("local_path"), F.lit("document").alias("file_type"),
    )
    path = sinks.new_path(work_dir(t.spark), "announcements")
    rows = sinks.announcement_rows(records)
    sinks.append_records(rows.where("detail_id LIKE '%1'"), path)
    sinks.append_records(rows.where("detail_id NOT LIKE '%1'"), path)
    back = t.spark.read.schema(sinks.target_schema("announcements")).parquet(path)
    return back.select("detail_id", "title", "detail_path", "published_text", "published_raw", "published_at", "is_downloaded", "media_type")


@plan(f"""WITH {_FETCHED}, alive AS (SELECT * FROM idx WHERE seq % 6 <> 1), keys1 AS (SELECT 'url' AS kind, url AS lookup, seq FROM alive UNION ALL SELECT 'url', final_url, seq FROM alive UNION ALL SELECT 'sha256', sha256, seq FROM alive),
live AS (SELECT DISTINCT max(seq) OVER (PARTITION BY kind, lookup) AS seq FROM keys1) SELECT a.seq, a.url, a.local_path FROM alive a SEMI JOIN live USING (seq)""")
def index_snapshot(t: Tables):
    """Index pruned to existing files, saved, loaded again."""
    index = index_view(t)
    listing = index.where("seq % 6 <> 1").select("local_path")
    path = sinks.save_index(sinks.pruned_index(index, listing), work_dir(t.spark))
    return t.spark.read.parquet(path).select("seq", "url", "local_path")


_REG = f"reg AS (SELECT *, seq AS created FROM ({V.REGISTRY}) r)"


def _entries(t: Tables):
    return t.registry.withColumn("created_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), (c("seq") % 60).cast("int"), F.lit(0)))


@plan(f"""WITH {_REG} SELECT table_name, arg_max(full_title, seq) AS full_title, arg_max(source_url, seq) AS source_url, TIMESTAMP '2024-01-01' + to_minutes(CAST(arg_min(created, seq) % 60 AS INTEGER)) AS created_at, max(seq) AS seq FROM reg GROUP BY table_name""")
def registry_upsert(t: Tables):
    """Registry entries inserted or replaced by table name."""
    entries = _entries(t)
    return sinks.upsert_registry(entries.where("seq % 3 = 0"), entries.where("seq % 3 <> 0")).select("table_name", "full_title", "source_url", "created_at", "seq")


@plan(f"""WITH d AS ({V.DATES}) SELECT CAST(rec_id AS VARCHAR) AS detail_id, CASE WHEN rec_id % 5 = 0 THEN NULL ELSE expected_date END AS published_text, CAST(NULL AS VARCHAR) AS file_sha256 FROM d""")
def conform_schema(t: Tables):
    """An older table brought to the current schema."""
    raw = F.when(c("rec_id") % 5 == 0, "no date").otherwise(c("raw_text"))
    old = t.dates.select(c("rec_id").cast("string").alias("detail_id"), raw.alias("published_text"))
    return sinks.conform(old, "announcements").select("detail_id", "published_text", "file_sha256")


_COUNTS = f"""{_REG}, counts AS (SELECT table_name, count(*) AS n FROM reg WHERE seq % 2 = 0 GROUP BY 1 UNION ALL SELECT 'zone_' || p_type, count(*) FROM part GROUP BY 1),
entries AS (SELECT table_name, arg_max(full_title, seq) AS full_title, bool_or(seq % 4 = 3) AS name_truncated FROM reg WHERE table_name < 'Brand#20' GROUP BY 1)"""


@plan(f"""WITH {_COUNTS} SELECT e.table_name, c.n AS rows, CASE WHEN c.n IS NULL THEN 'missing_table' ELSE 'ok' END AS state, name_truncated, CASE WHEN full_title <> e.table_name THEN full_title END AS full_title FROM entries e LEFT JOIN counts c USING (table_name)
UNION ALL SELECT table_name, n, 'unregistered', false, NULL FROM counts c WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.table_name = c.table_name)""")
def registry_check(t: Tables):
    """Registered tables without data and data nobody registered."""
    counts = t.registry.where("seq % 2 = 0").groupBy("table_name").agg(F.count("*").alias("n")).unionByName(
        t.table("part").groupBy(F.concat(F.lit("zone_"), "p_type").alias("table_name")).agg(F.count("*").alias("n"))
    )
    entries = t.registry.where("table_name < 'Brand#20'").groupBy("table_name").agg(
        F.max_by("full_title", "seq").alias("full_title"), F.bool_or(c("seq") % 4 == 3).alias("name_truncated")
    )
    return R.registry_check(entries, counts)


@plan(f"""WITH {D.AUDIT}, r AS (SELECT run_id, count(*) AS in_report FROM audit GROUP BY 1), s AS (SELECT run_id, count(*) AS in_table FROM audit WHERE CAST(substr(run_id, 9, 2) AS INT) % 3 = 0 OR (CAST(substr(run_id, 9, 2) AS INT) % 3 = 1 AND seq % 2 = 0) GROUP BY 1)
SELECT run_id, in_report, coalesce(in_table, 0) AS in_table, CASE WHEN in_table IS NULL THEN 'table_empty' WHEN in_table < in_report THEN 'table_short' ELSE 'equal' END AS verdict, in_report - coalesce(in_table, 0) AS short_by FROM r LEFT JOIN s USING (run_id)""")
def report_check(t: Tables):
    """Report rows against stored rows per run."""
    day = F.substring("run_id", 9, 2).cast("int")
    return R.report_check(t.audit, t.audit.where((day % 3 == 0) | ((day % 3 == 1) & (c("seq") % 2 == 0))))


@plan("""SELECT p_brand AS table_name, count(*) AS checked, count(*) FILTER (p_partkey % 5 = 0) AS missing, CAST(round(100.0 * count(*) FILTER (p_partkey % 5 <> 0) / count(*)) AS INT) AS pct_intact FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1""")
def missing_files(t: Tables):
    """Recorded paths that no longer exist, per table."""
    path = F.when(c("p_partkey") % 7 != 0, F.concat(F.lit("/data/"), c("p_partkey").cast("string"))).alias("local_path")
    recorded = t.table("part").select(c("p_brand").alias("table_name"), path)
    return X.missing_files(recorded, t.table("part").where("p_partkey % 5 <> 0").select(path))


@plan("""WITH n AS (SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'drafts', count(*) FROM events WHERE event_type = 'draft')
SELECT table_name, n, n = 0 AS is_empty FROM n UNION ALL SELECT '(total)', CAST(sum(n) AS BIGINT), false FROM n""")
def table_counts(t: Tables):
    """Rows per table with a grand total."""
    return R.table_counts({
        "orders": t.table("orders"), "pages": t.table("pages"), "documents": t.table("documents"),
        "drafts": t.table("events").where("event_type = 'draft'"),
    })


@plan(f"""WITH b AS ({V.BODIES}) SELECT count(*) FILTER (ok) AS stored, count(*) FILTER (ok) AS with_data, round(coalesce(sum(octet_length(content)) FILTER (ok), 0) / 1024.0 / 1024, 1) AS mb
FROM (SELECT *, declared_type = 'application/pdf' OR seq % 9 = 0 AS ok FROM b)""")
def pdf_stats(t: Tables):
    """Stored PDFs, those with bytes, and their size."""
    return R.pdf_stats(I.pdf_storage(t.bodies))




_NUMBERED = "row_number() OVER (ORDER BY p_partkey)"


@plan(f"""WITH l AS (SELECT {_NUMBERED} AS seq, trim({_LINE}) AS line FROM part), s AS (SELECT seq, CASE WHEN {D.rx('line', r'^(.*?)[,|\t]\s*(https?://\S+)$')} THEN trim({D.extract('line', r'^(.*?)[,|\t]\s*https?://\S+$')}) ELSE '' END AS title,
  {D.extract('line', r'(https?://\S+)$')} AS url FROM l WHERE {D.rx('line', r'^(?:.*?[,|\t]\s*)?https?://\S+$')}), h AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM s)
SELECT seq, title, url, CASE WHEN n > 200 THEN 'over_limit' WHEN title <> '' AND row_number() OVER (PARTITION BY lower(title) ORDER BY seq) > 1 THEN 'duplicate_title' END AS error FROM h""")
def seed_files(t: Tables):
    """Seed lines kept in text files, read in line order and validated."""
    path = sinks.new_path(work_dir(t.spark), "seeds")
    line = F.expr(_LINE.replace("chr(9)", "char(9)"))
    t.table("part").repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey").select(line.alias("value")).write.text(path)
    return corpus.validate_seeds(corpus.read_seeds(t.spark, path))


@plan("""WITH d AS (SELECT p_size AS folder, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS n_bytes FROM part WHERE p_size % 5 <> 0 GROUP BY 1)
SELECT p_size AS folder, count(*) AS recorded, coalesce(max(d.n_bytes), 0) AS listed_bytes, coalesce(max(d.n_bytes), 0) AS read_bytes, max(d.n_bytes) IS NOT NULL AS intact
FROM part LEFT JOIN d ON d.folder = p_size GROUP BY 1""")
def file_listing_check(t: Tables):
    """Recorded folders against the files that are there: listed without reading, and read."""
    path = sinks.new_path(work_dir(t.spark), "files")
    parts = t.table("part")
    parts.where("p_size % 5 <> 0").select("p_name", "p_size").write.partitionBy("p_size").text(path)
    folder = F.regexp_extract("local_path", "p_size=([0-9]+)/", 1).cast(parts.schema["p_size"].dataType).alias("folder")
    listed = corpus.file_listing(t.spark, path).groupBy(folder).agg(F.sum("file_size").alias("listed_bytes"))
    read = corpus.read_bodies(t.spark, path).groupBy(folder).agg(F.sum(F.octet_length("content")).cast("bigint").alias("read_bytes"))
    recorded = parts.groupBy(c("p_size").alias("folder")).agg(F.count("*").alias("recorded"))
    every = recorded.join(listed, "folder", "left").join(read, "folder", "left")
    return every.select("folder", "recorded", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("listed_bytes", "read_bytes")], c("listed_bytes").isNotNull().alias("intact"))


_RUNS = f"""a AS ({V.AUDIT}), p AS (SELECT 'run-' || (page_id % 3) AS run_id, url FROM pages)"""


@plan(f"""WITH {_RUNS} SELECT 'fetch_audit' AS table_name, run_id, count(*) AS n_rows, count(DISTINCT file_url) AS n_keys FROM a GROUP BY run_id
UNION ALL SELECT 'crawl_pages', run_id, count(*), count(DISTINCT url) FROM p GROUP BY run_id
UNION ALL SELECT 'activity_details', 'run-' || (l_linenumber % 2), count(*), count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2
UNION ALL SELECT 'site_profiles', 'run-0', count(DISTINCT {D.site('url')}), count(DISTINCT {D.site('url')}) FROM pages""")
def table_append(t: Tables):
    """Record tables of several runs, each run appended twice: its rows count once."""
    folder = sinks.new_path(work_dir(t.spark), "records")
    number = lambda x: F.concat(F.lit("run-"), x.cast("string")).alias("run_id")
    loads = {
        "fetch_audit": (t.audit, "file_url"),
        "crawl_pages": (t.pages.select(number(c("page_id") % 3), c("url").alias("page_url"), F.lit("downloaded").alias("status")), "page_url"),
        "activity_details": (t.table("lineitem").select(number(c("l_linenumber") % 2), c("l_orderkey").cast("string").alias("album_id")), "album_id"),
        "site_profiles": (t.pages.select(F.lit("run-0").alias("run_id"), U.site(c("url")).alias("site_url")).distinct(), "site_url"),
    }
    out = []
    for table, (rows, key) in loads.items():
        for _ in range(2):
            sinks.append_runs(rows, table, folder)
        back = sinks.read_runs(t.spark, table, folder)
        out.append(back.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("table_name", F.lit(table)))
    return reduce(lambda a, b: a.unionByName(b), out)
