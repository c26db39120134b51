"""Streaming jobs replayed over a table's files; checks equal the batch job."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import graph as G
from pagequarry.plans import duck as D
from pagequarry.plans import views as V
from pagequarry.plans.audit_queries import _MEASURES, _UNIQUE
from pagequarry.plans.graph_queries import _REACH, crawl_inputs
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables
from pagequarry.session import work_dir
from pagequarry.sources.sinks import new_path
from pagequarry.streaming import jobs as S

c = F.col


def _folder(t: Tables, name: str) -> str:
    return new_path(work_dir(t.spark), name)


def _in_batches(t: Tables, name: str, sql: str, key: str, run, batches: int = 3) -> None:
    """A view's SELECT over a table that arrives in ``batches`` parts, by ranges of ``key``.

    After each arrival the stream goes on where it stopped, as a scheduled run does.
    """
    source, rows = _folder(t, f"arrived-{name}"), t.table(name)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    part = F.floor((c(key) - low) * batches / (high - low + 1)) if low is not None else F.lit(0)
    for k in range(batches):
        rows.where(F.coalesce(part, F.lit(0)) == k).write.mode("append").parquet(source)
        S.table_stream(t.spark, source, files_per_batch=1_000_000).createOrReplaceTempView(f"stream_{name}")
        text = sql
        for wide, plain in V._SPARK_DIALECT.items():
            text = text.replace(wide, plain)
        run(t.spark.sql(text.replace(f"FROM {name}", f"FROM stream_{name}")))


@plan(f"""WITH f AS (SELECT seq, sha256(content) AS h FROM ({V.ASSETS}) a) SELECT seq, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY seq) = 1 THEN 'downloaded' ELSE 'already_exists' END AS status FROM f""")
def stream_index(t: Tables):
    """Files arriving in batches judged against the growing index."""
    folder = _folder(t, "index-stream")

    def run(docs) -> None:
        S.index_stream(docs.select(
            "seq", "url", c("url").alias("final_url"), F.concat(F.lit("/data/"), "site", F.lit("/"), c("seq").cast("string")).alias("local_path"),
            F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), "file_size", F.lit("text/plain").alias("mime_type"),
            F.lit(None).cast("timestamp_ntz").alias("added_at"),
        ), folder)

    _in_batches(t, "documents", V.ASSETS, "doc_id", run)
    return t.spark.read.parquet(f"{folder}/results").select("seq", "status")


@plan(f"WITH {_UNIQUE} SELECT {_MEASURES} FROM uniq")
def stream_audit(t: Tables):
    """Audit measures kept current by signed changes as batches of rows arrive."""
    folder = _folder(t, "audit-stream")
    _in_batches(t, "events", V.AUDIT, "event_id", lambda rows: S.audit_winners_stream(rows, folder))
    return S.live_audit_summary(t.spark, folder)


# a batch takes every third of the event ids from the end, so most rows arrive late
@plan(f"WITH {D.AUDIT} SELECT run_id, file_key, arg_min(seq, (checked_at, seq)) AS first_seq FROM audit GROUP BY run_id, file_key")
def stream_first_per_key(t: Tables):
    """Each file's first row per run, from batches in falling order of time."""
    folder = _folder(t, "first-stream")
    turned = V.AUDIT.replace("FROM events", "FROM (SELECT -turned AS event_id, ts, user_id, event_type, value, props FROM turned_events)")
    t.table("events").select((-c("event_id")).alias("turned"), "ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/turned_events.parquet")
    late = Tables(t.spark, folder)
    _in_batches(late, "turned_events", turned, "turned", lambda rows: S.first_per_key_stream(rows, folder))
    return S.first_per_key(t.spark, folder).select("run_id", "file_key", c("seq").alias("first_seq"))


@plan(f"WITH {D.HREFS} SELECT page_id, href FROM hrefs WHERE page_id >= 0 AND href IS NOT NULL")
def stream_pages(t: Tables):
    """Links of newly captured pages."""
    folder = _folder(t, "page-stream")
    S.page_links_stream(S.table_stream(t.spark, f"{t.sf_dir}/pages.parquet"), folder)
    return t.spark.read.parquet(f"{folder}/links").select("page_id", "href").distinct()


@plan(f"""WITH r AS ({V.REGISTRY}) SELECT table_name, arg_max(full_title, seq) AS full_title, arg_max(source_url, seq) AS source_url, min(seq) AS created_at, max(seq) AS seq FROM r GROUP BY table_name""")
def stream_registry(t: Tables):
    """Registry upserts applied batch by batch."""
    folder = _folder(t, "registry-stream")
    _in_batches(t, "part", V.REGISTRY, "p_partkey", lambda rows: S.registry_stream(rows.withColumn("created_at", c("seq")), folder))
    columns = "seq bigint, table_name string, full_title string, source_url string, created_at bigint"
    return S.latest_registry(t.spark, folder, columns).select("table_name", "full_title", "source_url", "created_at", "seq")


@plan(f"WITH RECURSIVE {_REACH} SELECT node, CAST(depth AS INTEGER) AS depth, discovered_from FROM reached")
def stream_resume(t: Tables):
    """The crawl over captured links, stopped after a level and resumed from its folder."""
    links, roots, listed = crawl_inputs(t)
    folder = _folder(t, "resume")
    G.crawl(links, roots, listed, folder, max_depth=1)
    return G.crawl(links, roots, listed, folder)
