"""Streams replayed in several batches equal the batch job."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import audit as A
from pagequarry.plans import views as V
from pagequarry.plans.views import Tables
from pagequarry.sources.keyed import KeyedTable
from pagequarry.sources.sinks import upsert_registry
from pagequarry.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def split_table(t, name, folder, parts):
    path = f"{folder}/{name}"
    t.table(name).repartition(parts).write.parquet(path)
    return S.table_stream(t.spark, path, files_per_batch=1)


def as_view(t, stream, name, sql):
    stream.createOrReplaceTempView("split_rows")
    for wide, plain in V._SPARK_DIALECT.items():
        sql = sql.replace(wide, plain)
    return t.spark.sql(sql.replace(f"FROM {name}", "FROM split_rows"))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_audit_stream(spark, tmp_path, batches):
    t = Tables(spark, SF)
    stream = as_view(t, split_table(t, "events", tmp_path, batches), "events", V.AUDIT)
    S.audit_winners_stream(stream, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/totals").count() == batches
    assert S.live_audit_summary(spark, f"{tmp_path}/out").collect() == A.audit_summary(t.audit).collect()


def test_registry_stream(spark, tmp_path):
    t = Tables(spark, SF)
    stream = as_view(t, split_table(t, "part", tmp_path, 3), "part", V.REGISTRY).selectExpr("*", "seq AS created_at")
    S.registry_stream(stream, f"{tmp_path}/out")
    batch = t.registry.selectExpr("*", "seq AS created_at")
    want = upsert_registry(batch.limit(0), batch).select("table_name", "full_title", "seq")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
    got = S.latest_registry(spark, f"{tmp_path}/out", columns).select("table_name", "full_title", "seq")
    assert sorted(got.collect()) == sorted(want.collect())


def test_index_stream_keeps_one_copy(spark, tmp_path):
    t = Tables(spark, SF)
    docs = as_view(t, split_table(t, "documents", tmp_path, 3), "documents", V.ASSETS)
    fetched = docs.selectExpr(
        "seq", "url", "url AS final_url", "concat('/d/', seq) AS local_path", "sha2(encode(content, 'UTF-8'), 256) AS sha256", "file_size",
        "'' AS mime_type", "cast(null AS timestamp_ntz) AS added_at",
    )
    S.index_stream(fetched, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out/results")
    assert out.count() == t.assets.count()
    assert out.where("status = 'downloaded'").count() == t.assets.select("content").distinct().count()


@pytest.mark.parametrize("batches", [1, 3])
def test_first_per_key_in_any_order(spark, tmp_path, batches):
    t = Tables(spark, SF)
    stream = as_view(t, split_table(t, "events", tmp_path, batches), "events", V.AUDIT)
    S.first_per_key_stream(stream, f"{tmp_path}/out", delay="1 day")
    key = A.file_key(t.audit)
    want = t.audit.groupBy("run_id", key.alias("k")).agg(F.min(F.struct("checked_at", "seq")).alias("f")).select("run_id", "k", "f.seq")
    assert sorted(map(tuple, S.first_per_key(spark, f"{tmp_path}/out").select("run_id", "file_key", "seq").collect())) == sorted(map(tuple, want.collect()))
    assert (spark.read.parquet(f"{tmp_path}/out/late").count() > 0) == (batches > 1)


def test_late_rows_are_reported_and_count(spark, tmp_path):
    day = lambda d: datetime.datetime(2026, 5, d)
    arrivals = [[("r", "http://h/a.pdf", day(20), 1)], [("r", "http://h/a.pdf", day(2), 2), ("r", "http://h/b.pdf", day(19), 3)], [("r", "http://h/a.pdf", day(3), 4)]]
    for rows in arrivals:
        made = spark.createDataFrame(rows, "run_id string, file_url string, checked_at timestamp, seq long")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.first_per_key_stream(S.table_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", delay="5 days")
    assert {r["seq"] for r in S.first_per_key(spark, f"{tmp_path}/out").collect()} == {2, 3}
    assert {(r["seq"], r["is_first"]) for r in spark.read.parquet(f"{tmp_path}/out/late").collect()} == {(2, True), (4, False)}


def test_batches_read_their_own_buckets(spark, tmp_path):
    """Fifty batches of new and known keys: what a batch reads does not grow with the batches before it."""
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        read, want = [], {}
        for b in range(50):
            rows = [(f"k{b * 4 + i}", b) for i in range(4)] + [(f"k{b}", b)]
            table = KeyedTable(spark, f"{tmp_path}/t", "k string, v long", ["k"], bucket_rows=8, buckets=4)
            table.upsert(spark.createDataFrame(rows, "k string, v long"), b, lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("v").alias("v")))
            read.append(table.rows_read)
            want |= dict(rows)
        assert max(read) <= 5 * 2.5 * 8 and sum(read[-10:]) < 3 * sum(read[10:20]) and len(want) == 200
        assert {r["k"]: r["v"] for r in table.rows().collect()} == want
        # a batch that is tried again changes nothing twice
        table.upsert(spark.createDataFrame(rows, "k string, v long"), 49, lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("v").alias("v")))
        assert {r["k"]: r["v"] for r in table.rows().collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
