"""Structured Streaming jobs: incremental index, audit, crawl, registry.

Batches write to ``<folder>/batch=<id>`` with overwrite, so a batch that is
retried after a failure replaces its own output and nothing else.  What a job
remembers is a keyed table: a batch reads the buckets of its own keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.functions import urls as U
from pagequarry.operators import audit as A
from pagequarry.operators import file_index as X
from pagequarry.operators.extract import page_hrefs
from pagequarry.sources import sinks
from pagequarry.sources.keyed import KeyedTable


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stored table as a stream of its files, schema taken from the table."""
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be one file or a folder of files
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def _run(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_offsets")
    query = writer.foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _index_table(spark: SparkSession, folder: str) -> KeyedTable:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sinks.target_schema("file_index").fields)
    return KeyedTable(spark, f"{folder}/index", f"kind string, lookup string, {columns}", ["kind", "lookup"])


def indexed_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per lookup key as of the last batch: the record it resolves to."""
    return _index_table(spark, folder).rows()


def index_stream(fetched: DataFrame, folder: str) -> StreamingQuery:
    """Each arriving file: new, known by URL, or known by content.

    ``fetched`` has the file-index columns.  The index holds one row per lookup
    key; a batch reads and rewrites the buckets of its own keys.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        table = _index_table(batch.sparkSession, folder)
        conformed = sinks.conform(batch, "file_index")
        known = table.touched(X.index_keys(conformed).select("kind", "lookup"), batch_id)
        judged = X.batch_lookup(batch, known.drop("kind", "lookup").dropDuplicates(["seq"])).persist()
        judged.write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")
        # a repeated file is registered where it is stored, not where its copy would have gone
        kept = judged.withColumn("local_path", F.coalesce("stored_path", "local_path"))
        fresh = X.index_keys(sinks.conform(X.register(kept), "file_index"))
        every = known.unionByName(fresh)
        record = F.struct(*[c for c in every.columns if c not in ("kind", "lookup")])
        latest = every.groupBy("kind", "lookup").agg(F.max_by(record, "seq").alias("r")).select("kind", "lookup", "r.*")
        table.commit(latest, batch_id)
        judged.unpersist()
        batch.unpersist()

    return _run(fetched, folder, each)


def _winners_table(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/winners", "file_key string, status string, seq long, n_references long", ["file_key"])


def _measured(winners: DataFrame) -> dict[str, int]:
    row = winners.agg(*A._measures(F.col("status"), F.col("n_references"))).first()
    return {name: value or 0 for name, value in row.asDict().items()}


def audit_winners_stream(audit: DataFrame, folder: str) -> StreamingQuery:
    """Unique-file records and their measures, kept current batch by batch.

    A batch changes the records of its own files.  The measures are sums over
    records, so the totals change by what the touched records add now less what
    they added before: a batch reads one row of totals and its own buckets.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rank = F.struct(A.status_priority(F.col("status")), -F.col("seq"))
        rows = batch.select(A.file_key(batch).alias("file_key"), "status", "seq", F.lit(1).cast("long").alias("n_references")).persist()
        table = _winners_table(spark, folder)
        before = table.touched(rows, batch_id)
        after = before.unionByName(rows).groupBy("file_key").agg(
            F.max_by("status", rank).alias("status"), F.max_by("seq", rank).alias("seq"), F.sum("n_references").alias("n_references")
        ).persist()
        less, more = _measured(before), _measured(after)
        old = dict.fromkeys(more, 0)
        if batch_id:
            old = spark.read.parquet(f"{folder}/totals/batch={batch_id - 1}").first().asDict()
        totals = spark.createDataFrame([tuple(old[k] + more[k] - less[k] for k in more)], ", ".join(f"{k} long" for k in more))
        totals.write.mode("overwrite").parquet(f"{folder}/totals/batch={batch_id}")
        table.commit(after, batch_id)
        after.unpersist()
        rows.unpersist()

    return _run(audit, folder, each)


def live_audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Audit measures as of the last batch: one stored row."""
    every = spark.read.option("basePath", f"{folder}/totals").parquet(f"{folder}/totals")
    return every.where(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def first_per_key_stream(audit: DataFrame, folder: str, delay: str = "30 days") -> StreamingQuery:
    """First row, by time, per run and file, whatever order the rows arrive in.

    The firsts are a keyed table, so a row of any age still counts.  Rows that
    arrive more than ``delay`` behind the newest time of the batches before are
    also reported under ``late``, with whether they are now their file's first.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(
            "run_id", U.asset_key(F.col("file_url")).alias("file_key"), F.col("checked_at").cast("timestamp").alias("checked_at"), "seq"
        ).persist()
        table = KeyedTable(spark, f"{folder}/first", "run_id string, file_key string, checked_at timestamp, seq long", ["run_id", "file_key"])
        known = table.touched(rows, batch_id)
        # rows without a time come after all others
        order = F.struct(F.col("checked_at").isNull(), "checked_at", "seq")
        first = known.unionByName(rows).groupBy("run_id", "file_key").agg(F.min_by(F.struct("checked_at", "seq"), order).alias("f"))
        first = first.select("run_id", "file_key", "f.checked_at", "f.seq").persist()
        newest = rows.agg(F.max("checked_at").alias("newest"))
        if batch_id:
            seen = spark.read.parquet(f"{folder}/newest/batch={batch_id - 1}")
            behind = rows.where(F.col("checked_at") < seen.select(F.col("newest") - F.expr(f"INTERVAL {delay}")).scalar())
            won = first.select("run_id", "file_key", F.col("seq").alias("first_seq"))
            late = behind.join(won, ["run_id", "file_key"]).select(*rows.columns, (F.col("seq") == F.col("first_seq")).alias("is_first"))
            newest = newest.unionByName(seen).agg(F.max("newest").alias("newest"))
        else:
            late = rows.limit(0).withColumn("is_first", F.lit(False))
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        newest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")
        table.commit(first, batch_id)
        first.unpersist()
        rows.unpersist()

    return _run(audit, folder, each)


def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, file_key, checked_at, seq) as of the last batch."""
    return KeyedTable(spark, f"{folder}/first", "run_id string, file_key string, checked_at timestamp, seq long", ["run_id", "file_key"]).rows()


def page_links_stream(pages: DataFrame, folder: str) -> StreamingQuery:
    """New captured pages to their links; stateless, exactly-once file sink."""
    query = (
        page_hrefs(pages).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{folder}/_offsets").option("path", f"{folder}/links")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _registry_table(spark: SparkSession, folder: str, columns: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/registry", columns, ["table_name"])


def registry_stream(entries: DataFrame, folder: str) -> StreamingQuery:
    """Registry upserts; a batch rewrites the buckets of its own tables."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)

    def each(batch: DataFrame, batch_id: int) -> None:
        table = _registry_table(batch.sparkSession, folder, columns)
        table.upsert(batch.where("table_name IS NOT NULL"), batch_id, lambda old, new: sinks.upsert_registry(old, new).select(*entries.columns))

    return _run(entries, folder, each)


def latest_registry(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """The registry as of the last batch; ``columns`` is its DDL list."""
    return _registry_table(spark, folder, columns).rows()
