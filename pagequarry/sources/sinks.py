"""Sinks: audit CSV and JSON, typed appends, snapshots, registry, schemas."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequarry import fixed_values as fv
from pagequarry.functions import dates as D
from pagequarry.functions import urls as U
from pagequarry.operators.audit import audit_summary
from pagequarry.operators.file_index import latest_index
from pagequarry.schemas import SCHEMAS

BOM = "\ufeff"


def target_schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


# --- reports --------------------------------------------------------------------------
def audit_csv_rows(audit: DataFrame) -> DataFrame:
    """The 24 report columns as text, line breaks flattened."""
    have = set(audit.columns)

    def cell(name: str) -> Column:
        value = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        return F.coalesce(F.regexp_replace(value, "\r?\n", " "), F.lit("")).alias(name)

    return audit.select(*[cell(n) for n in fv.AUDIT_CSV_COLUMNS])


def write_audit_csv(audit: DataFrame, path: str) -> None:
    """CSV with header, BOM and CRLF; one file per task."""
    rows = audit_csv_rows(audit)
    rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").option(
        "emptyValue", ""
    ).csv(path)


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{n} STRING" for n in fv.AUDIT_CSV_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("lineSep", "\r\n").option(
        "enforceSchema", True
    ).csv(path)


def write_audit_json(audit: DataFrame, path: str) -> None:
    """Files and summary as two datasets, so no row holds the whole report."""
    audit.write.mode("overwrite").json(f"{path}/files")
    audit_summary(audit, ["run_id"]).withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/summary")


def write_crawl_jsonl(pages: DataFrame, assets: DataFrame, path: str) -> None:
    """Pages and assets as JSON lines, stored bytes left out."""
    pages.write.mode("overwrite").json(f"{path}/pages")
    assets.drop("pdf_data").write.mode("overwrite").json(f"{path}/assets")


# --- typed tables ----------------------------------------------------------------------
def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns in target order and type; absent ones become NULL.

    Text in a DATE column goes through the date parser.
    """
    return df.select(*conformed_columns(df, table))


def conformed_columns(df: DataFrame, table: str) -> list[Column]:
    """The columns of ``conform`` as expressions over ``df``."""
    have = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def column(field) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if field.dataType.typeName() == "date" and have[field.name] == "string":
            value = D.to_date(value)
        return value.cast(field.dataType).alias(field.name)

    return [column(f) for f in target_schema(table).fields]


def unparsable_dates(df: DataFrame, column: str) -> DataFrame:
    """Non-empty values the date conversion cannot read, with counts."""
    text = F.trim(F.col(column))
    return df.where((text != "") & D.to_date(F.col(column)).isNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )


def announcement_rows(records: DataFrame) -> DataFrame:
    """Announcement records with their defaults, in the stored schema."""
    have = set(records.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    raw = F.coalesce(col("published_raw"), col("published_text"))
    rows = records.select(
        *[F.col(c) for c in records.columns if c not in {
            "title", "listing_path", "detail_path", "published_text", "published_raw", "published_at", "media_type",
            "is_downloaded", "pdf_stored_in_db"}],
        F.coalesce(col("title"), F.lit("")).alias("title"),
        F.coalesce(col("listing_path"), U.path_and_query(col("listing_url"))).alias("listing_path"),
        F.coalesce(col("detail_path"), U.path_and_query(col("detail_url"))).alias("detail_path"),
        D.to_date(F.coalesce(F.nullif(col("published_text"), F.lit("")), col("published_raw"))).alias("published_text"),
        raw.alias("published_raw"), D.to_timestamp(F.coalesce(F.nullif(col("published_raw"), F.lit("")), col("published_text"))).alias("published_at"),
        F.coalesce(col("media_type"), col("file_type")).alias("media_type"),
        F.coalesce(col("is_downloaded", "boolean"), F.coalesce(col("local_path"), F.lit("")) != "").alias("is_downloaded"),
        (F.coalesce(col("pdf_stored_in_db", "boolean"), F.lit(False)) & col("pdf_data", "binary").isNotNull()).alias("pdf_stored_in_db"),
    )
    return conform(rows, "announcements")


def append_records(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append; the commit of one job is all or nothing on a file table."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_runs(rows: DataFrame, table: str, folder: str) -> None:
    """Append the rows of whole runs to a record table; a run that comes again replaces its own rows.

    Rows are conformed to the stored schema of ``table`` and lie under their
    ``run_id`` and the load that brought them.  The load counts once its runs
    are in the manifest, so a load that broke off is never read.
    """
    load = uuid.uuid4().hex
    own = [] if "run_id" in target_schema(table).names else ["run_id"]
    stored, spark = rows.select(*own, *conformed_columns(rows, table)), rows.sparkSession
    stored.withColumn("load", F.lit(load)).write.mode("append").partitionBy("run_id", "load").parquet(f"{folder}/{table}/data")
    written = spark.read.schema("run_id string, load string").parquet(f"{folder}/{table}/data").where(F.col("load") == load)
    runs = written.select("run_id", "load").distinct().withColumn("at", F.lit(time.time_ns()))
    runs.coalesce(1).write.mode("append").parquet(f"{folder}/{table}/manifest")


def read_runs(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """The rows that each run's last load brought, in the stored schema with ``run_id``."""
    manifest = spark.read.schema("run_id string, load string, at long").parquet(f"{folder}/{table}/manifest")
    last = manifest.groupBy("run_id").agg(F.max_by("load", "at").alias("load"))
    names = target_schema(table).names
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in target_schema(table).fields if f.name != "run_id")
    rows = spark.read.schema(f"{columns}, run_id string, load string").parquet(f"{folder}/{table}/data")
    return rows.join(last, ["run_id", "load"], "left_semi").select(*([] if "run_id" in names else ["run_id"]), *names)


# --- snapshots ------------------------------------------------------------------------------
def new_path(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def pruned_index(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Index records that have a URL and whose file still exists."""
    valid = index.where("url IS NOT NULL AND url <> '' AND local_path IS NOT NULL AND local_path <> ''")
    return valid.join(listing.select("local_path").distinct(), "local_path", "left_semi").select(*index.columns)


def live_index(index: DataFrame) -> DataFrame:
    """Distinct records some key still resolves to."""
    return latest_index(index).drop("kind", "lookup").dropDuplicates(["seq"])


def save_index(index: DataFrame, folder: str) -> str:
    """Write a new snapshot beside the old one; callers switch to its path."""
    path = new_path(folder, "file-index")
    live_index(index).write.parquet(path)
    return path


def upsert_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by ``table_name``; the first ``created_at`` survives.

    Both carry ``seq``; later rows win.  One aggregation, no window.
    """
    rows = existing.unionByName(incoming, allowMissingColumns=True).where("table_name IS NOT NULL")
    replaced = [c for c in rows.columns if c not in {"table_name", "created_at", "seq"}]
    return rows.groupBy("table_name").agg(
        F.max_by(F.struct(*replaced), "seq").alias("r"), F.min_by("created_at", "seq").alias("created_at"), F.max("seq").alias("seq")
    ).select("table_name", "r.*", "created_at", "seq")
