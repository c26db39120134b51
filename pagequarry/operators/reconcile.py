"""Reconciliation: registry, stored tables, reports and files on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table plus a grand total; ``is_empty`` marks empty ones."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    every = reduce(lambda a, b: a.unionByName(b), counts)
    total = F.coalesce("table_name", F.lit("(total)"))
    return every.rollup("table_name").agg(F.sum("n").alias("n")).select(
        total.alias("table_name"), "n", (F.col("n") == 0).alias("is_empty")
    )


def catalog_counts(spark: SparkSession, database: str) -> DataFrame:
    """``table_counts`` of every table of a catalog database."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return table_counts({n: spark.table(f"`{database}`.`{n}`") for n in names})


def registry_check(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """Registered tables with their rows, and tables nobody registered.

    ``registry``: ``table_name, full_title, source_url, name_truncated``;
    ``counts``: ``table_name, n``.
    """
    known = registry.join(counts, "table_name", "left").select(
        "table_name", F.col("n").alias("rows"),
        F.when(F.col("n").isNull(), "missing_table").otherwise("ok").alias("state"), "name_truncated",
        F.when(F.col("full_title") != F.col("table_name"), F.col("full_title")).alias("full_title"),
    )
    stray = counts.where(~F.col("table_name").isin(fv.SECTION_TABLES)).join(registry, "table_name", "left_anti").select(
        "table_name", F.col("n").alias("rows"), F.lit("unregistered").alias("state"), F.lit(False).alias("name_truncated"),
        F.lit(None).cast("string").alias("full_title"),
    )
    return known.unionByName(stray)


def report_check(report: DataFrame, stored: DataFrame) -> DataFrame:
    """Report rows against stored rows per run, with a verdict."""
    r = report.groupBy("run_id").agg(F.count("*").alias("in_report"))
    s = stored.groupBy("run_id").agg(F.count("*").alias("in_table"))
    both = r.join(s, "run_id", "full").fillna(0)
    verdict = (
        F.when((F.col("in_table") == 0) & (F.col("in_report") > 0), "table_empty")
        .when(F.col("in_table") < F.col("in_report"), "table_short")
        .when(F.col("in_table") > F.col("in_report"), "table_longer")
        .otherwise("equal")
    )
    return both.withColumn("verdict", verdict).withColumn("short_by", F.greatest(F.lit(0), F.col("in_report") - F.col("in_table")))


def folder_check(folders: DataFrame, stored: DataFrame) -> DataFrame:
    """Record folders on disk against stored rows, per section."""
    f = folders.groupBy("section_key").agg(F.count_distinct("folder_path").alias("folders"))
    s = stored.groupBy("section_key").agg(F.count("*").alias("rows"))
    return f.join(s, "section_key", "full").fillna(0)


def pdf_stats(files: DataFrame) -> DataFrame:
    """PDFs flagged as stored, with bytes, and their size in MB."""
    mb = F.round(F.coalesce(F.sum(F.octet_length("pdf_data")), F.lit(0)) / 1024 / 1024, 1)
    return files.agg(
        F.count_if("pdf_stored_in_db").alias("stored"), F.count("pdf_data").alias("with_data"), mb.alias("mb")
    )
