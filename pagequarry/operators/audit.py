"""Audit jobs: unique files, duplicate flags, summaries, error classes.

No job here ranks rows inside a key: winners come from ``max_by`` (combined
map-side), and flags from a join on the unique row number ``seq``, so a key
that holds a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import matches

_STATUS_MEASURES = {
    "downloaded": "downloaded", "already_exists": "already_exists", "not_found": "not_found",
    "forbidden": "forbidden", "unauthorized": "unauthorized", "rate_limited": "rate_limited",
    "server_error": "server_error", "timeout": "timeout", "network_error": "network_error",
    "invalid_content": "invalid_content", "empty_file": "empty_file", "skipped_external": "skipped_external",
    "referenced_embed": "referenced_embed", "referenced_stream": "referenced_stream",
}
FAILED = [s for s, _, failed in fv.AUDIT_STATUSES if failed]


def status_priority(status: Column) -> Column:
    chain = F
    for name, priority, _ in fv.AUDIT_STATUSES:
        chain = chain.when(status == name, priority)
    return chain.otherwise(0)


def file_key(df: DataFrame) -> Column:
    """Normalised URL, else the file URL's key, else a key per row."""
    given = F.col("normalized_file_url") if "normalized_file_url" in df.columns else F.lit(None).cast("string")
    return F.coalesce(
        F.nullif(given, F.lit("")),
        F.nullif(U.asset_key(F.trim("file_url")), F.lit("")),
        F.concat(F.lit("row:"), F.col("seq").cast("string")),
    )


def unique_files(audit: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """One record per file (within ``scope``): best status, first on ties."""
    rows = audit.withColumn("file_key", file_key(audit))
    best = F.max_by(F.struct(*audit.columns), F.struct(status_priority(F.col("status")), -F.col("seq")))
    grouped = rows.groupBy(*scope, "file_key").agg(best.alias("w"), F.count("*").alias("n_references"))
    return grouped.select("file_key", "n_references", "w.*")


def flag_duplicates(audit: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Every row with ``is_duplicate``: true unless it is its file's record."""
    rows = audit.withColumn("file_key", file_key(audit))
    rank = F.struct(status_priority(F.col("status")), -F.col("seq"))
    winners = rows.groupBy(*scope, "file_key").agg(F.max_by("seq", rank).alias("seq")).select("seq")
    flagged = rows.join(winners.withColumn("_won", F.lit(True)), "seq", "left")
    return flagged.withColumn("is_duplicate", F.col("_won").isNull()).drop("_won")


def first_mentions(audit: DataFrame, scope: list[str]) -> DataFrame:
    """Rows with ``duplicate_of_url``: the key when it was seen before."""
    rows = audit.withColumn("file_key", file_key(audit))
    first = rows.groupBy(*scope, "file_key").agg(F.min("seq").alias("seq")).select("seq")
    marked = rows.join(first.withColumn("_first", F.lit(True)), "seq", "left")
    return marked.withColumn("duplicate_of_url", F.when(F.col("_first").isNull(), F.col("file_key"))).drop("_first")


def _measures(status: Column, n: Column) -> list[Column]:
    def total(test: Column) -> Column:
        return F.count_if(test)

    out = [F.sum(n).alias("total_references"), F.count("*").alias("unique_files"),
           total(status.isin(fv.AUDIT_SUCCESS)).alias("downloadable")]
    out += [total(status == s).alias(name) for name, s in _STATUS_MEASURES.items()]
    out += [total(status.isin("referenced_embed", "referenced_stream")).alias("referenced"),
            total(status.isin(FAILED)).alias("failed"),
            (F.sum(n) - F.count("*")).alias("duplicate_references")]
    return out


def audit_summary(audit: DataFrame, by: list[str] = [], scope: list[str] | None = None) -> DataFrame:  # noqa: B006
    """The 20 audit measures over unique files, one row per ``by`` group."""
    unique = unique_files(audit, by if scope is None else scope)
    return unique.groupBy(*by).agg(*_measures(F.col("status"), F.col("n_references")))


def status_histogram(audit: DataFrame) -> DataFrame:
    return unique_files(audit).groupBy("status").agg(F.count("*").alias("n"))


def section_label(key: Column) -> Column:
    low = F.lower(F.trim(key))
    chain = F
    for name, label in fv.SECTION_LABELS.items():
        chain = chain.when(low == name, label)
    return chain.otherwise(fv.SECTION_LABEL_DEFAULT)


def section_summary(audit: DataFrame) -> DataFrame:
    """Per run and section: rows, saved files and measures deduped inside it."""
    by = ["run_id", "section_key"]
    saved = audit.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col("status").isin(fv.AUDIT_SUCCESS)).alias("saved_rows")
    )
    return audit_summary(audit, by).join(saved, by).withColumn("section_label", section_label(F.col("section_key")))


def http_status(message: Column) -> Column:
    return F.regexp_extract(message, r"(?i)HTTP\s+([0-9]{3})", 1).try_cast("int")


def error_status(message: Column, code: Column, by_policy: Column) -> Column:
    """Audit status of a failed fetch."""
    text = F.coalesce(message, F.lit(""))
    status = F.coalesce(F.when(code > 0, code), http_status(text))
    return (
        F.when(by_policy, "skipped_external")
        .when(status.isin(404, 410), "not_found")
        .when(status == 403, "forbidden")
        .when(status == 401, "unauthorized")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(matches(text, fv.TIMEOUT_MESSAGE), "timeout")
        .when(matches(text, fv.NETWORK_MESSAGE), "network_error")
        .otherwise("failed")
    )


def error_classes(failures: DataFrame) -> DataFrame:
    """Failed fetches per host and derived status."""
    status = error_status(F.col("error_message"), F.lit(None).cast("int"), F.lit(False))
    return failures.groupBy(U.host(F.col("file_url")).alias("host"), status.alias("status")).agg(F.count("*").alias("n"))


def with_audit_defaults(records: DataFrame) -> DataFrame:
    """Fill what a record leaves open: type, key, flags derived from status."""
    c = F.col
    return (
        records.withColumn("source_type", F.coalesce("source_type", F.lit("news")))
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("file_url", F.coalesce("file_url", F.lit("")))
        .withColumn("normalized_file_url", U.asset_key(F.trim(F.coalesce(F.nullif(c("normalized_file_url"), F.lit("")), c("file_url")))))
        .withColumn("status", F.coalesce(F.nullif(c("status"), F.lit("")), F.lit("failed")))
        .withColumn("downloadable", F.coalesce("downloadable", c("status").isin(fv.AUDIT_SUCCESS)))
        .withColumn("downloaded", F.coalesce("downloaded", c("status") == "downloaded"))
    )
