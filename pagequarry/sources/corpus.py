"""Readers: captured pages, raw bodies, file listings, seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.operators.ordinals import with_ordinal

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; only the columns a job selects are read."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded files with their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("local_path"), F.col("length").alias("file_size"), "content")


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Existing files; leaving ``content`` out means no byte is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("local_path"), F.col("length").alias("file_size"))


def parse_seed_lines(lines: DataFrame) -> DataFrame:
    """``title , url`` / ``title<TAB>url`` / bare URL lines to seed rows.

    ``lines``: ``seq, line``; other lines are dropped.
    """
    line = F.trim(F.regexp_replace("line", r"\r$", ""))
    titled = r"(?i)^(.*?)[,|\t]\s*(https?://\S+)$"
    rows = lines.withColumn("line", line)
    has_title, bare = F.col("line").rlike(titled), F.col("line").rlike(r"(?i)^https?://\S+$")
    return rows.where(has_title | bare).select(
        "seq",
        F.when(has_title, F.trim(F.regexp_extract("line", titled, 1))).otherwise("").alias("title"),
        F.when(has_title, F.regexp_extract("line", titled, 2)).otherwise(F.col("line")).alias("url"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line): the lines of all text files below ``path``, numbered by file name and place.

    A file's blocks may be read by different tasks, in any order; the number
    follows the file, the block's first byte and the place inside the block.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    return with_ordinal(lines, [], ["file", "block", "place"], "seq").select("seq", "line")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed files as rows, in the order of their lines."""
    return parse_seed_lines(read_lines(spark, path))


def validate_seeds(seeds: DataFrame, cap: int = fv.TOPIC_LIMIT) -> DataFrame:
    """All seeds, with an error where one is beyond the first ``cap``, its title repeated or its URL bad.

    The last accepted ``seq`` comes from a top-k: each task keeps at most ``cap`` rows.
    """
    last = seeds.orderBy("seq").limit(cap).agg(F.max("seq")).scalar()
    first = seeds.where("title <> ''").groupBy(F.lower("title").alias("_k")).agg(F.min("seq").alias("seq")).select("seq")
    marked = seeds.join(first.withColumn("_first", F.lit(True)), "seq", "left")
    error = (
        F.when(F.col("seq") > last, "over_limit")
        .when(F.coalesce("url", F.lit("")) == "", "missing_url")
        .when(~U.is_http(F.col("url")), "bad_url")
        .when((F.col("title") != "") & F.col("_first").isNull(), "duplicate_title")
    )
    return marked.withColumn("error", error).drop("_first")
