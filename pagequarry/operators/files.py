"""File body jobs: signatures, charsets, names, text sanitising."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import ci, safe_name
from pagequarry.operators.ordinals import with_ordinal


def _head_hex(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def signature(content: Column) -> Column:
    """struct<kind, extension, mime> told from the bytes, NULL if unknown."""

    def known(kind: str, ext: str, mime: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(ext).alias("extension"), F.lit(mime).alias("mime"))

    head = _head_hex(content, 16)
    # a PDF header may start anywhere in the first 1,024 bytes (whole bytes)
    pdf = _head_hex(content, 1024).rlike(rf"^(?:..)*?{fv.PDF_MARK_HEX}")
    chain = F.when(pdf, known("pdf", ".pdf", "application/pdf"))
    for kind, ext, mime, prefixes in fv.FILE_SIGNATURES:
        chain = chain.when(head.rlike("^(?:" + "|".join(prefixes) + ")"), known(kind, ext, mime))
    return chain


def is_html_body(content: Column) -> Column:
    """The bytes look like markup and carry no file signature."""
    sample = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    text = F.regexp_replace(sample, r"^\xEF\xBB\xBF", "")
    return text.rlike(ci(fv.HTML_BODY))


def declared_mime(header: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(header, F.lit("")), r"^([^;]*)", 1)))


def file_signatures(bodies: DataFrame) -> DataFrame:
    """Kind per body, and whether it contradicts the declared type."""
    sig, declared = F.col("sig"), declared_mime(F.col("declared_type"))
    rows = bodies.withColumn("sig", signature(F.col("content"))).withColumn("_html", is_html_body(F.col("content")))
    html = F.when(sig.isNotNull(), False).when(F.col("_html"), True).otherwise(declared.isin(fv.HTML_TYPES))
    return rows.select(
        *[c for c in bodies.columns if c != "content"],
        F.coalesce(sig["kind"], F.lit("unknown")).alias("kind"), F.coalesce(sig["extension"], F.lit("")).alias("extension"),
        F.coalesce(sig["mime"], declared).alias("mime"), html.alias("looks_like_html"),
        F.when(sig.isNotNull() & declared.isin(fv.HTML_TYPES), "file_declared_html")
        .when(html & ~declared.isin(fv.HTML_TYPES), "html_declared_file")
        .otherwise("consistent")
        .alias("verdict"),
        F.octet_length("content").alias("file_size"),
    )


def signature_report(bodies: DataFrame) -> DataFrame:
    return file_signatures(bodies).groupBy("kind", "declared_type", "verdict").agg(F.count("*").alias("n"))


def body_charset(content: Column, header: Column) -> Column:
    """Charset named by the header, else by the first 4,096 bytes, else UTF-8."""
    sample = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    both = F.concat_ws("\n", F.coalesce(header, F.lit("")), sample)
    named = F.lower(F.regexp_extract(both, r"(?i)charset\s*=\s*[\"']?([a-z0-9_-]+)", 1))
    return F.when(named == "", "utf-8").when(named.isin(fv.THAI_CHARSETS), "windows-874").otherwise(named)


#: Bytes that browsers read as windows-1252 where ISO-8859-1 has control characters.
_C1 = {bytes([b]).decode("latin-1"): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _decode(content: Column, charset: str) -> Column:
    if charset == "windows-1252":
        return F.translate(F.decode(content, "ISO-8859-1"), "".join(_C1), "".join(_C1.values()))
    return F.decode(content, charset)


def decoded_bodies(bodies: DataFrame, header: str = "declared_type") -> DataFrame:
    """Add ``charset`` and ``text``; unknown charsets read as UTF-8.

    Other charsets than ISO-8859-1 and UTF-16 need ``spark.sql.legacy.javaCharsets=true``;
    with ``spark.sql.legacy.codingErrorAction=true`` bytes that a charset lacks
    become U+FFFD, without it they end the query.
    """
    rows = bodies.withColumn("charset", body_charset(F.col("content"), F.col(header)))
    text = F
    for name, labels in fv.CHARSET_LABELS.items():
        text = text.when(F.col("charset").isin(labels.split()), _decode(F.col("content"), name))
    return rows.withColumn("text", text.otherwise(F.col("content").cast("string")))


def name_from_headers(disposition: Column, u: Column) -> Column:
    """File name from Content-Disposition, else the URL's last segment."""
    utf = F.nullif(F.regexp_extract(disposition, r"(?i)filename\*\s*=\s*UTF-8''([^;\n]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(disposition, r"(?i)filename\s*=\s*\"?([^\";\n]+)\"?", 1), F.lit(""))
    return safe_name(U.decode_component(F.coalesce(utf, plain, F.nullif(U.last_segment(u), F.lit("")), F.lit("file"))))


def with_extension(name: Column, sig: Column, mime: Column) -> Column:
    """Names without a known extension get one from bytes, then MIME."""
    by_mime = F.create_map(*[F.lit(x) for pair in fv.MIME_EXTENSIONS.items() for x in pair])
    ext = F.coalesce(F.nullif(sig["extension"], F.lit("")), by_mime[mime], F.lit(""))
    return F.when(name.rlike(ci(fv.KNOWN_FILE_EXT)), name).otherwise(F.concat(name, ext))


def asset_names(bodies: DataFrame) -> DataFrame:
    """Target file name per body (``file_name``, ``declared_type``, ``content``)."""
    name = with_extension(F.col("file_name"), signature(F.col("content")), declared_mime(F.col("declared_type")))
    return bodies.withColumn("asset_name", name).drop("content")


def unique_names(files: DataFrame) -> DataFrame:
    """Second, third, ... same name of a directory gets -2, -3, ...

    ``files``: ``seq, directory, asset_name``; block ordinals keep a popular
    name from gathering in one task.
    """
    ranked = with_ordinal(files, ["directory", "asset_name"], "seq", "_n")
    # the extension of a dot file is empty
    ext = F.regexp_extract("asset_name", r"^[\s\S]+(\.[^.]*)$", 1)
    stem = F.substring(F.col("asset_name"), F.lit(1), F.length("asset_name") - F.length(ext))
    unique = F.when(F.col("_n") == 1, F.col("asset_name")).otherwise(
        F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext)
    )
    return ranked.withColumn("unique_name", unique).drop("_n")


@F.pandas_udf(StringType())
def unicode_nfc(values: pd.Series) -> pd.Series:
    """Canonical composition, the one step without a built-in function."""
    return values.str.normalize("NFC")


def tis620_text(c: Column, compose: bool = False) -> Column:
    """Text without characters outside ASCII and the Thai block."""
    return F.regexp_replace(unicode_nfc(c) if compose else c, fv.TIS620_OUTSIDE, "")


def sanitize_columns(df: DataFrame, compose: bool = False) -> DataFrame:
    """Sanitise every string column; ``changed`` tells whether any differed."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    clean = {n: tis620_text(F.col(n), compose) for n in names}
    changed = F.lit(False)
    for n, c in clean.items():
        changed = changed | F.coalesce(c != F.col(n), F.lit(False))
    return df.select(*[clean.get(n, F.col(n)).alias(n) for n in df.columns], changed.alias("changed"))


def pdf_storage(files: DataFrame, max_mb: int = fv.PDF_STORE_MB) -> DataFrame:
    """Keep PDF bytes up to the size limit; hash every body."""
    sig = signature(F.col("content"))
    is_pdf = (
        F.startswith(declared_mime(F.col("declared_type")), F.lit("application/pdf"))
        | F.coalesce(sig["kind"] == "pdf", F.lit(False))
        | F.col("file_name").rlike(r"(?i)\.pdf$")
    )
    keep = is_pdf & (F.octet_length("content") <= max_mb * 1024 * 1024)
    return files.select(
        "*", F.sha2("content", 256).alias("file_sha256"), F.when(keep, F.col("content")).alias("pdf_data"),
        keep.alias("pdf_stored_in_db"),
    )
