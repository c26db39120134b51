"""Filters and policies over links: scheme, scope, skip rules, noise, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import media as M
from pagequarry.functions import tags as T
from pagequarry.functions import urls as U
from pagequarry.functions.text import html_decode, matches
from pagequarry.operators.extract import explode_matches


def raw_references(pages: DataFrame, names: list[str]) -> DataFrame:
    """Attribute values as written (entities decoded), one row each."""
    rows = explode_matches(pages, T.assignments(F.col("html"), names, boundary=False))
    return rows.select("page_id", "url", html_decode(T.unquote(F.col("m"))).alias("ref"))


def scheme_counts(refs: DataFrame) -> DataFrame:
    """References per written scheme, and whether they pass as http(s)."""
    own = F.lower(F.regexp_extract("ref", r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    kind = F.when(own == "", F.lit("relative")).otherwise(own)
    return refs.groupBy(kind.alias("scheme"), U.is_http(F.col("ref")).alias("is_http")).agg(F.count("*").alias("n"))


def site_link_counts(links: DataFrame) -> DataFrame:
    """Per site: distinct internal pages, external links and files.

    ``links`` has ``url`` (the page) and ``href``.
    """
    facts = links.select(
        U.site(F.col("url")).alias("site"),
        U.crawl_canonical(F.col("href")).alias("link"),
        (U.site(F.col("href")) == U.site(F.col("url"))).alias("internal"),
        M.asset_class(F.col("href"), F.lit("")).alias("kind"),
    ).where("link <> ''")
    # one row per (site, link) first: the distinct counts then need no expand
    once = facts.groupBy("site", "link").agg(
        F.bool_or("internal").alias("internal"), F.max("kind").alias("kind")
    )
    return once.groupBy("site").agg(
        F.count_if(F.col("internal") & (F.col("kind") == "other")).alias("internal_pages"),
        F.count_if(~F.col("internal")).alias("external_links"),
        F.count_if(F.col("kind") == "documents").alias("files"),
    )


def external_policy(links: DataFrame, allow_external: bool = False) -> DataFrame:
    """Keep same-site assets; others are kept or marked skipped_external."""
    same = U.site(F.col("href")) == U.site(F.col("url"))
    status = F.when(same | F.lit(allow_external), F.lit("keep")).otherwise(F.lit("skipped_external"))
    return links.withColumn("decision", status)


def _host_rule(value: str) -> str:
    """A configured host without scheme, path, port, www. or edge dots."""
    host = value.strip().lower().split("://")[-1].split("/")[0].split(":")[0]
    return (host[4:] if host.startswith("www.") else host).strip(".")


def skip_reason(
    u: Column, hosts: list[str] | None = None, fragments: list[str] | None = None, use_defaults: bool = True
) -> Column:
    """First matching skip reason of a serialised URL, NULL to keep it."""
    prefix, suffix = fv.SKIP_HOST_REASON
    defaults = [_host_rule(p) for _, kind, p, _ in fv.SKIP_RULES if kind == "host"] if use_defaults else []
    blocked = list(dict.fromkeys([h for h in defaults + [_host_rule(v) for v in hosts or []] if h]))
    bare_host = U.site(u)
    chain = F.when(
        ~U.scheme(u).isin("http", "https"), F.concat(F.lit(fv.SKIP_SCHEME_PREFIX), U.scheme(u), F.lit(":"))
    )
    for _, kind, pattern, reason in sorted(fv.SKIP_RULES):
        if kind == "url_regex":
            chain = chain.when(matches(u, pattern), reason)
    for h in blocked:
        chain = chain.when((bare_host == h) | bare_host.endswith("." + h), prefix + h + suffix)
    for f in fragments or []:
        chain = chain.when(F.contains(F.lower(u), F.lit(f.lower())), fv.SKIP_FRAGMENT_PREFIX + f.lower())
    return chain


def skip_policy(links: DataFrame, **options) -> DataFrame:
    """Links with the reason to skip them (NULL keeps the link)."""
    return links.withColumn("skip_reason", skip_reason(F.col("href"), **options))


def page_scope(u: Column) -> Column:
    """Why a URL is not a public page, NULL when it is one."""
    return (
        F.when(matches(u, fv.CRAWL_ASSET_EXT), "asset")
        .when(matches(u, fv.BLOCKED_ROUTE), "blocked_route")
        .when(~u.rlike("^https?:"), "scheme")
        .when(matches(U.path(u), fv.EXECUTABLE_EXT), "executable")
        .when(F.exists(U.param_pairs(u), lambda p: p["key"] == "download"), "download")
    )


def is_public_page(u: Column) -> Column:
    return page_scope(u).isNull()


def image_rules(links: DataFrame) -> DataFrame:
    """Per-rule flags of the image noise filter (``href``, ``context``)."""
    u, context = F.col("href"), F.col("context")
    return links.select(
        "*",
        M.is_media_noise(u, context).alias("is_noise"),
        M.is_gallery_control(u).alias("is_control"),
        M.is_template_asset(u, context).alias("is_template"),
        M.is_content_image(u).alias("is_content"),
    )


def category_matches(params: Column, constraints: Column, allow_missing: bool = False) -> Column:
    """The parameters agree with the category constraints of a seed."""
    names = F.transform(params, lambda p: p["name"])
    return F.forall(
        F.map_entries(constraints),
        lambda e: F.when(
            F.array_contains(names, e["key"]),
            F.exists(params, lambda p: (p["name"] == e["key"]) & (p["value"] == e["value"])),
        ).otherwise(F.lit(allow_missing)),
    )


def input_scope(config: DataFrame) -> DataFrame:
    """Configured URLs with their primary URL and accepted/ignored decision.

    ``config``: ``config_id, ord, role, value``; the ``site`` role, else the
    first http(s) value, is primary.
    """
    urls = config.where(U.is_http(F.col("value"))).withColumn("value", F.trim("value"))
    primary = urls.groupBy("config_id").agg(
        F.min_by("value", F.struct(F.when(F.col("role") == "site", 0).otherwise(1), F.col("ord"))).alias("primary_url")
    )
    same = U.site(U.resolve(F.col("value"), F.col("value"))) == U.site(U.resolve(F.col("primary_url"), F.col("primary_url")))
    return (
        urls.join(primary, "config_id")
        .withColumn("accepted", same)
        .groupBy("config_id", "value")
        .agg(F.min("ord").alias("ord"), F.first("primary_url").alias("primary_url"), F.first("accepted").alias("accepted"))
    )


def audit_search(
    flagged: DataFrame, status: str = "", search: str = "", offset: int = 0, limit: int = 500
) -> DataFrame:
    """A page of audit rows: status or 'duplicate', text in five columns.

    ``flagged`` carries ``is_duplicate``.  The sort plus offset/limit is a
    top-k, never a full collect; ``total_matched`` rides along.
    """
    rows = flagged
    if status == "duplicate":
        rows = rows.where("is_duplicate")
    elif status and status != "all":
        rows = rows.where(~F.col("is_duplicate") & (F.col("status") == status))
    needle = search.strip().lower()
    if needle:
        columns = [c for c in ["file_name", "file_url", "title", "detail_url", "error_message"] if c in rows.columns]
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
        rows = rows.where(hit)
    page = rows.orderBy("seq").offset(max(0, offset)).limit(max(1, min(fv.AUDIT_PAGE_LIMIT, limit)))
    return page.withColumn("total_matched", rows.agg(F.count("*")).scalar())
