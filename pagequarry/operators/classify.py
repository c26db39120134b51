"""Link classification against a seed: detail, listing, other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import ci, matches
from pagequarry.operators.extract import is_useful_text
from pagequarry.operators.ordinals import with_ordinal
from pagequarry.operators.policy import category_matches


def seed_profiles(seeds: DataFrame) -> DataFrame:
    """Parsing mode per seed URL, for announcements and for albums."""
    u = F.col("seed_url")
    out = seeds.withColumn("cats", U.category_map(U.first_params(u)))
    names = F.map_keys("cats")
    album = F.lower(U.album_path(u))
    return out.select(
        *seeds.columns,
        F.when(F.array_contains(names, "cat_id"), "legacy-cat_id")
        .when(F.array_contains(names, "cid"), "modern-cid")
        .when(F.size("cats") > 0, "query-category")
        .otherwise("path")
        .alias("mode"),
        matches(U.path(u), r"\.(?:php|aspx?)$").alias("script_path"),
        F.when(album.rlike("/albums?/index\\.php$"), "legacy-album")
        .when(album.rlike("/gallery$|/gallery/"), "modern-gallery")
        .otherwise("generic-gallery")
        .alias("album_mode"),
    )


def _vendor_pattern(u: Column, vendor: Column, kind: str, role: str) -> Column:
    """A vendor's own URL pattern for this role fits."""
    tests = [(vendor == v) & matches(u, p) for v, k, r, p in fv.VENDOR_PATTERNS if k == kind and r == role]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def _directory(p: Column) -> Column:
    """Parent directory with a trailing slash ('//' for the root's files)."""
    parent = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.lower(F.when(p.endswith("/"), p).otherwise(F.concat(F.when(parent == "", F.lit("/")).otherwise(parent), F.lit("/"))))


def with_seed(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links of pages on a seed's site, with the seed's facts.

    ``seeds``: ``seed_id, seed_url, vendor_id``.  An equi join on the site;
    the planner broadcasts the seeds when they are measured small.
    """
    s = seeds.select(
        "seed_id", "seed_url", "vendor_id", U.site(F.col("seed_url")).alias("site"), U.path(F.col("seed_url")).alias("seed_path"),
        U.canonical(F.col("seed_url")).alias("seed_canon"), U.category_map(U.first_params(F.col("seed_url"))).alias("cats"),
    )
    rows = links.withColumn("site", U.site(F.col("url"))).withColumn("params", U.first_params(F.col("href")))
    rows = rows.withColumn("path", U.path(F.col("href"))).withColumn("link_site", U.site(F.col("href")))
    return rows.join(s, "site")


def link_kind() -> Column:
    """'detail', 'listing' or 'other' of a row made by ``with_seed``."""
    c = F.col
    u, p, params = c("href"), c("path"), c("params")
    asset = U.is_link_asset(u)
    on_site = c("link_site") == c("site")
    is_seed = c("canon") == c("seed_canon")
    noise = matches(p, fv.ROUTE_NOISE)
    fits = category_matches(params, c("cats"), allow_missing=True)
    known = U.pick_param(params, fv.RECORD_ID_PARAMS).isNotNull()
    action = U.pick_param(params, fv.ACTION_PARAMS)["value"]
    page_path = matches(p, fv.PAGE_PATH)
    paged = U.pick_param(params, fv.PAGE_PARAMS).isNotNull() | page_path | is_seed
    unknown = U.record_unknown_id(params).isNotNull()
    token = U.record_path_token(u)

    base, own = F.regexp_replace("seed_path", "/+$", "/"), F.regexp_replace("path", "/+$", "/")
    nested_token = (own != base) & F.startswith(own, base) & token.isNotNull() & ~F.lower(token).isin("page", "paged")
    detail = (
        F.when(asset | ~on_site | is_seed | noise, False)
        .when(_vendor_pattern(u, c("vendor_id"), "news", "detail"), True)
        .when(~fits, False)
        .when(known, True)
        .when(matches(action, fv.ACTION_VALUE_WITH_ARTICLE), True)
        .when(page_path, False)
        .when(matches(p, fv.DETAIL_PATH) | matches(p, fv.DETAIL_FILE), True)
        .when(nested_token, True)
        .otherwise((own == base) & unknown)
    )

    seed_dir, own_dir = _directory(c("seed_path")), _directory(p)
    bare = F.lower(F.concat(F.regexp_replace("seed_path", "/+$", ""), F.lit("/")))
    name = F.lower(U.base_name(p))
    stem = F.lower(F.regexp_replace(U.base_name(c("seed_path")), r"\.[^.]+$", ""))
    named_after_seed = F.regexp_like(name, F.concat(F.lit(r"(?i)(?:^|[-_])\Q"), stem, F.lit(r"\E(?:[-_].*)?.(?:php|html?|aspx?)$")))
    sibling = (
        is_useful_text(c("text")) & ~asset & on_site & ~is_seed & fits & ~paged & ~noise
        & ((own_dir == seed_dir) | F.startswith(F.lower(p), bare))
        & (
            unknown | matches(p, fv.DETAIL_FILE) | named_after_seed
            | (name.rlike("[0-9]{2,}") & matches(name, fv.SCRIPT_FILE))
        )
    )
    listing = (
        ~asset & on_site
        & (
            (_vendor_pattern(u, c("vendor_id"), "news", "listing") & paged)
            | (fits & (is_seed | (((F.lower(p) == F.lower("seed_path")) | F.startswith(F.lower(p), seed_dir)) & paged)))
        )
    )
    return F.when(detail | sibling, "detail").when(listing, "listing").otherwise("other")


def classified_links(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Navigation links with their kind for each seed of the site.

    Detail links are deduplicated by page key (longest text); listing links
    get the seed's category added and are keyed by the result.
    """
    rows = with_seed(links, seeds).withColumn("kind", link_kind())
    missing = F.map_filter("cats", lambda k, v: ~F.exists("params", lambda p: p["name"] == k))
    extra = F.array_join(
        F.transform(F.map_entries(missing), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&"
    )
    bare = U.drop_fragment(F.col("href"))
    widened = F.when(extra == "", bare).otherwise(
        F.concat(bare, F.when(F.instr(bare, "?") > 0, F.lit("&")).otherwise(F.lit("?")), extra)
    )
    target = F.when(F.col("kind") == "listing", U.canonical(widened)).otherwise(F.col("canon"))
    rows = rows.withColumn("target", target)
    best = F.struct(F.length("text"), -F.col("pos"))
    return rows.groupBy("seed_id", "page_id", "kind", "target").agg(
        F.max_by("text", best).alias("text"), F.max_by("context_text", best).alias("context_text"),
        F.max_by("href", best).alias("href"), F.min("pos").alias("pos"),
    )


# --- albums -----------------------------------------------------------------------------
def album_link_kind() -> Column:
    """'detail', 'listing' or 'other' of an album link (``with_seed`` row)."""
    c = F.col
    u, params = c("href"), c("params")
    pathname = F.lower(U.album_path(u))
    start = F.lower(U.album_path(c("seed_url")))
    asset = F.concat(c("path"), U.search(u)).rlike(ci(fv.ALBUM_ASSET_EXT))
    on_site, is_seed = c("link_site") == c("site"), c("canon") == c("seed_canon")
    ident = U.album_id(u, params, c("seed_url"))
    in_query = F.coalesce(U.pick_param(params, fv.ALBUM_ID_PARAMS)["value"], U.album_unknown_id(params)["value"])
    legacy = (pathname.endswith("/activities.php") & U.pick_param(params, ["salb_id"]).isNotNull()) | (
        pathname.rlike("/albums?/view\\.php$") & U.pick_param(params, ["album_id", "id"]).isNotNull()
    )
    verb_path = pathname.rlike(r"/(?:gallery|galleries|album|albums|activity|activities)/(?:view|detail|show)(?:/|\.php$|$)")
    same, nested = pathname == start, F.startswith(pathname, F.concat(start, F.lit("/")))
    page_path = matches(pathname, fv.PAGE_PATH)
    paged = U.pick_param(params, fv.ALBUM_PAGE_PARAMS).isNotNull() | matches(c("path"), fv.PAGE_PATH) | is_seed
    detail = (
        F.when(asset | ~on_site | is_seed, False)
        .when(_vendor_pattern(u, c("vendor_id"), "activity", "detail"), True)
        .when(legacy, True)
        .when(verb_path, ident.isNotNull())
        .when(same & ident.isNotNull(), True)
        .when(nested, ~page_path & U.album_path_token(u, c("seed_url")).isNotNull())
        .otherwise(False)
    )
    seed_dir, own_dir = _directory(c("seed_path")), _directory(c("path"))
    trimmed = F.lower(F.regexp_replace("seed_path", "/+$", ""))
    under = (trimmed != "") & F.startswith(F.lower("path"), F.concat(trimmed, F.lit("/")))
    file_like = r"(?:^|/)[^/]*(?:album|gallery|activity|photo|detail|view|show|data)[^/]*\.(?:php|html?|aspx?)(?:$|\?)"
    sibling = (
        is_useful_text(c("text")) & ~asset & on_site & ~is_seed & ~paged & ~matches(c("path"), fv.ROUTE_NOISE)
        & ((own_dir == seed_dir) | under)
        & (in_query.isNotNull() | ident.isNotNull() | matches(c("path"), file_like))
    )
    listing = ~asset & on_site & (
        (_vendor_pattern(u, c("vendor_id"), "activity", "listing") & paged)
        | is_seed
        | ((same | (nested & page_path)) & paged)
    )
    return F.when(detail | sibling, "detail").when(listing, "listing").otherwise("other")


def classified_album_links(links: DataFrame, seeds: DataFrame) -> DataFrame:
    rows = with_seed(links, seeds).withColumn("kind", album_link_kind())
    rows = rows.withColumn("album_id", U.album_id(F.col("href"), F.col("params"), F.col("seed_url")))
    best = F.struct(F.length("text"), -F.col("pos"))
    return rows.groupBy("seed_id", "page_id", "kind", F.col("canon").alias("target")).agg(
        F.max_by("text", best).alias("text"), F.max_by("album_id", best).alias("album_id"), F.min("pos").alias("pos")
    )


# --- coverage and order --------------------------------------------------------------------
def aligned_urls(links: DataFrame) -> DataFrame:
    """Link targets moved to the origin of the page that mentions them."""
    return links.withColumn("aligned", U.align_origin(F.col("href"), F.col("url")))


def coverage(declared: DataFrame, details: DataFrame) -> DataFrame:
    """Declared total, discovered details and largest numeric id per seed."""
    totals = declared.groupBy("seed").agg(F.max("declared").alias("declared"))
    found = details.groupBy("seed").agg(
        F.count_distinct("detail_id").alias("discovered"), F.max(F.col("detail_id").try_cast("bigint")).alias("max_id")
    )
    joined = totals.join(found, "seed", "full").fillna(0)
    return joined.withColumn("missing", F.greatest(F.lit(0), F.col("declared") - F.col("discovered")))


def listing_order(records: DataFrame) -> DataFrame:
    """Place of each record of a seed across its listing pages.

    ``records``: ``seed, page_no, pos`` (``pos`` unique inside a page).  The
    ordinal inside one page plus the sizes of earlier pages.
    """
    pages = records.groupBy("seed", "page_no").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("seed").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pages.select("seed", "page_no", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = with_ordinal(records, ["seed", "page_no"], "pos", "_inside")
    return inside.join(offsets, ["seed", "page_no"]).select(
        *records.columns, (F.col("_inside") + F.col("_before")).alias("listing_pos")
    )


