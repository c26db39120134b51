"""Fixpoint jobs over link tables: crawl reach, closures, frontier, caps.

Each level is a shuffle join of the frontier with the edges and an anti join
with what is known; the level is checkpointed (reliably, in the shared
folder), so plans stay short and a lost executor costs one level at most.
"""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import clean_text, matches
from pagequarry.operators.extract import css_urls
from pagequarry.operators.ordinals import with_ordinal
from pagequarry.operators.policy import is_public_page
from pagequarry.session import cut_lineage, work_dir
from pagequarry.sources.buckets import BucketStore, KnownKeys


def reach(edges: DataFrame, roots: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """Breadth-first levels: ``*keys, node, depth, discovered_from``.

    ``edges``: ``*keys, src, dst``; ``roots``: ``*keys, node, depth`` (entries
    may start deeper, like sitemap pages at depth 1).  A node's depth is its
    first level, its parent the smallest node of the level before.  Levels are
    followed until one is empty, unless ``max_depth`` is given.
    """
    edges = cut_lineage(edges.select(*keys, "src", "dst").distinct())
    entry = roots.groupBy(*keys, "node").agg(F.min("depth").alias("depth"))
    entry = cut_lineage(entry.withColumn("discovered_from", F.lit(None).cast(edges.schema["src"].dataType)))
    level = entry.where("depth = 0")
    known = level
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        # never broadcast: addresses are small when shuffled and large in the driver's memory
        found = level.select(*keys, F.col("node").alias("src")).hint("merge").join(edges, [*keys, "src"])
        found = found.select(*keys, F.col("dst").alias("node"), F.col("src").alias("discovered_from"))
        late = entry.where(F.col("depth") == depth).select(*keys, "node", "discovered_from")
        fresh = found.unionByName(late).groupBy(*keys, "node").agg(F.min("discovered_from").alias("discovered_from"))
        fresh = fresh.join(known.select(*keys, "node").hint("merge"), [*keys, "node"], "left_anti")
        level = cut_lineage(fresh.withColumn("depth", F.lit(depth)).select(*keys, "node", "depth", "discovered_from"))
        if level.isEmpty() and entry.where(F.col("depth") > depth).isEmpty():
            break
        known = known.unionByName(level)
    return known


def captured_links(hrefs: DataFrame) -> DataFrame:
    """(src, dst): public links of captured pages to pages of the same site.

    ``hrefs``: ``url`` (the page) and ``href``; both ends are canonical.
    """
    pairs = hrefs.select(U.crawl_canonical(F.col("url")).alias("src"), U.crawl_canonical(F.col("href")).alias("dst"))
    inside = (F.col("dst") != "") & (F.col("src") != F.col("dst")) & (U.site(F.col("src")) == U.site(F.col("dst")))
    return pairs.where(inside & is_public_page(F.col("dst"))).distinct()


def crawl(
    links: DataFrame, roots: DataFrame, listed: DataFrame | None = None, folder: str | None = None, max_depth: int | None = None
) -> DataFrame:
    """Pages reached over captured links: ``node, depth, discovered_from``.

    ``links``: ``src, dst``; ``roots``: ``node``; ``listed``: ``node``, pages
    that a sitemap names, which enter at depth 1 as found by ``sitemap``.  A
    page's depth is its first level, its discoverer the smallest page of the
    level before.  Levels are followed until one is empty, unless ``max_depth``
    is given.

    Links and known pages are tables with the same buckets, so a level moves
    only the links that its own pages have found.  With a ``folder`` the crawl
    goes on behind the last level that was committed there, if its roots are
    the same.
    """
    spark = links.sparkSession
    store = BucketStore(spark, folder or f"{work_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}")
    start = roots.select("node").where("node <> ''").distinct()
    if "roots" in store:
        before = store.load("roots")
        if not (before.exceptAll(start).isEmpty() and start.exceptAll(before).isEmpty()):
            raise ValueError(f"{store.folder} holds a crawl with other roots")
    else:
        store.save(start, "roots", "node")
    edges = store.load("links") if "links" in store else store.save(links.select("src", "dst").distinct(), "links", "src")
    known, levels = KnownKeys(store, "node"), []
    for depth in itertools.count() if max_depth is None else range(max_depth + 1):
        name = f"level-{depth}"
        if name not in store:
            if depth == 0:
                fresh = start.withColumn("discovered_from", F.lit(None).cast("string"))
            else:
                found = levels[-1].select(F.col("node").alias("src")).join(edges, "src")
                found = found.select(F.col("dst").alias("node"), F.col("src").alias("discovered_from"), F.lit(1).alias("rank"))
                if depth == 1 and listed is not None:
                    entry = listed.select("node", F.lit("sitemap").alias("discovered_from"), F.lit(0).alias("rank")).where("node <> ''")
                    found = found.unionByName(entry)
                first = found.groupBy("node").agg(F.min(F.struct("rank", "discovered_from")).alias("first"))
                fresh = known.unknown(first.select("node", "first.discovered_from"))
            store.save(fresh.select("node", F.lit(depth).alias("depth"), "discovered_from"), name, "node")
        if depth and not store.rows(name):
            break
        levels.append(store.load(name))
        known.add(levels[-1], store.rows(name))
    return reduce(DataFrame.unionByName, levels)


def pagination_closure(listing_links: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All listing pages reachable from each seed, until no new page comes.

    ``listing_links``: ``seed_id, page_canon, target``; ``seeds``: ``seed_id,
    seed_canon``.
    """
    edges = listing_links.select("seed_id", F.col("page_canon").alias("src"), F.col("target").alias("dst"))
    roots = seeds.select("seed_id", F.col("seed_canon").alias("node"), F.lit(0).alias("depth"))
    return reach(edges, roots, ["seed_id"], max_depth)


def css_closure(sheets: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Resources reachable through stylesheets: ``url, css`` and start URLs."""
    owner = sheets.withColumn("page_id", F.col("url"))
    edges = css_urls(owner).select(F.col("page_id").alias("src"), F.col("href").alias("dst"))
    roots = start.select(F.col("url").alias("node"), F.lit(0).alias("depth"))
    return reach(edges, roots, [], max_depth)


def sitemap_urls(maps: DataFrame, starts: DataFrame, max_maps: int | None = None, max_urls: int | None = None) -> DataFrame:
    """Public same-site pages listed by a site's sitemaps, nested ones too.

    ``maps``: ``map_url, xml`` (a map may span rows); ``starts``: ``site,
    start_url, map_url``.  All maps and pages, unless limited: per site at most
    ``max_maps`` maps in breadth-first order and ``max_urls`` pages, counted
    exactly (``fv.SITEMAP_LIMITS`` has the usual limits).
    """
    locs = maps.select("map_url", F.explode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc\b[^>]*>([\s\S]*?)</loc>"), F.lit(1))).alias("raw"))
    locs = locs.withColumn("loc", U.crawl_canonical(U.resolve(clean_text(F.col("raw")), F.col("map_url")))).where("loc <> ''")
    locs = locs.withColumn("is_map", matches(F.col("loc"), r"\.xml(?:$|[?#])"))
    edges = starts.select("site", "map_url").distinct()
    nested = locs.where("is_map").select(F.col("map_url").alias("src"), F.col("loc").alias("dst"))
    # nested maps inherit their site by joining level by level
    roots = edges.select("site", F.col("map_url").alias("node"), F.lit(0).alias("depth"))
    sited = reach_by_src(nested, roots)
    chosen = sited
    if max_maps is not None or max_urls is not None:
        order = Window.partitionBy("site").orderBy("depth", "node")
        # only map addresses are ranked here, a site has few of them
        chosen = sited.withColumn("n", F.row_number().over(order))
    if max_maps is not None:
        chosen = chosen.where(F.col("n") <= max_maps)
    pages = locs.where("NOT is_map").join(chosen, F.col("map_url") == F.col("node"))
    pages = pages.where((U.site(F.col("loc")) == F.col("site")) & is_public_page(F.col("loc")))
    if max_urls is None:
        return pages.select("site", "loc").distinct()
    first = pages.groupBy("site", "loc").agg(F.min("n").alias("map_no"))
    return _first_pages(first, max_urls)


def sitemap_starts(sites: DataFrame) -> DataFrame:
    """``site, start_url, map_url``: the usual addresses of a site's map; ``sites``: ``site, start_url`` (its origin)."""
    return sites.select("site", "start_url", F.explode(F.array(*[F.concat("start_url", F.lit(p)) for p in fv.SITEMAP_PATHS])).alias("map_url"))


def reach_by_src(nested: DataFrame, roots: DataFrame) -> DataFrame:
    """Closure where only the roots know their site; ends when a level is empty."""
    nested = cut_lineage(nested.distinct())
    known = level = cut_lineage(roots)
    for depth in itertools.count(1):
        fresh = level.join(nested, F.col("node") == F.col("src")).select("site", F.col("dst").alias("node"), F.lit(depth).alias("depth"))
        level = cut_lineage(fresh.distinct().join(known.select("site", "node"), ["site", "node"], "left_anti"))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def _first_pages(pages: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` URLs of a site in map order, without one big window."""
    sizes = pages.groupBy("site", "map_no").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("site").orderBy("map_no").rowsBetween(Window.unboundedPreceding, -1))
    room = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cap)
    rows = pages.join(room, ["site", "map_no"])
    inside = F.row_number().over(Window.partitionBy("site", "map_no").orderBy("loc"))
    # a single sitemap file holds a bounded number of URLs
    return rows.where(F.col("_before") + F.col("_n") <= cap).select("site", "loc").unionByName(
        rows.where(F.col("_before") + F.col("_n") > cap)
        .withColumn("_i", inside + F.col("_before"))
        .where(F.col("_i") <= cap)
        .select("site", "loc")
    )


def page_links_union(hrefs: DataFrame, dom_links: DataFrame) -> DataFrame:
    """Distinct links of a page from the DOM and from its HTML."""
    both = hrefs.select("page_id", "href").unionByName(dom_links.select("page_id", "href"))
    return both.select("page_id", U.crawl_canonical(F.col("href")).alias("link")).where("link <> ''").distinct()


def frontier(links: DataFrame, visited: DataFrame, resources: DataFrame) -> DataFrame:
    """Links worth visiting next: same site, public, not seen, not a resource of the page that holds them.

    ``links``: ``page_id, url, link``; ``visited``: ``link``; ``resources``:
    ``page_id, file_key``.  A page's resource stays a link of other pages.
    """
    fresh = links.where((U.site(F.col("link")) == U.site(F.col("url"))) & is_public_page(F.col("link")))
    keys = resources.select("page_id", F.col("file_key").alias("link")).distinct()
    followed = fresh.join(keys, ["page_id", "link"], "left_anti")
    distinct = followed.groupBy("link").agg(F.min("url").alias("discovered_from"))
    return distinct.join(visited.select("link").distinct(), "link", "left_anti")


def page_caps(reached: DataFrame, cap: int, keys: list[str]) -> DataFrame:
    """First ``cap`` pages per key in discovery order (depth, then node).

    Whole levels pass or fail by their counts; only the level that crosses the
    cap is ranked, range by range.
    """
    sizes = reached.groupBy(*keys, "depth").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    room = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cap)
    rows = reached.join(room, [*keys, "depth"])
    ranked = with_ordinal(rows.withColumnRenamed("_before", "_room"), [*keys, "depth"], "node", "_i")
    kept = ranked.where(F.col("_i") + F.col("_room") <= cap)
    return kept.select(*reached.columns, (F.col("_i") + F.col("_room")).alias("page_index"))


def crawl_summary(pages: DataFrame, assets: DataFrame, queued: DataFrame) -> DataFrame:
    """Pages and assets ok/failed, visited, remaining and limits per run."""
    ok = F.col("status") == "downloaded"
    stored = F.col("status").isin(fv.AUDIT_SUCCESS)
    p = pages.groupBy("run_id").agg(
        F.count_if(ok).alias("page_count"), F.count_if(~ok).alias("page_failed"), F.count_distinct("page_url").alias("visited")
    )
    a = assets.groupBy("run_id").agg(F.count_if(stored).alias("asset_count"), F.count_if(~stored).alias("asset_failed"))
    q = queued.groupBy("run_id").agg(F.count("*").alias("queued_remaining"))
    joined = p.join(a, "run_id", "full").join(q, "run_id", "full").fillna(0)
    limits = [F.lit(v).alias(k) for k, v in fv.CRAWL_LIMITS.items() if k != "max_file_mb"]
    return joined.select("*", *limits)
