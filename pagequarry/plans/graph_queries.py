"""Queries over link graphs, sitemaps and crawl state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.operators import classify as C
from pagequarry.operators import extract as X
from pagequarry.operators import graph as G
from pagequarry.operators import media as M
from pagequarry.plans import duck as D
from pagequarry.plans import views as V
from pagequarry.plans.link_queries import _NAV_HTML, _SEEDS, seeds_view
from pagequarry.plans.media_queries import CSS
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables

c = F.col
# every raw page is listed by its host's sitemap; the first page of each site, by address, is its root
_REACH = f"""{D.HREFS}, own AS (SELECT DISTINCT {D.crawl_canonical('url')} AS node, page_id >= 0 AS listed FROM all_pages),
roots AS (SELECT {D.site('node')} AS site, min(node) AS node FROM own GROUP BY 1),
links AS (SELECT DISTINCT src, dst FROM (SELECT {D.crawl_canonical('url')} AS src, {D.crawl_canonical('href')} AS dst FROM hrefs WHERE href IS NOT NULL)
  WHERE dst <> '' AND src <> dst AND {D.site('src')} = {D.site('dst')} AND {D.public_page('dst')}),
e AS (SELECT src, dst, 1 AS rank, src AS via FROM links UNION ALL
  SELECT r.node, o.node, 0, 'sitemap' FROM own o JOIN roots r ON r.site = {D.site('o.node')} WHERE o.listed AND {D.public_page('o.node')}),
reached(node, depth, discovered_from) USING KEY (node) AS (SELECT node, 0, CAST(NULL AS VARCHAR) FROM roots UNION
  SELECT e.dst, w.depth + 1, arg_min(e.via, e.rank || e.via) FROM reached w JOIN e ON e.src = w.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reached k WHERE k.node = e.dst) GROUP BY e.dst, w.depth + 1)"""


def crawl_inputs(t: Tables):
    """(links, roots, listed) of the captured pages and their sites' sitemaps."""
    pages = t.all_pages.select("page_id", "url", "html")
    own = pages.select(U.crawl_canonical(c("url")).alias("node"))
    roots = own.groupBy(U.site(c("node")).alias("site")).agg(F.min("node").alias("node"))
    starts = t.pages.select(U.site(c("url")).alias("site"), U.origin(c("url")).alias("start_url")).distinct()
    listed = G.sitemap_urls(t.view(SITEMAPS, "pages"), G.sitemap_starts(starts)).select(c("loc").alias("node"))
    return G.captured_links(X.page_hrefs(pages)), roots, listed


@plan(f"WITH RECURSIVE {_REACH} SELECT node, CAST(depth AS INTEGER) AS depth, discovered_from FROM reached")
def crawl_reach(t: Tables):
    """Depth and discoverer of every page reachable over captured links and sitemaps."""
    return G.crawl(*crawl_inputs(t))


@plan(f"""WITH RECURSIVE {_REACH}, r AS (SELECT {D.site('node')} AS site, node, CAST(depth AS INTEGER) AS depth FROM reached), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, node) AS page_index FROM r)
SELECT site, node, depth, page_index FROM n WHERE page_index <= 5""")
def page_caps(t: Tables):
    """First pages per site in discovery order."""
    reached = G.crawl(*crawl_inputs(t)).withColumn("site", U.site(c("node")))
    return G.page_caps(reached, 5, ["site"]).select("site", "node", "depth", "page_index")


@plan(f"""WITH RECURSIVE {_NAV_HTML}, {_SEEDS}, j AS (SELECT DISTINCT s.seed_url, {D.canonical('s.seed_url')} AS seed_canon, {D.canonical('n.url')} AS page_canon, n.canon, {D.pick('n.canon', ['cid'])} AS got, s.cid
   FROM nav n JOIN seeds s ON {D.site('n.url')} = {D.site('s.seed_url')} WHERE {D.path('n.canon')} = '/news/' AND {D.site('n.canon')} = {D.site('s.seed_url')}
   AND {D.pick('n.canon', ['id'])} IS NULL),
 l AS (SELECT DISTINCT seed_url, page_canon, canon AS target FROM j WHERE got = cid AND (canon = seed_canon OR {D.pick('canon', ['page'])} IS NOT NULL)),
 e AS (SELECT DISTINCT seed_url, regexp_replace(page_canon, '&id=[0-9]+', '') AS src, target AS dst FROM l),
 w(seed_url, node, depth) USING KEY (seed_url, node) AS (SELECT DISTINCT seed_url, {D.canonical('seed_url')}, 0 FROM seeds UNION
  SELECT DISTINCT w.seed_url, e.dst, w.depth + 1 FROM w JOIN e ON e.seed_url = w.seed_url AND e.src = w.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.w k WHERE k.seed_url = w.seed_url AND k.node = e.dst))
SELECT seed_url, node, depth FROM w""")
def pagination_closure(t: Tables):
    """Listing pages reachable from each seed through pagination links."""
    pages = t.html.selectExpr("-page_id - 1 AS page_id", "url", "html")
    seeds = seeds_view(t)
    links = C.classified_links(X.navigation_links(pages, with_context=False), seeds).where("kind = 'listing'")
    owner = pages.select("page_id", F.regexp_replace(U.canonical(c("url")), "&id=[0-9]+", "").alias("page_canon"))
    listing = links.join(owner, "page_id").select("seed_id", "page_canon", "target").distinct()
    out = G.pagination_closure(listing, seeds.select("seed_id", U.canonical(c("seed_url")).alias("seed_canon")))
    return out.select(c("seed_id").alias("seed_url"), "node", "depth")


_CSS_EDGES = """e AS (SELECT 'https://css.example.org/s' || p_partkey || '.css' AS src, unnest(['https://css.example.org/s' || (2 * p_partkey + 1) || '.css', 'https://css.example.org/s' || (2 * p_partkey + 2) || '.css',
  'https://css.example.org/i/' || p_size || '.png', 'https://css.example.org/f.woff2']) AS dst FROM part)"""


@plan(f"""WITH RECURSIVE {_CSS_EDGES}, w(node, depth) AS (SELECT 'https://css.example.org/s0.css', 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def css_closure(t: Tables):
    """Resources reachable from the first stylesheet."""
    sheets = t.view(CSS, "part").select("url", "css")
    start = t.table("part").where("p_partkey = 0").select(F.lit("https://css.example.org/s0.css").alias("url"))
    return G.css_closure(sheets, start).select("node", "depth")


# every page is listed by a map of its own, the host map lists those maps
SITEMAPS = """
SELECT concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/sitemap.xml') AS map_url,
  concat('<sitemapindex><sitemap><loc>', regexp_extract(url, '^(https?://[^/]+)', 1), '/maps/', CAST(page_id % 4 AS VARCHAR(20)), '.xml</loc></sitemap></sitemapindex>') AS xml FROM pages
UNION ALL
SELECT concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/maps/', CAST(page_id % 4 AS VARCHAR(20)), '.xml'),
  concat('<urlset><url><loc> ', replace(url, '&', '&amp;'), ' </loc></url><url><loc>/login/x</loc></url><url><loc>https://elsewhere.example.net/</loc></url></urlset>') FROM pages
"""


@plan(f"""WITH p AS (SELECT page_id % 4 AS k, {D.site('url')} AS site, {D.origin('url')} AS origin, {D.crawl_canonical('url')} AS loc FROM pages)
SELECT DISTINCT site, loc FROM p WHERE {D.public_page('loc')}""")
def sitemap_urls(t: Tables):
    """Public pages listed by each site's sitemaps."""
    maps = t.view(SITEMAPS, "pages")
    starts = t.pages.select(U.site(c("url")).alias("site"), U.origin(c("url")).alias("start_url")).distinct()
    return G.sitemap_urls(maps, G.sitemap_starts(starts))


@plan(f"""WITH {D.HREFS}, {D.anchors('all_pages')} SELECT DISTINCT page_id, link FROM (SELECT page_id, {D.crawl_canonical('href')} AS link FROM hrefs WHERE href IS NOT NULL UNION ALL
   SELECT page_id, {D.crawl_canonical('href')} FROM anchors WHERE href IS NOT NULL) WHERE link <> ''""")
def page_links_union(t: Tables):
    """Distinct links of each page from both observers."""
    return G.page_links_union(X.page_hrefs(t.all_pages), X.page_anchors(t.all_pages))


@plan(f"""WITH {D.HREFS}, {D.RESOURCES}, l AS (SELECT page_id, {D.crawl_canonical('href')} AS link, url FROM hrefs WHERE href IS NOT NULL),
v AS (SELECT {D.crawl_canonical('url')} AS link FROM all_pages), f AS (SELECT link, min(url) AS discovered_from FROM l ANTI JOIN resources USING (page_id, link)
  WHERE {D.site('link')} = {D.site('url')} AND {D.public_page('link')} GROUP BY link)
SELECT link, discovered_from FROM f ANTI JOIN v USING (link)""")
def frontier(t: Tables):
    """Same-site public links not visited and not a resource."""
    pages = t.all_pages
    # a generator, so that the filters on a link do not repeat its making
    links = X.page_hrefs(pages).select("page_id", "url", F.explode(F.array(U.crawl_canonical(c("href")))).alias("link"))
    visited = pages.select(U.crawl_canonical(c("url")).alias("link"))
    return G.frontier(links, visited, M.page_like_assets(pages))


_LIMITS = ", ".join(f"{v} AS {k}" for k, v in fv.CRAWL_LIMITS.items() if k != "max_file_mb")


@plan(f"""WITH {D.AUDIT}, p AS (SELECT run_id, count(*) FILTER (status = 'downloaded') AS page_count, count(*) FILTER (status <> 'downloaded') AS page_failed, count(DISTINCT file_url) AS visited FROM audit WHERE section_key = 'section_0' GROUP BY 1),
a AS (SELECT run_id, count(*) FILTER (status IN ('downloaded', 'already_exists')) AS asset_count, count(*) FILTER (status NOT IN ('downloaded', 'already_exists')) AS asset_failed FROM audit WHERE section_key IN ('section_1', 'section_2') GROUP BY 1),
q AS (SELECT run_id, count(*) AS queued_remaining FROM audit WHERE section_key = 'section_3' GROUP BY 1)
SELECT run_id, coalesce(page_count, 0) AS page_count, coalesce(page_failed, 0) AS page_failed, coalesce(visited, 0) AS visited, coalesce(asset_count, 0) AS asset_count, coalesce(asset_failed, 0) AS asset_failed, coalesce(queued_remaining, 0) AS queued_remaining, {_LIMITS}
FROM p FULL JOIN a USING (run_id) FULL JOIN q USING (run_id)""")
def crawl_summary(t: Tables):
    """Crawl counters per run."""
    a = t.audit.withColumn("page_url", c("file_url"))
    return G.crawl_summary(
        a.where("section_key = 'section_0'"), a.where("section_key IN ('section_1', 'section_2')"), a.where("section_key = 'section_3'")
    )
