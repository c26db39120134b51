"""Queries over links: URL forms, extraction, policy, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import media as M
from pagequarry.functions import urls as U
from pagequarry.functions.text import bind
from pagequarry.operators import classify as C
from pagequarry.operators import extract as X
from pagequarry.operators import policy as P
from pagequarry.plans import duck as D
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables

c = F.col


# --- URL forms --------------------------------------------------------------------------
@plan(f"""WITH {D.ALL_PAGES}, refs AS (
  SELECT {D.decode(D.unquote('m'))} AS ref FROM (
    SELECT unnest({D.extract_all('html', '(?:href|src)' + D.VALUE)}) AS m FROM all_pages))
SELECT coalesce(nullif(lower({D.extract('ref', '^([a-z][a-z0-9+.-]*):')}), ''), 'relative') AS scheme,
       {D.rx('ref', '^https?:/*[^/?#]')} AS is_http, count(*) AS n FROM refs GROUP BY ALL""")
def http_urls(t: Tables):
    """References per written scheme; only http(s) ones pass the filter."""
    return P.scheme_counts(P.raw_references(t.all_pages, ["href", "src"]))


@plan(f"""WITH {D.ALL_PAGES}, u AS (SELECT page_id, {D.canonical('url')} AS canon, {D.crawl_canonical('url')} AS crawl_url FROM all_pages)
SELECT canon, min(crawl_url) AS crawl_url, count(*) AS n_pages, min(page_id) AS first_page FROM u GROUP BY canon""")
def canonical_urls(t: Tables):
    """Pages per canonical address."""
    u = U.resolve(c("url"), c("url"))
    rows = t.all_pages.select("page_id", u.alias("u")).select("page_id", U.canonical(c("u")).alias("canon"), U.crawl_canonical(c("u")).alias("crawl_url"))
    return rows.groupBy("canon").agg(F.min("crawl_url").alias("crawl_url"), F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@plan(f"""WITH {D.HREFS}, k AS (SELECT page_id, {D.site('href')} || lower({D.path('href')}) || '?' || array_to_string(list_sort(
    list_filter({D.pairs('href')}, lambda kv: {D.key_of('kv')} IN {D.words(fv.CATEGORY_PARAMS)})), '&') AS category_key FROM hrefs WHERE href IS NOT NULL)
SELECT category_key, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM k WHERE NOT ends_with(category_key, '?') GROUP BY category_key""")
def url_params(t: Tables):
    """Links and pages per category key."""
    links = X.page_hrefs(t.all_pages).where(F.instr("href", "?") > 0)
    key = bind(U.category_map(U.first_params(c("href"))), lambda m: F.when(F.size(m) > 0, U.category_key(c("href"), m)))
    # (category, page) first, so the distinct count needs no expansion
    once = links.select("page_id", key.alias("category_key")).where("category_key IS NOT NULL").groupBy("category_key", "page_id").agg(F.count("*").alias("n"))
    return once.groupBy("category_key").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_pages"))


_LAST = D.extract(D.path("href"), r"([^/]*)/*$")
_TOKEN = f"url_decode({_LAST})"


@plan(f"""WITH {D.HREFS}, u AS (SELECT DISTINCT href FROM hrefs WHERE href IS NOT NULL), f AS (
  SELECT href, {D.pick('href', fv.RECORD_ID_PARAMS)} AS known, {D.pick('href', fv.ALBUM_ID_PARAMS)} AS album_known,
    CASE WHEN NOT {D.rx(_TOKEN, fv.GENERIC_LAST_SEGMENT)} AND NOT {D.rx(_TOKEN, fv.SCRIPT_FILE)} AND {D.rx(_TOKEN, fv.PATH_TOKEN)} THEN {_TOKEN} END AS tok,
    CASE WHEN lower({_TOKEN}) NOT IN {D.words(fv.ALBUM_RESERVED_SEGMENTS)} AND {D.rx(_TOKEN, '^[\\p{L}\\p{N}][\\p{L}\\p{N}_-]{0,180}$')} THEN {_TOKEN} END AS album_tok
  FROM u)
SELECT href, coalesce(known, tok) AS record_id, CASE WHEN known IS NOT NULL THEN 'param' WHEN tok IS NOT NULL THEN 'path' END AS id_source,
       coalesce(album_known, album_tok) AS album_id FROM f""")
def record_identity(t: Tables):
    """Record and album identity of every distinct link."""
    rows = X.page_hrefs(t.all_pages).select("href").distinct().withColumn("params", U.first_params(c("href")))
    source = U.record_id_source(c("href"), c("params"))
    return rows.select(
        "href", U.record_id(c("href"), c("params")).alias("record_id"),
        F.when(source == "path", "path").when(source.isNotNull(), "param").alias("id_source"),
        U.album_id(c("href"), c("params")).alias("album_id"),
    )


@plan(f"""WITH {D.HREFS}, u AS (SELECT coalesce({D.pick('href', fv.PAGE_PARAMS)}, nullif({D.extract(D.path('href'), fv.PAGE_PATH)}, ''), '1') AS page_no
  FROM hrefs WHERE href IS NOT NULL UNION ALL
  SELECT coalesce({D.pick('url', fv.PAGE_PARAMS)}, nullif({D.extract(D.path('url'), fv.PAGE_PATH)}, ''), '1') FROM all_pages)
SELECT page_no, count(*) AS n FROM u GROUP BY page_no""")
def page_numbers(t: Tables):
    """Listing page numbers named by links and page addresses."""
    links = X.page_hrefs(t.all_pages).select(c("href").alias("u")).unionByName(t.all_pages.select(c("url").alias("u")))
    number = U.page_number(c("u"), U.first_params(c("u")))
    return links.groupBy(number.alias("page_no")).agg(F.count("*").alias("n"))


def _references(t: Tables):
    return X.references(t.all_pages, ["href", "src"], keep_other_schemes=False, distinct=False)


_REFS = f"""{D.ALL_PAGES}, refs AS (SELECT page_id, url, {D.resolve(D.decode(D.unquote('m')), 'url')} AS href FROM (
    SELECT page_id, url, unnest({D.extract_all('html', '(?:href|src)' + D.VALUE)}) AS m FROM all_pages))"""
_KIND = f"""CASE WHEN {D.rx(D.site('href'), '^youtu[.]be$|youtube[.]com$')} THEN 'video_embed' WHEN {D.rx('href', fv.MEDIA_VIDEO_EXT)} THEN 'video'
  WHEN {D.rx('href', fv.MEDIA_AUDIO_EXT)} THEN 'audio' WHEN {D.rx('href', fv.MEDIA_IMAGE_EXT)} THEN 'image' WHEN {D.rx('href', fv.MEDIA_DOCUMENT_EXT)} THEN 'document' ELSE 'link' END"""


@plan(f"""WITH {_REFS}, k AS (SELECT {D.asset_class('href')} AS asset_class, {_KIND} AS media_type,
   CASE WHEN {D.rx(D.site('href'), '^youtu[.]be$|youtube[.]com$')} THEN 'youtube' END AS provider FROM refs WHERE href IS NOT NULL)
SELECT asset_class, media_type, provider, media_type IN ('video','audio','image','document') AS downloadable, count(*) AS n FROM k GROUP BY ALL""")
def asset_classes(t: Tables):
    """References per asset class, media type and player."""
    rows = _references(t).withColumn("provider", M.provider(c("href")))
    kind = M.media_kind(c("href"), F.lit(""), c("provider"))
    rows = rows.select(M.asset_class(c("href"), F.lit("")).alias("asset_class"), kind.alias("media_type"), "provider",
                       M.is_downloadable(c("href"), kind).alias("downloadable"))
    return rows.groupBy("asset_class", "media_type", "provider", "downloadable").agg(F.count("*").alias("n"))


@plan(f"""WITH {_REFS}, f AS (SELECT DISTINCT {D.site('url')} AS site, {D.crawl_canonical('href')} AS link,
    {D.site('href')} = {D.site('url')} AS internal, {D.asset_class('href')} AS kind FROM refs WHERE href IS NOT NULL)
SELECT site, count(*) FILTER (internal AND kind = 'other') AS internal_pages, count(*) FILTER (NOT internal) AS external_links,
       count(*) FILTER (kind = 'documents') AS files FROM f GROUP BY site""")
def same_site_links(t: Tables):
    """Internal pages, external links and files referenced per site."""
    return P.site_link_counts(_references(t))


# --- extraction -----------------------------------------------------------------------------
@plan(f"WITH {D.HREFS} SELECT page_id, url, href FROM hrefs WHERE href IS NOT NULL")
def page_hrefs(t: Tables):
    """Distinct resolved links of every page."""
    return X.page_hrefs(t.all_pages)


@plan(f"WITH {D.ALL_PAGES}, {D.anchors('all_pages')} SELECT page_id, pos, href, text FROM anchors WHERE href IS NOT NULL")
def page_anchors(t: Tables):
    """Closed anchors with text, in page order."""
    return X.page_anchors(t.all_pages).select("page_id", "pos", "href", "text")


@plan(f"""WITH {D.ALL_PAGES}, m AS (
  SELECT page_id, url, 'src' AS via, unnest({D.extract_all('html', 'src' + D.VALUE)}) AS m FROM all_pages UNION ALL
  SELECT page_id, url, 'object-data', unnest({D.extract_all('html', r'\bdata' + D.VALUE)}) FROM all_pages)
SELECT DISTINCT page_id, via, {D.resolve(D.decode(D.unquote('m')), 'url')} AS href FROM m""")
def page_sources(t: Tables):
    """Embedded sources of every page."""
    return X.page_sources(t.all_pages)


_SCRIPT_HIT = "'/news/view.php?id=77'"
_NAV = f"""{D.ALL_PAGES}, {D.anchors('all_pages')},
rows_m AS (SELECT page_id, url, unnest({D.extract_all('html', r'<tr[^>]*>[^$]*?</tr>')}) AS r FROM all_pages),
row_links AS (SELECT page_id, url, {D.clean('r')} AS text, unnest({D.extract_all('r', r'<a\b[^>]*href' + D.VALUE)}) AS m FROM rows_m),
clicks AS (SELECT page_id, url, unnest({D.extract_all('html', r"window[.]open\('([^']+)'", 1)}) AS ref FROM all_pages),
forms AS (SELECT page_id, url, unnest({D.extract_all('html', r'<form method="get" action="([^"]*)"', 1)}) AS action,
   {D.extract_all('html', r'<input name="([^"]*)" value="[^"]*"', 1)} AS ks, {D.extract_all('html', r'<input name="[^"]*" value="([^"]*)"', 1)} AS vs FROM all_pages),
mentions AS (
  SELECT page_id, url, href, text, 0 AS rank, 'href' AS via, pos FROM anchors WHERE href IS NOT NULL
  UNION ALL SELECT page_id, url, href, text, 1, 'href-loose', pos FROM anchors WHERE href IS NOT NULL
  UNION ALL SELECT page_id, url, {D.resolve(D.decode(D.unquote(D.extract('m', 'href' + D.VALUE, 0))), 'url')}, text, 2, 'table-row', 0 FROM row_links
  UNION ALL SELECT page_id, url, {D.resolve('ref', 'url')}, '', 4, 'onclick', 0 FROM clicks
  UNION ALL SELECT page_id, url, {D.resolve('ref', 'url')}, '', 5, 'javascript-string', 0 FROM clicks
  UNION ALL SELECT page_id, url, {D.resolve('action', 'url')} || '?' || array_to_string(list_transform(list_zip(ks, vs), lambda z: z[1] || '=' || z[2]), '&'), '', 7, 'form-get', 0 FROM forms),
keyed AS (SELECT *, {D.canonical('href')} AS canon FROM mentions WHERE href IS NOT NULL AND NOT {D.rx('href', '^mailto:')}),
nav AS (SELECT page_id, url, canon, arg_min(href, rank * 100000 + pos) AS href, arg_max(text, length(text) * 1000000 - rank * 100000 - pos) AS text,
  array_to_string(list_transform(list_sort(list(DISTINCT rank || ':' || via)), lambda v: v[3:]), '+') AS via FROM keyed GROUP BY ALL)"""
_IMG_TEXT = "CASE WHEN text = '' AND NOT contains(via, 'onclick') AND NOT contains(via, 'form') THEN 'attachment 2 ' || " + (
    "CASE WHEN contains(html, 'PASWORLD') THEN 'PASWORLD COMMUNICATION' ELSE 'site' END ELSE text END"
)


@plan(f"""WITH {_NAV} SELECT n.page_id, n.canon, n.via, {_IMG_TEXT} AS text FROM nav n JOIN all_pages p USING (page_id)""")
def navigation_links(t: Tables):
    """Links from all discovery channels with merged text and channels."""
    return X.navigation_links(t.all_pages).select("page_id", "canon", "via", "text")


@plan(f"""WITH {D.ALL_PAGES}, m AS (SELECT page_id, url, unnest({D.extract_all('html', r"window[.]open\('([^']+)'", 1)}) AS ref FROM all_pages)
SELECT DISTINCT page_id, {D.canonical(D.resolve('ref', 'url'))} AS canon, {D.resolve('ref', 'url')} AS href FROM m""")
def script_urls(t: Tables):
    """URLs named in script text."""
    return X.script_urls(t.all_pages)


@plan(f"""WITH {D.ALL_PAGES}, m AS (SELECT page_id, url, unnest({D.extract_all('html', r'\b(?:href|src|data-src|data-url|action)' + D.VALUE)}) AS m FROM all_pages)
SELECT page_id, href FROM (
  SELECT page_id, {D.ascii_only("CASE WHEN starts_with(v, '?') THEN regexp_replace(url, '[?#].*$', '') || v WHEN starts_with(v, '/') THEN " + D.origin('url') + " || v ELSE v END")} AS href
  FROM (SELECT page_id, url, {D.unquote('m')} AS v FROM m)
  UNION SELECT page_id, url FROM all_pages)""")
def fingerprint_urls(t: Tables):
    """Every URL a page mentions, its own included."""
    return X.fingerprint_urls(t.all_pages).select("page_id", "href")


_NOISE = " AND ".join(f"lower(text) <> {D.lit(n.lower())} AND NOT starts_with(lower(text), {D.lit(n.lower() + ' ')})" for n in fv.TITLE_NOISE)


@plan(f"""WITH {D.ALL_PAGES}, {D.anchors('all_pages')} SELECT page_id, pos, href, text FROM anchors WHERE href IS NOT NULL
  AND length(text) BETWEEN 5 AND 1000 AND NOT {D.rx('text', fv.NAV_TEXT)} AND length({D.sub('text', '[^\\p{L}\\p{N}]', '')}) >= 4 AND {_NOISE}""")
def useful_links(t: Tables):
    """Anchors whose text can name a record."""
    return X.useful_links(X.page_anchors(t.all_pages)).select("page_id", "pos", "href", "text")


# --- policy --------------------------------------------------------------------------------------
_HOSTS, _PARTS = ["youtube.com", "site3.example.org"], ["/gallery/"]


def _reason_sql() -> str:
    pre, post = fv.SKIP_HOST_REASON
    tests = [f"WHEN {D.rx('href', p)} THEN {D.lit(r)}" for _, k, p, r in fv.SKIP_RULES if k == "url_regex"]
    tests += [
        f"WHEN {D.site('href')} = {D.lit(h)} OR ends_with({D.site('href')}, {D.lit('.' + h)}) THEN {D.lit(pre + h + post)}"
        for h in ["info.go.th", *_HOSTS]
    ]
    tests += [f"WHEN contains(lower(href), {D.lit(p)}) THEN {D.lit(fv.SKIP_FRAGMENT_PREFIX + p)}" for p in _PARTS]
    return "CASE " + " ".join(tests) + " END"


@plan(f"""WITH {_REFS}, r AS (SELECT {_reason_sql()} AS skip_reason, href FROM refs WHERE href IS NOT NULL)
SELECT skip_reason, count(*) AS n, count(DISTINCT href) AS n_urls FROM r GROUP BY skip_reason""")
def skip_policy(t: Tables):
    """References per skip reason under configured hosts and fragments."""
    rows = P.skip_policy(_references(t), hosts=_HOSTS, fragments=_PARTS)
    once = rows.groupBy("skip_reason", "href").agg(F.count("*").alias("n"))
    return once.groupBy("skip_reason").agg(F.sum("n").alias("n"), F.count("*").alias("n_urls"))


@plan(f"""WITH {_REFS}, r AS (SELECT CASE WHEN {D.rx('href', fv.CRAWL_ASSET_EXT)} THEN 'asset' WHEN {D.rx('href', fv.BLOCKED_ROUTE)} THEN 'blocked_route'
   WHEN {D.rx(D.path('href'), fv.EXECUTABLE_EXT)} THEN 'executable' WHEN {D.rx('href', '[?&]download(=|&|#|$)')} THEN 'download' ELSE 'public' END AS scope FROM refs WHERE href IS NOT NULL)
SELECT scope, count(*) AS n FROM r GROUP BY scope""")
def public_pages(t: Tables):
    """References per page scope decision."""
    scope = F.coalesce(P.page_scope(c("href")), F.lit("public"))
    return _references(t).groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))


_BASE = D.extract(D.path("href"), r"([^/]*)/*$")


@plan(f"""WITH {_REFS}, d AS (SELECT DISTINCT href FROM refs WHERE {D.rx('href', fv.MEDIA_IMAGE_EXT)}), f AS (SELECT
   {D.rx('href', fv.MEDIA_NOISE)} AS is_noise,
   {D.rx(_BASE, fv.GALLERY_CONTROL_FILE)} OR {D.rx(_BASE, fv.GALLERY_CHROME_FILE)} AS is_control,
   {D.rx(D.path('href'), fv.GALLERY_TEMPLATE)} OR {D.rx(D.path('href'), fv.GALLERY_TEMPLATE_WORDS)} AS is_template,
   {D.rx(_BASE, fv.CONTENT_IMAGE_EXT)} AND NOT {D.rx(_BASE, fv.CONTENT_IMAGE_NOISE)} AND {D.rx(D.path('href'), fv.CONTENT_IMAGE_PATH)} AS is_content FROM d)
SELECT is_noise, is_control, is_template, is_content, count(*) AS n FROM f GROUP BY ALL""")
def ui_asset_filter(t: Tables):
    """Image references per combination of noise rules."""
    images = _references(t).where(c("href").rlike("(?i)" + fv.MEDIA_IMAGE_EXT)).select("href").distinct().withColumn("context", F.lit(""))
    flags = P.image_rules(images)
    return flags.groupBy("is_noise", "is_control", "is_template", "is_content").agg(F.count("*").alias("n"))


@plan(f"""WITH {_REFS}, d AS (SELECT DISTINCT href FROM refs WHERE href IS NOT NULL), f AS (SELECT href, ends_with({D.path('href')}, '/') AND {D.query('href')} = ''
   AND NOT {D.rx(D.path('href'), fv.ANY_EXT)} AS is_directory FROM d)
SELECT {D.site('href')} AS site, is_directory, count(*) AS n FROM f GROUP BY ALL""")
def directory_links(t: Tables):
    """Distinct links per site that are directories rather than files."""
    links = _references(t).select("href").distinct()
    return links.groupBy(U.site(c("href")).alias("site"), M.is_directory(c("href")).alias("is_directory")).agg(F.count("*").alias("n"))


@plan(f"""WITH {D.HREFS}, h AS (SELECT page_id, href, {D.pick('url', ['cid'])} AS want, {D.pick('href', ['cid'])} AS got FROM hrefs WHERE page_id < 0 AND href IS NOT NULL)
SELECT page_id, count(*) FILTER (coalesce(want = got, want IS NULL)) AS strict_matches, count(*) FILTER (coalesce(want = got, true)) AS loose_matches FROM h GROUP BY page_id""")
def category_filter(t: Tables):
    """Links per page that agree with the page's own category."""
    links = X.page_hrefs(t.html.selectExpr("-page_id - 1 AS page_id", "url", "html"))
    rows = links.select("page_id", U.first_params(c("href")).alias("params"), U.category_map(U.first_params(c("url"))).alias("cats"))
    return rows.groupBy("page_id").agg(
        F.count_if(P.category_matches(c("params"), c("cats"))).alias("strict_matches"),
        F.count_if(P.category_matches(c("params"), c("cats"), allow_missing=True)).alias("loose_matches"),
    )


_CONFIG = """config AS (SELECT s_suppkey AS config_id, x.ord AS ord, x.role AS role, x.value AS value FROM (
  SELECT s_suppkey, unnest([
    {'ord': 0, 'role': 'site', 'value': CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://www.s' || (s_suppkey % 7) || '.example.org/' END},
    {'ord': 1, 'role': 'procurementUrl', 'value': 'https://s' || (s_suppkey % 7) || '.example.org/news.php?cat_id=13'},
    {'ord': 2, 'role': 'publicRelationsUrl', 'value': 'https://s' || (s_nationkey % 7) || '.example.org/news.php?cat_id=1'},
    {'ord': 3, 'role': 'activityUrl', 'value': CASE WHEN s_suppkey % 4 = 0 THEN 'not a url' ELSE 'https://s' || (s_suppkey % 7) || '.example.org/albums/index.php' END}
  ]) AS x FROM supplier))"""


def config_view(t: Tables):
    """Section URLs configured per site owner, projected from suppliers."""
    key, nation = c("s_suppkey"), c("s_nationkey")

    def host(n):
        return F.concat(F.lit("s"), (n % 7).cast("string"), F.lit(".example.org"))

    def entry(ord_: int, role: str, value):
        return F.struct(F.lit(ord_).alias("ord"), F.lit(role).alias("role"), value.alias("value"))

    values = F.array(
        entry(0, "site", F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("https://www."), host(key), F.lit("/")))),
        entry(1, "procurementUrl", F.concat(F.lit("https://"), host(key), F.lit("/news.php?cat_id=13"))),
        entry(2, "publicRelationsUrl", F.concat(F.lit("https://"), host(nation), F.lit("/news.php?cat_id=1"))),
        entry(3, "activityUrl", F.when(key % 4 == 0, "not a url").otherwise(F.concat(F.lit("https://"), host(key), F.lit("/albums/index.php")))),
    )
    return t.table("supplier").select(key.alias("config_id"), F.inline(values))


_SCOPE = f"""{_CONFIG}, good AS (SELECT * FROM config WHERE {D.rx('value', '^https?://[^/]')}),
prim AS (SELECT config_id, arg_min(value, CASE WHEN role = 'site' THEN 0 ELSE 100 END + ord) AS primary_url FROM good GROUP BY config_id),
scope AS (SELECT g.config_id, g.value, min(g.ord) AS ord, any_value(p.primary_url) AS primary_url, any_value({D.site('g.value')} = {D.site('p.primary_url')}) AS accepted
  FROM good g JOIN prim p USING (config_id) GROUP BY g.config_id, g.value)"""


@plan(f"WITH {_SCOPE} SELECT config_id, value, ord, primary_url, accepted FROM scope")
def input_scope(t: Tables):
    """Configured URLs split by whether they belong to the primary site."""
    return P.input_scope(config_view(t))


# --- classification ---------------------------------------------------------------------------------
def seeds_view(t: Tables):
    """One seed per site and category of the constructed pages, named by its address."""
    vendor = F.when(c("p_size") % 10 == 3, "pasworld").otherwise("generic")
    seeds = t.table("part").select(
        F.concat(F.lit("https://www.site"), (c("p_size") % 10).cast("string"), F.lit(".example.org/news/?cid="), (c("p_size") % 5).cast("string")).alias("seed_url"),
        vendor.alias("vendor_id"),
    )
    return seeds.groupBy("seed_url").agg(F.min("vendor_id").alias("vendor_id")).withColumn("seed_id", c("seed_url"))


_SEEDS = """seeds AS (SELECT DISTINCT 'https://www.site' || (p_size % 10) || '.example.org/news/?cid=' || (p_size % 5) AS seed_url, seed_url AS seed_id,
  CASE WHEN p_size % 10 = 3 THEN 'pasworld' ELSE 'generic' END AS vendor_id, CAST(p_size % 5 AS VARCHAR) AS cid FROM part)"""


@plan(f"""WITH {D.ALL_PAGES} SELECT url AS seed_url, CASE WHEN {D.pick('url', ['cat_id'])} IS NOT NULL THEN 'legacy-cat_id' WHEN {D.pick('url', ['cid'])} IS NOT NULL THEN 'modern-cid'
  WHEN {D.pick('url', fv.CATEGORY_PARAMS)} IS NOT NULL THEN 'query-category' ELSE 'path' END AS mode, {D.rx(D.path('url'), '[.](php|aspx?)$')} AS script_path,
  CASE WHEN {D.rx(D.path('url'), '/albums?/index[.]php$')} THEN 'legacy-album' WHEN {D.rx(D.path('url'), '/gallery$|/gallery/')} THEN 'modern-gallery' ELSE 'generic-gallery' END AS album_mode
FROM all_pages""")
def seed_profiles(t: Tables):
    """Parsing mode of every page address used as a seed."""
    return C.seed_profiles(t.all_pages.select(c("url").alias("seed_url")))


_NAV_HTML = _NAV.replace("UNION ALL SELECT -page_id - 1, url, html FROM html_pages", "WHERE false UNION ALL SELECT -page_id - 1, url, html FROM html_pages")


@plan(f"""WITH {_NAV_HTML}, {_SEEDS}, j AS (SELECT s.seed_id, s.vendor_id, n.page_id, n.canon, n.via, s.cid,
     {D.pick('n.canon', ['cid'])} AS got, {D.pick('n.canon', ['id'])} AS rid, {D.pick('n.canon', ['page'])} AS pg, {D.path('n.canon')} AS p, {D.site('n.canon')} = {D.site('s.seed_url')} AS on_site,
     n.canon = {D.canonical('s.seed_url')} AS is_seed, {D.rx('n.canon', fv.LINK_ASSET_EXT)} OR {D.rx(D.path('n.canon'), fv.LINK_ASSET_PATH)} AS asset
   FROM nav n JOIN seeds s ON {D.site('n.url')} = {D.site('s.seed_url')}),
 k AS (SELECT seed_id, page_id, cid, canon, CASE WHEN asset OR NOT on_site OR is_seed THEN CASE WHEN is_seed THEN 'listing' ELSE 'other' END
    WHEN vendor_id = 'pasworld' AND rid IS NOT NULL THEN 'detail'
    WHEN coalesce(got, cid) <> cid THEN 'other' WHEN rid IS NOT NULL THEN 'detail'
    WHEN p = '/news/' AND pg IS NOT NULL THEN 'listing' ELSE 'other' END AS kind FROM j)
SELECT seed_id, page_id, kind, CASE WHEN kind = 'listing' AND NOT contains(canon, 'cid=') THEN canon || '?cid=' || cid ELSE canon END AS target FROM k GROUP BY ALL""")
def link_classes(t: Tables):
    """Detail and listing links per seed."""
    pages = t.html.selectExpr("-page_id - 1 AS page_id", "url", "html")
    links = X.navigation_links(pages, with_context=False)
    return C.classified_links(links, seeds_view(t)).select("seed_id", "page_id", "kind", "target")


@plan(f"""WITH {_REFS}, u AS (SELECT DISTINCT url, href FROM refs WHERE href IS NOT NULL)
SELECT url, href, CASE WHEN {D.site('href')} = {D.site('url')} THEN {D.origin('url')} || {D.extract('href', '^https?://[^/?#]*(.*)$')} ELSE href END AS aligned FROM u""")
def aligned_urls(t: Tables):
    """Same-site targets moved to the origin of their page."""
    return C.aligned_urls(_references(t).select("url", "href").distinct())
