"""Queries at site level: vendors, sections, menu labels, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import hosts as HO
from pagequarry.functions import urls as U
from pagequarry.operators import extract as X
from pagequarry.operators import policy as P
from pagequarry.operators import rules as RU
from pagequarry.operators import topics as K
from pagequarry.operators import vendors as Y
from pagequarry.plans import duck as D
from pagequarry.plans import views as V
from pagequarry.plans.link_queries import _SCOPE, config_view
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables

c = F.col

# pages of vendor-built sites: scripts of one vendor, mail of another, menus
MENU = """
SELECT p_partkey AS page_id, concat('http://www.town', CAST(p_size % 20 AS VARCHAR(20)), '.example.org/index.php') AS url,
  concat('<html><body><li><a href="/news.php?cat_id=', CAST(p_size % 9 AS VARCHAR(20)), '"><img src="m.gif" alt="', p_name, ' menu"></a></li>',
    '<script>menu.add("p1i0",[0,"', p_type, ' topic","","",-1,"/news.php?cat_id=', CAST(p_partkey % 9 AS VARCHAR(20)), '"],1)</script>',
    CASE p_size % 5 WHEN 0 THEN '<a href="/datacenter/procedure.php">procurement</a><a href="/album/index.php">album</a><p>CJ  World Communication</p>'
      WHEN 1 THEN '<a href="/albums/index.php">photo gallery</a><p>pasworld</p>'
      WHEN 2 THEN '<a href="/public/list/data/index/menu/144">information</a><p>staff@dungbhumi.com</p>'
      WHEN 3 THEN '<a href="/login.php?x=information">login information</a>' ELSE '' END,
    '</body></html>') AS html
FROM part
"""
_MENU = f"menu_pages AS ({MENU})"
# the same and sites that no vendor built
VENDOR_PAGES = f"""{MENU}UNION ALL
SELECT 1000000000 + p_partkey AS page_id, concat('http://www.town', CAST(100 + p_size % 5 AS VARCHAR(20)), '.example.org/index.html') AS url,
  concat('<html><body><p>', p_name, '</p></body></html>') AS html
FROM part
"""
_VENDOR_PAGES = f"menu_pages AS ({VENDOR_PAGES})"


def menu_view(t: Tables):
    return t.built_pages(MENU)


def _scores(pages):
    return Y.vendor_scores(Y.vendor_matches(pages), sites=pages.select(U.site(c("url")).alias("site")))


def _rule_sql() -> str:
    rows = []
    for n, (vendor, target, pattern, weight, label) in enumerate(fv.VENDOR_RULES):
        subject = "html" if target == "text" else "href"
        if target == "text":
            rows.append(
                f"SELECT DISTINCT {D.site('url')} AS site, {n} AS rule, {D.lit(vendor)} AS vendor_id, 'text' AS target, {weight} AS weight, {D.lit(label)} AS label "
                f"FROM menu_pages WHERE {D.rx(subject, pattern)} OR {D.rx(D.clean('html'), pattern)}"
            )
        else:
            rows.append(
                f"SELECT DISTINCT site, {n}, {D.lit(vendor)}, 'url', {weight}, {D.lit(label)} FROM menu_urls WHERE {D.rx('href', pattern)} OR {D.rx(D.host('href'), pattern)}"
            )
    return " UNION ALL ".join(rows)


_HITS = f"""{_VENDOR_PAGES}, menu_refs AS (SELECT page_id, url, unnest({D.extract_all('html', r'\b(?:href|src|data-src|data-url|action)' + D.VALUE)}) AS m FROM menu_pages),
menu_urls AS (SELECT {D.site('url')} AS site, {D.resolve(D.unquote('m'), 'url')} AS href FROM menu_refs UNION SELECT {D.site('url')}, url FROM menu_pages),
hits AS ({_rule_sql()})"""
_SCORES = f"""{_HITS}, vend AS (SELECT * FROM (VALUES {", ".join(f"({D.lit(v)}, {i})" for i, (v, _) in enumerate(fv.VENDORS))}) v(vendor_id, vendor_order)),
scores AS (SELECT s.site, v.vendor_id, v.vendor_order, CAST(coalesce(sum(h.weight), 0) AS BIGINT) AS score, count(h.rule) AS n_rules
 FROM (SELECT DISTINCT {D.site('url')} AS site FROM menu_pages) s CROSS JOIN vend v LEFT JOIN hits h ON h.site = s.site AND h.vendor_id = v.vendor_id GROUP BY ALL)"""
_RANKED = f"""{_SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, vendor_order) AS rank, lead(score, 1, 0) OVER (PARTITION BY site ORDER BY score DESC, vendor_order) AS next_score FROM scores)"""


@plan(f"WITH {_HITS} SELECT site, rule, vendor_id, target, weight, label FROM hits")
def vendor_matches(t: Tables):
    """Fingerprint rules that match each site."""
    return Y.vendor_matches(t.built_pages(VENDOR_PAGES)).select("site", "rule", "vendor_id", "target", "weight", "label")


@plan(f"WITH {_SCORES} SELECT site, vendor_id, score, n_rules FROM scores")
def vendor_scores(t: Tables):
    """Score and evidence size per site and vendor."""
    scores = _scores(t.built_pages(VENDOR_PAGES))
    return scores.select("site", "vendor_id", c("score").cast("bigint").alias("score"), F.coalesce(F.size("evidence"), F.lit(0)).cast("bigint").alias("n_rules"))


@plan(f"WITH {_RANKED} SELECT site, vendor_id, score, rank FROM ranked")
def vendor_ranking(t: Tables):
    """Vendor candidates of each site, best first."""
    return Y.vendor_ranking(_scores(t.built_pages(VENDOR_PAGES))).select("site", "vendor_id", "score", "rank")


_NAMES = "CASE vendor_id " + " ".join(f"WHEN {D.lit(v)} THEN {D.lit(n)}" for v, n in fv.VENDORS) + " END"


@plan(f"""WITH {_RANKED} SELECT site, CASE WHEN score >= 60 THEN vendor_id ELSE 'generic' END AS vendor_id, CASE WHEN score >= 60 THEN {_NAMES} ELSE {D.lit(fv.VENDOR_UNKNOWN[1])} END AS vendor_name,
  score, score - next_score AS margin, CASE WHEN score >= 60 THEN greatest(35, least(100, round(45 + least(35.0, score / 6.0) + least(20.0, (score - next_score) / 5.0)))) ELSE least(34, round(score / 2.0)) END AS confidence FROM ranked WHERE rank = 1""")
def vendor_winner(t: Tables):
    """Winning vendor per site with margin and confidence."""
    return Y.vendor_winner(_scores(t.built_pages(VENDOR_PAGES)))


def _section_sql() -> str:
    hay = "(lower(text) || ' ' || lower(href))"
    pattern, points = fv.SECTION_PENALTY
    parts = []
    for section in dict.fromkeys(s for s, _, _ in fv.SECTION_RULES):
        terms = " + ".join(f"CASE WHEN {D.rx(hay, p)} THEN {w} ELSE 0 END" for s, p, w in fv.SECTION_RULES if s == section)
        parts.append(
            f"SELECT {D.site('url')} AS site, '{section}' AS section, href, page_id, pos, {terms} + CASE WHEN {D.rx(hay, pattern)} THEN {points} ELSE 0 END AS score "
            f"FROM anchors WHERE {D.site('href')} = {D.site('url')}"
        )
    return " UNION ALL ".join(parts)


_SECTIONS = f"""{_MENU}, {D.anchors('menu_pages')}, sec AS ({_section_sql()}), best AS (SELECT site, section, href, score FROM sec WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY site, section ORDER BY score DESC, page_id, pos) = 1)"""


@plan(f"WITH {_SECTIONS} SELECT site, section, href, score FROM best")
def section_links(t: Tables):
    """Best link per site and section."""
    return Y.section_links(X.page_anchors(menu_view(t)))


_DEFAULTS = " ".join(
    f"WHEN w.vendor_id = {D.lit(v)} AND x.section = {D.lit(s)} THEN s.origin || {D.lit(p)}" for v, s, p in fv.VENDOR_SECTIONS
)
_SECTION_LIST = ", ".join(f"({D.lit(s)})" for s in dict.fromkeys(s for s, _, _ in fv.SECTION_RULES))


@plan(f"""WITH {_RANKED}, win AS (SELECT site, CASE WHEN score >= 60 THEN vendor_id ELSE 'generic' END AS vendor_id FROM ranked WHERE rank = 1),
{D.anchors('menu_pages')}, sec AS ({_section_sql()}), best AS (SELECT site, section, href FROM sec WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY site, section ORDER BY score DESC, page_id, pos) = 1),
sites AS (SELECT DISTINCT {D.site('url')} AS site, {D.origin('url')} AS origin, {D.extract('url', 'town([0-9]+)')} AS num FROM menu_pages),
j AS (SELECT s.site, x.section, CASE WHEN x.section = 'procurementUrl' AND CAST(s.num AS INT) % 4 = 0 THEN s.origin || '/own.php' END AS own, b.href, CASE {_DEFAULTS} END AS dflt
  FROM sites s CROSS JOIN (VALUES {_SECTION_LIST}) x(section) LEFT JOIN win w ON w.site = s.site LEFT JOIN best b ON b.site = s.site AND b.section = x.section)
SELECT site, section, coalesce(own, href, dflt, '') AS suggested, CASE WHEN own IS NOT NULL THEN 'configured' WHEN href IS NOT NULL THEN 'discovered' WHEN dflt IS NOT NULL THEN 'vendor-default' ELSE 'none' END AS source FROM j""")
def suggested_sections(t: Tables):
    """Section URL per site: configured, discovered or vendor default."""
    pages = t.built_pages(VENDOR_PAGES)
    sites = pages.select(U.site(c("url")).alias("site"), U.origin(c("url")).alias("origin")).distinct()
    number = F.regexp_extract("site", "town([0-9]+)", 1).cast("int")
    configured = sites.where(number % 4 == 0).select("site", F.lit("procurementUrl").alias("section"), F.concat("origin", F.lit("/own.php")).alias("value"))
    winners = Y.vendor_winner(_scores(pages))
    return Y.suggested_sections(sites, configured, Y.section_links(X.page_anchors(pages)), winners)


@plan(f"""WITH {_SCOPE}, cand AS (SELECT config_id, 0 AS grp, ord, {D.origin('value')} || '/' AS probe FROM scope WHERE accepted UNION ALL SELECT config_id, 1, ord, value FROM scope WHERE accepted),
f AS (SELECT config_id, probe, min(grp * 100 + ord) AS rk FROM cand GROUP BY ALL), r AS (SELECT config_id, row_number() OVER (PARTITION BY config_id ORDER BY rk) AS n, probe FROM f)
SELECT config_id, n, probe FROM r WHERE n <= 8""")
def probe_urls(t: Tables):
    """Addresses to probe per configured site."""
    return Y.probe_urls(P.input_scope(config_view(t)))


_LABELS = f"""{_MENU}, lab AS (
  SELECT page_id, 0 AS ord, {D.site('url')} || '/news.php?cat_id=' || {D.extract('html', 'href="/news.php[?]cat_id=([0-9]+)"><img')} AS category_key, {D.extract('html', 'alt="([^"]*)"')} AS label FROM menu_pages UNION ALL
  SELECT page_id, 1, {D.site('url')} || '/news.php?cat_id=' || {D.extract('html', ',"/news.php[?]cat_id=([0-9]+)"]')}, {D.extract('html', '[[]0,"([^"]*)"')} FROM menu_pages),
labels AS (SELECT page_id, category_key, arg_max(label, length(label) * 10 - ord) AS label FROM lab GROUP BY ALL)"""


@plan(f"WITH {_LABELS} SELECT page_id, category_key, label FROM labels")
def menu_labels(t: Tables):
    """Label per category from images and script menus."""
    return K.menu_labels(menu_view(t))


_TOPICS = f"""{_LABELS}, menu_topics AS (SELECT m.page_id, m.url, 'http://' || {D.host('m.url')} || '/news.php?cat_id=' || x.k AS topic_url, l.label AS title FROM
   (SELECT page_id, url, unnest(list_distinct([{D.extract('html', 'href="/news.php[?]cat_id=([0-9]+)"><img')}, {D.extract('html', ',"/news.php[?]cat_id=([0-9]+)"]')}])) AS k FROM menu_pages) x
   JOIN menu_pages m USING (page_id) JOIN labels l ON l.page_id = m.page_id AND l.category_key = {D.site('m.url')} || '/news.php?cat_id=' || x.k),
 crumb_topics AS (SELECT -p_partkey - 1 AS page_id, 'https://www.site' || (p_size % 10) || '.example.org/news/?cid=' || (p_size % 5) AS topic_url, p_type AS title FROM part),
 topics AS (SELECT page_id, topic_url, title FROM menu_topics UNION ALL SELECT page_id, topic_url, title FROM crumb_topics)"""


def _topics(t: Tables):
    built = t.html.selectExpr("-page_id - 1 AS page_id", "url", "html")
    pages = menu_view(t).unionByName(built)
    return K.category_links(X.navigation_links(pages, with_context=False), K.menu_labels(pages))


@plan(f"WITH {_TOPICS} SELECT page_id, topic_url, title FROM topics")
def topic_labels(t: Tables):
    """Category pages linked from each page with their best title."""
    return _topics(t).select("page_id", "topic_url", "title")


@plan(f"""WITH {_TOPICS} SELECT {D.site('topic_url')} AS site, topic_url, arg_max(title, CAST(length(title) AS BIGINT) * 1000000000 - page_id) AS title, count(*) AS n_pages FROM topics GROUP BY ALL""")
def topic_merge(t: Tables):
    """Topics merged over the pages of a site, longest title per URL."""
    return K.merge_topics(_topics(t))


_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '\\s+', '_', 'g'), '[^\\p{L}\\p{M}\\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@plan(f"""WITH src AS (SELECT p_partkey AS seq, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Topic_Registry' WHEN 2 THEN p_name || ' ' || repeat('รายงาน', 12) || p_partkey ELSE p_name || ' #' || (p_partkey % 40) END AS title,
   CASE WHEN p_partkey % 11 = 10 THEN '' WHEN p_partkey % 13 = 12 THEN 'ftp://x' ELSE 'https://www.s' || (p_size % 6) || '-a.example.org/news.php?cat_id=' || p_size END AS url FROM part),
c AS (SELECT *, CASE WHEN title <> '' THEN {_SLUG} WHEN url = '' THEN '' WHEN starts_with(url, 'ftp') THEN 'x' ELSE replace({D.extract('url', 'www[.](s[0-9]-a)')}, '-', '_') || '_cat_' || {D.extract('url', 'cat_id=([0-9]+)')} END AS clean FROM src WHERE title <> '' OR url <> ''),
n AS (SELECT *, CASE WHEN length(clean) > 64 THEN regexp_replace(substr(clean, 1, 59), '_+$', '') || '_' || substr(sha1(clean), 1, 4) ELSE clean END AS table_name FROM c),
e AS (SELECT *, CASE WHEN url = '' THEN 'missing_url' WHEN starts_with(url, 'ftp') THEN 'bad_url' WHEN table_name = '' THEN 'empty_name' WHEN lower(table_name) IN {D.words(fv.RESERVED_TABLES)} THEN 'reserved_name' END AS err FROM n)
SELECT seq, CASE WHEN err IN ('missing_url', 'bad_url') THEN NULL ELSE table_name END AS table_name, length(clean) > 64 AS truncated,
  coalesce(err, CASE WHEN row_number() OVER (PARTITION BY lower(table_name), err IS NULL ORDER BY seq) > 1 THEN 'duplicate_name' END) AS error FROM e""")
def topic_names(t: Tables):
    """Table key per topic with the reason a topic is refused."""
    key = c("p_partkey")
    title = (
        F.when(key % 7 == 0, "").when(key % 7 == 1, "Topic_Registry")
        .when(key % 7 == 2, F.concat("p_name", F.lit(" " + "รายงาน" * 12), key.cast("string")))
        .otherwise(F.concat("p_name", F.lit(" #"), (key % 40).cast("string")))
    )
    url = (
        F.when(key % 11 == 10, "").when(key % 13 == 12, "ftp://x")
        .otherwise(F.concat(F.lit("https://www.s"), (c("p_size") % 6).cast("string"), F.lit("-a.example.org/news.php?cat_id="), c("p_size").cast("string")))
    )
    named = K.topic_names(t.table("part").select(key.alias("seq"), title.alias("title"), url.alias("url")))
    usable = ~F.coalesce(c("error").isin("missing_url", "bad_url"), F.lit(False))
    return named.select("seq", F.when(usable, c("table_name")).alias("table_name"), "truncated", "error")




ADAPTERS = """
SELECT CASE n_nationkey % 5 WHEN 0 THEN ' PASWORLD ' WHEN 1 THEN 'cjworld' WHEN 2 THEN 'generic' WHEN 3 THEN 'dungbhumi' ELSE concat('own', CAST(n_nationkey AS VARCHAR(20))) END AS adapter_id,
       n_name AS adapter_name, CAST(n_regionkey AS VARCHAR(20)) AS news_mode FROM nation
"""


@plan(f"""WITH {_RANKED}, w AS (SELECT site, CASE WHEN score >= 60 THEN vendor_id ELSE 'none of these' END AS vendor_id FROM ranked WHERE rank = 1),
a AS (SELECT lower(trim(adapter_id)) AS adapter_id, min(adapter_name) AS adapter_name, arg_min(news_mode, adapter_name) AS news_mode FROM ({ADAPTERS}) GROUP BY 1)
SELECT w.site, w.vendor_id, coalesce(a.adapter_id, g.adapter_id) AS adapter_id, coalesce(a.adapter_name, g.adapter_name) AS adapter_name, coalesce(a.news_mode, g.news_mode) AS news_mode
FROM w LEFT JOIN a ON a.adapter_id = w.vendor_id JOIN a g ON g.adapter_id = 'generic'""")
def vendor_adapters(t: Tables):
    """Adapter and settings of each site's vendor, read from a table; unknown vendors get the generic one."""
    winners = Y.vendor_winner(_scores(t.built_pages(VENDOR_PAGES)))
    known = winners.select("site", F.when(c("vendor_id") == fv.VENDOR_UNKNOWN[0], "none of these").otherwise(c("vendor_id")).alias("vendor_id"))
    adapters = t.view(ADAPTERS, "nation").select("adapter_id", "adapter_name", F.create_map(F.lit("news_mode"), "news_mode").alias("settings"))
    return RU.with_adapters(known, adapters).select("site", "vendor_id", "adapter_id", "adapter_name", c("settings")["news_mode"].alias("news_mode"))


# hosts from suppliers, patterns from nations
RULES = """
SELECT s_suppkey AS rank, 'host' AS kind, CASE s_suppkey % 3 WHEN 0 THEN concat('https://www.h', CAST(s_suppkey % 12 AS VARCHAR(20)), '.Example.org/x') WHEN 1 THEN concat('h', CAST(s_suppkey % 11 AS VARCHAR(20)), '.example.org')
  ELSE concat('q', CAST(s_suppkey AS VARCHAR(20)), '.net') END AS pattern, CAST(NULL AS VARCHAR(20)) AS reason FROM supplier
UNION ALL SELECT n_nationkey, 'url_regex', concat('/', CAST(n_nationkey AS VARCHAR(20)), '-[0-9][.]docx'), concat('kept by ', n_name) FROM nation
UNION ALL SELECT n_nationkey, 'fragment', concat(CAST(10 + n_nationkey AS VARCHAR(20)), '-1.PDF'), CAST(NULL AS VARCHAR(20)) FROM nation
"""
_BARE = "regexp_replace(regexp_replace(regexp_replace(lower(pattern), '^https?://', ''), '[/:].*$', ''), '^www[.]', '')"


@plan(f"""WITH a AS ({V.AUDIT}), r AS ({RULES}), h AS (SELECT rank, {_BARE} AS host FROM r WHERE kind = 'host'), l AS (SELECT file_url AS href, count(*) AS n FROM a GROUP BY 1),
s AS (SELECT *, {D.site('href')} AS site FROM l)
SELECT href, n, coalesce((SELECT arg_min(reason, (rank, pattern)) FROM r WHERE kind = 'url_regex' AND regexp_matches(href, pattern, 'i')),
  (SELECT {D.lit(fv.SKIP_HOST_REASON[0])} || arg_min(host, (rank, host)) || {D.lit(fv.SKIP_HOST_REASON[1])} FROM h WHERE host = site OR ends_with(site, '.' || host)),
  (SELECT {D.lit(fv.SKIP_FRAGMENT_PREFIX)} || lower(arg_min(pattern, (rank, pattern))) FROM r WHERE kind = 'fragment' AND contains(lower(href), lower(pattern)))) AS skip_reason FROM s""")
def rule_table_skips(t: Tables):
    """References with their skip reason, by rules from a table."""
    rows = t.audit.groupBy(c("file_url").alias("href")).agg(F.count("*").alias("n"))
    return RU.table_skips(rows, t.view(RULES, "supplier", "nation"))


@plan()
def idn_hosts(t: Tables):
    """ASCII forms of host names in Thai script, made from the hosts of all pages."""
    thai = F.translate(U.host(c("url")), "aehinorst", "กขคงจฉชซ์")
    return t.pages.select("page_id", thai.alias("host"), HO.ascii_host(thai).alias("ascii_host"))
