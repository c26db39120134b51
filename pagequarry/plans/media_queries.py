"""Queries over media, assets, images, file bodies and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import extract as X
from pagequarry.operators import files as I
from pagequarry.operators import media as M
from pagequarry.plans import duck as D
from pagequarry.plans import views as V
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables

c = F.col
_SITE = "'https://www.site' || (p_size % 10) || '.example.org'"


# what each page shape of the view contains, file by file
_MEDIA = f"""m AS (
  SELECT p_partkey AS page_id, {_SITE} || '/files/doc' || (p_partkey % 50) || '.pdf' AS href, 'document' AS kind, NULL AS provider, 'a-href+javascript-string' AS discovered_via FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT p_partkey, {_SITE} || '/gallery/a/img_' || p_partkey || '.jpg', 'image', NULL, 'a-href+javascript-string' FROM part WHERE p_partkey % 6 = 1
  UNION ALL SELECT p_partkey, {_SITE} || '/gallery/a/thumb/t_img_' || p_partkey || '.jpg', 'image', NULL, 'img-src+javascript-string' FROM part WHERE p_partkey % 6 = 1
  UNION ALL SELECT p_partkey, {_SITE} || '/media/v' || p_size || '.mp4', 'video', NULL, 'javascript-string+source-src' FROM part WHERE p_partkey % 6 = 2
  UNION ALL SELECT p_partkey, 'https://www.youtube.com/embed/x' || p_size, 'video_embed', 'youtube', 'embedded-player+iframe-src' FROM part WHERE p_partkey % 6 = 3
  UNION ALL SELECT p_partkey, {_SITE} || '/img/page.png', 'image', NULL, 'css-url' FROM part WHERE p_partkey % 6 = 5
  UNION ALL SELECT p_partkey, 'https://other.example.net/x' || p_size || '.docx?utm_source=a#s', 'document', NULL, 'a-href+javascript-string' FROM part)"""


@plan(f"WITH {_MEDIA} SELECT page_id, href, kind, provider, kind <> 'video_embed' AS downloadable, discovered_via FROM m")
def media_candidates(t: Tables):
    """Typed media per page, one row per file."""
    return M.media_candidates(t.html).select("page_id", "href", "kind", "provider", "downloadable", "discovered_via")


@plan(f"""WITH {_MEDIA} SELECT page_id, href, kind, CASE WHEN kind = 'document' THEN 'a-href+href+javascript-string'
   ELSE discovered_via END AS discovered_via,
   CASE WHEN kind = 'document' AND contains(href, '/files/') THEN 'download' WHEN kind = 'document' THEN 'attachment' ELSE NULL END AS link_text FROM m WHERE kind <> 'image'""")
def attachments(t: Tables):
    """Attachment candidates per page."""
    found = M.attachments(t.html)
    return found.select("page_id", "href", "kind", "discovered_via", F.when(c("kind") == "document", c("link_text")).alias("link_text"))


@plan(f"""WITH {_MEDIA} SELECT page_id, regexp_replace(replace(href, 'utm_source=a', ''), '[?]?#s$', '') AS href,
   split_part(CASE WHEN contains(href, 'other') THEN 'a-href' WHEN contains(discovered_via, 'img-src') THEN 'img-src' WHEN contains(discovered_via, 'source-src') THEN 'source-src' ELSE discovered_via END, '+', 1) AS via,
   CASE WHEN kind = 'image' THEN 'images' WHEN kind = 'video' THEN 'videos' ELSE 'documents' END AS asset_class FROM m WHERE kind <> 'video_embed'
 UNION ALL SELECT p_partkey, {_SITE} || '/images/logo.png', 'html-attribute', 'images' FROM part WHERE p_partkey % 6 = 4""")
def page_assets(t: Tables):
    """Every asset of each page with its first channel."""
    return M.page_assets(t.html).select("page_id", "href", "via", "asset_class")


@plan(f"""SELECT p_partkey AS page_id, {_SITE} || '/gallery/a/img_' || p_partkey || '.jpg' AS href, 'href' AS via, 130 + CASE WHEN regexp_matches('/img_' || p_partkey || '.jpg', '/img[0-9_ -]{{3,}}[.]') THEN 65 ELSE 0 END AS score FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, {_SITE} || '/gallery/a/thumb/t_img_' || p_partkey || '.jpg', 'src', 95 FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, {_SITE} || '/media/v' || p_size || '.mp4', 'src', 50 FROM part WHERE p_partkey % 6 = 2""")
def gallery_images(t: Tables):
    """Album images with their evidence score."""
    return M.gallery_images(t.html).select("page_id", "href", "via", "score")


# stylesheets that import each other, one per part
CSS = """
SELECT concat('https://css.example.org/s', CAST(p_partkey AS VARCHAR(20)), '.css') AS url,
  concat('@import "s', CAST(p_partkey * 2 + 1 AS VARCHAR(20)), '.css"; @import url("/s', CAST(p_partkey * 2 + 2 AS VARCHAR(20)), '.css#a"); .a{background:url(/i/',
         CAST(p_size AS VARCHAR(20)), '.png)} .b{src:url(', chr(39), 'f.woff2?utm_source=x', chr(39), ')}') AS css, p_partkey AS page_id
FROM part
"""


@plan("""SELECT p_partkey AS page_id, x.via AS via, x.href AS href FROM (SELECT p_partkey, unnest([
  {'via': 'css-url', 'href': 'https://css.example.org/s' || (p_partkey * 2 + 2) || '.css'}, {'via': 'css-url', 'href': 'https://css.example.org/i/' || p_size || '.png'},
  {'via': 'css-url', 'href': 'https://css.example.org/f.woff2'}, {'via': 'css-import', 'href': 'https://css.example.org/s' || (p_partkey * 2 + 1) || '.css'},
  {'via': 'css-import', 'href': 'https://css.example.org/s' || (p_partkey * 2 + 2) || '.css'}]) AS x FROM part)""")
def css_urls(t: Tables):
    """Targets of url() and @import per stylesheet."""
    return X.css_urls(t.view(CSS, "part"))


@plan(f"""SELECT p_partkey AS page_id, {_SITE} || '/gallery/a/img_' || p_partkey || '.jpg' AS href, 'link' AS source FROM part WHERE p_partkey % 6 = 1""")
def page_images(t: Tables):
    """Representative image of each page that has one."""
    return M.page_images(t.html)


@plan("""WITH a AS (SELECT o_custkey AS page_id, CASE o_orderkey % 4 WHEN 0 THEN 'href' WHEN 1 THEN 'src' WHEN 2 THEN 'css-url' ELSE 'data-src' END AS via, o_orderkey AS ord,
  'f' || (o_orderkey % 5) AS file_key, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'text ' || o_orderkey END AS link_text FROM orders)
SELECT page_id, file_key, array_to_string(list_sort(list(DISTINCT via)), '+') AS discovered_via, coalesce(arg_min(link_text, ord) FILTER (link_text <> ''), '') AS link_text FROM a GROUP BY page_id, file_key""")
def via_merge(t: Tables):
    """Channels and first text merged per page and file."""
    via = F.element_at(F.array(*[F.lit(v) for v in ["href", "src", "css-url", "data-src"]]), (c("o_orderkey") % 4 + 1).cast("int"))
    rows = t.table("orders").select(
        c("o_custkey").alias("page_id"), F.lit(0).alias("rank"), c("o_orderkey").alias("at"), via.alias("via"),
        F.concat(F.lit("f"), (c("o_orderkey") % 5).cast("string")).alias("file_key"),
        F.when(c("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("text "), c("o_orderkey").cast("string"))).alias("link_text"),
    )
    return M.merge_mentions(rows, [], ["page_id", "file_key"]).drop("first_at")


@plan(f"""WITH a AS ({V.ALBUM}), i AS (SELECT album_id, pos, image_name AS name, row_number() OVER (PARTITION BY album_id ORDER BY pos) AS media_index FROM a WHERE pos % 3 <> 0),
n AS (SELECT album_id, count(*) AS n FROM i GROUP BY 1), m AS (SELECT album_id, pos, image_name AS name, row_number() OVER (PARTITION BY album_id ORDER BY pos) AS k FROM a WHERE pos % 3 = 0)
SELECT album_id, pos, name, media_index, 'image' AS kind FROM i UNION ALL SELECT m.album_id, m.pos, m.name, m.k + coalesce(n.n, 0), 'media' FROM m LEFT JOIN n USING (album_id)""")
def media_ordinals(t: Tables):
    """Image and media index per album."""
    rows = t.album.withColumnRenamed("image_name", "name")
    return M.media_ordinals(rows.where("pos % 3 <> 0"), rows.where("pos % 3 = 0"))


def _observed(t: Tables, event_type: str, via: str, force: bool):
    e = t.table("events").where(c("event_type") == event_type)
    ext = F.element_at(F.array(*[F.lit(x) for x in [".js", ".png", "", ".css"]]), (c("event_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ["script", "", "xhr", ""]]), (c("event_id") % 4 + 1).cast("int"))
    return e.select(
        c("user_id").alias("page_id"),
        F.concat(F.lit("https://r.example.org/x"), (c("event_id") % 30).cast("string"), ext, F.when(c("event_id") % 5 == 0, "#f").otherwise("")).alias("href"),
        F.lit(via).alias("via"), (F.lit(force) & (c("event_id") % 2 == 0)).alias("force"),
        F.when(c("event_id") % 7 == 0, "text/html; charset=utf-8").when(c("event_id") % 7 == 1, "image/png").otherwise("").alias("mime"),
        kind.alias("resource_type"), c("event_id").alias("ord"),
    )


_RES = """obs AS (SELECT user_id AS page_id, event_id AS ord, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS src,
  CASE event_type WHEN 'view' THEN 'html' WHEN 'click' THEN 'rendered-dom' ELSE 'browser-network' END AS via, event_type = 'view' AND event_id % 2 = 0 AS f0,
  'https://r.example.org/x' || (event_id % 30) || ['.js', '.png', '', '.css'][event_id % 4 + 1] || CASE WHEN event_id % 5 = 0 THEN '#f' ELSE '' END AS href,
  CASE event_id % 7 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'image/png' ELSE '' END AS mime, ['script', '', 'xhr', ''][event_id % 4 + 1] AS resource_type
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""


@plan(f"""WITH {_RES}, r AS (SELECT *, f0 OR resource_type = 'script' OR mime = 'image/png' AS force, split_part(href, '#', 1) AS file_key FROM obs)
SELECT page_id, file_key, arg_min(href, src * 100000000 + ord) AS href, arg_min(via, src * 100000000 + ord) AS via, bool_or(force) AS force,
  coalesce(arg_min(mime, src * 100000000 + ord) FILTER (mime <> ''), '') AS mime, coalesce(arg_min(resource_type, src * 100000000 + ord) FILTER (resource_type <> ''), '') AS resource_type
FROM r WHERE force OR regexp_matches(href, '[.](js|png|css)($|[?#])') GROUP BY page_id, file_key""")
def resource_union(t: Tables):
    """Page resources merged from HTML, rendered page and network."""
    return M.resource_union(_observed(t, "view", "html", True), _observed(t, "click", "rendered-dom", False), _observed(t, "purchase", "browser-network", False))


@plan("""WITH a AS (SELECT user_id AS page_id, event_id, 'https://c' || (event_id % 3) || '.example.net/p' || (event_id % 40) || '.js?x=' || (event_id % 2) AS href FROM events WHERE event_type = 'view'),
l AS (SELECT DISTINCT user_id AS page_id, 'https://c' || (event_id % 2) || '.example.net/p' || (event_id % 40) || '.js?x=1' AS href FROM events WHERE event_type = 'click')
SELECT page_id, event_id, href FROM a WHERE EXISTS (SELECT 1 FROM l WHERE l.page_id = a.page_id AND l.href = a.href)
  OR EXISTS (SELECT 1 FROM l WHERE l.page_id = a.page_id AND regexp_extract(l.href, '//[^/]*([^?]*)', 1) = regexp_extract(a.href, '//[^/]*([^?]*)', 1))""")
def loaded_assets(t: Tables):
    """External assets the browser loaded, by URL or path."""
    e = t.table("events")

    def href(hosts: int, x):
        return F.concat(F.lit("https://c"), (c("event_id") % hosts).cast("string"), F.lit(".example.net/p"), (c("event_id") % 40).cast("string"), F.lit(".js?x="), x).alias("href")

    assets = e.where("event_type = 'view'").select(c("user_id").alias("page_id"), "event_id", href(3, (c("event_id") % 2).cast("string")))
    loaded = e.where("event_type = 'click'").select(c("user_id").alias("page_id"), href(2, F.lit("1")))
    return M.loaded_assets(assets, loaded)


@plan(f"""WITH m AS ({V.HTML}), x AS (SELECT page_id, url, unnest(list_distinct({D.extract_all('html', '(?:href|src)' + D.VALUE)})) AS m FROM m),
u AS (SELECT page_id, url, {D.resolve(D.decode(D.unquote('m')), 'url')} AS href FROM x), l AS (SELECT DISTINCT page_id, {D.path('href')} AS p FROM u WHERE page_id % 2 = 0)
SELECT page_id, href, CASE WHEN {D.site('href')} = {D.site('url')} OR (u.page_id % 2 = 0) THEN 'keep' ELSE 'skipped_external' END AS decision FROM u""")
def external_policy(t: Tables):
    """External assets are kept only where the browser loaded them."""
    rows = X.page_hrefs(t.html).select("page_id", "url", "href").unionByName(
        X.page_sources(t.html).join(t.html.select("page_id", "url"), "page_id").select("page_id", "url", "href")
    ).distinct()
    return M.external_asset_policy(rows, rows.where("page_id % 2 = 0")).select("page_id", "href", "decision")


# --- bodies and names -----------------------------------------------------------------------------------
_SIG = """CASE p_partkey % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'ole' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'png' WHEN 5 THEN 'gif' WHEN 6 THEN 'unknown' WHEN 7 THEN 'mp4' ELSE 'unknown' END"""
_TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' ELSE '' END"


@plan(f"""WITH b AS (SELECT {_SIG} AS kind, {_TYPE} AS declared_type, p_partkey % 9 = 6 AS html_body FROM part)
SELECT kind, declared_type, CASE WHEN kind <> 'unknown' AND declared_type = 'text/html' THEN 'file_declared_html' WHEN kind = 'unknown' AND html_body AND declared_type <> 'text/html' THEN 'html_declared_file' ELSE 'consistent' END AS verdict, count(*) AS n
FROM b GROUP BY ALL""")
def file_signatures(t: Tables):
    """File kinds told from bytes against declared types."""
    return I.signature_report(t.bodies)


def declared_bodies(pages):
    """Whole pages as bytes of a declared charset; UTF-8 where the charset lacks a character of the page."""
    html, turn = c("html"), c("page_id") % 3
    thai = (turn == 1) & ~html.rlike(r"[^\x00-\x7F\xA0\x{0E01}-\x{0E3A}\x{0E3F}-\x{0E5B}\x{20AC}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2022}\x{2026}]")
    latin = (turn == 2) & ~html.rlike(r"[^\x00-\x7F\xA0-\xFF]")
    body = F.when(thai, F.encode(html, "windows-874")).when(latin, F.encode(html, "ISO-8859-1")).otherwise(F.encode(html, "UTF-8"))
    name = F.when(thai, "tis-620").when(latin, "iso-8859-1").otherwise("utf-8")
    return pages.select("page_id", body.alias("content"), F.concat(F.lit("text/html; charset="), name).alias("declared_type"))


@plan()
def decoded_bodies(t: Tables):
    """Page bodies decoded with the charset they name, Thai ones included."""
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    t.spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    out = I.decoded_bodies(declared_bodies(t.pages))
    return out.select("page_id", "charset", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


_EXT = "CASE kind WHEN 'pdf' THEN '.pdf' WHEN 'zip' THEN '.zip' WHEN 'jpeg' THEN '.jpg' WHEN 'png' THEN '.png' WHEN 'gif' THEN '.gif' WHEN 'mp4' THEN '.mp4' ELSE CASE declared_type WHEN 'application/pdf' THEN '.pdf' WHEN 'image/jpeg' THEN '.jpg' ELSE '' END END"
_NAMED = f"b AS (SELECT p_partkey AS seq, 'file_' || p_size AS file_name, p_brand AS directory, {_SIG} AS kind, {_TYPE} AS declared_type FROM part), named AS (SELECT seq, directory, file_name || {_EXT} AS asset_name FROM b)"


@plan(f"WITH {_NAMED} SELECT seq, directory, asset_name FROM named")
def asset_names(t: Tables):
    """Target name per body, extension added from bytes or MIME."""
    return I.asset_names(t.bodies).select("seq", "directory", "asset_name")


@plan(f"""WITH {_NAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY directory, asset_name ORDER BY seq) AS n FROM named)
SELECT seq, directory, asset_name, CASE WHEN n = 1 THEN asset_name ELSE regexp_replace(asset_name, '[.][^.]*$', '') || '-' || n || {D.extract('asset_name', '([.][^.]*)$')} END AS unique_name FROM r""")
def unique_names(t: Tables):
    """Collision-free names per directory."""
    return I.unique_names(I.asset_names(t.bodies).select("seq", "directory", "asset_name"))


@plan(r"""SELECT doc_id, sha256(regexp_replace(text, '[^\x09\x0A\x0D\x20-\x7E\x{0E01}-\x{0E5B}]', '', 'g')) AS text_sha256, regexp_matches(text, '[^\x09\x0A\x0D\x20-\x7E\x{0E01}-\x{0E5B}]') AS changed FROM documents""")
def charset_sanitize(t: Tables):
    """Documents reduced to ASCII and Thai characters."""
    out = I.sanitize_columns(t.table("documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "changed")


