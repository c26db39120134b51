"""Media, attachment, asset and image jobs over page rows.

All extraction channels of a job are built as one array inside the page row
(channel rank, order, channel name, raw value, context, link text), exploded
once, resolved, classified, and merged per (page, file) with partial
aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import media as M
from pagequarry.functions import sqltext as S
from pagequarry.functions import tags as T
from pagequarry.functions import urls as U
from pagequarry.functions.text import bind, ci, clean_sql, clean_text, decode_sql, matches
from pagequarry.operators.extract import ANCHOR
from pagequarry.operators.ordinals import with_ordinal



def _cand(rank: int, at: str, via: str, raw: str, context: str = "''", text: str = "''") -> str:
    """SQL text of one mention; all arguments but ``rank`` are SQL text."""
    return (
        f"named_struct('rank', {rank}, 'at', cast({at} AS int), 'via', {via}, 'raw', {raw}, 'context', {context}, 'text', {text})"
    )


def _each(pattern: str, body: str, group: int = 0) -> str:
    """SQL text: ``body`` for every match ``m`` (ordinal ``i``) in the page."""
    return f"transform(regexp_extract_all(html, {S.quote(ci(pattern))}, {group}), (m, i) -> {body})"


def _named_attrs(rank: int, names: list[str], via: str, text: str = "''") -> str:
    """Mentions of the listed attributes of a tag ``g`` (g.tag, g.attrs)."""
    context = "concat(g.tag, ' ', g.attrs)"
    items = [
        _cand(rank, f"i * 100 + {n}", via.replace("NAME", name), T.attribute_sql("g.attrs", name), context, text)
        for n, name in enumerate(names)
    ]
    return f"array({', '.join(items)})"


def _srcset(rank: int, via: str) -> str:
    value = S.replace(S.extract("g.attrs", ci(r"\bsrcset\s*=\s*(\"[^\"]+\"|'[^']+')")), "^.|.$", "")
    item = _cand(rank, "i * 100 + 50 + k", via, S.extract("trim(w)", r"^(\S+)"), "concat(g.tag, ' ', g.attrs)")
    return f"transform(split({value}, ','), (w, k) -> {item})"


def _tag_parts(pattern: str, body: bool = False) -> str:
    first = ci("^" + pattern)
    parts = f"'tag', lower({S.extract('m', first, 1)}), 'attrs', {S.extract('m', first, 2)}"
    return f"named_struct({parts}{", 'body', " + S.extract('m', first, 3) if body else ''})"


def _paired_tags(rank: int) -> str:
    pattern = r"<(a|video|audio|iframe|object)\b([^>]*)>([\s\S]*?)</\1>"
    via = "concat(g.tag, '-NAME')"
    named = (
        f"if(g.tag = 'object', {_named_attrs(rank, fv.OBJECT_TAG_ATTRS, via, 'g.body')}, "
        f"{_named_attrs(rank, fv.PAIRED_TAG_ATTRS, via, 'g.body')})"
    )
    return f"flatten({_each(pattern, S.let(_tag_parts(pattern, True), 'g', named))})"


def _lone_tags(rank: int) -> str:
    pattern = r"<(source|embed|img|iframe|video|audio|object)\b([^>]*)>"
    both = f"concat({_named_attrs(rank, fv.LONE_TAG_ATTRS, "concat(g.tag, '-NAME')")}, {_srcset(rank, "concat(g.tag, '-srcset')")})"
    return f"flatten({_each(pattern, S.let(_tag_parts(pattern), 'g', both))})"


def _attributes(rank: int, names: list[str], via: str | None = None, context: bool = True, boundary: bool = True) -> str:
    pattern = (r"\b" if boundary else "") + f"(?:{'|'.join(names)}){T.VALUE}"
    name = S.quote(via) if via else f"lower({S.extract('m', r'^([^\s=]+)')})"
    return _each(pattern, _cand(rank, "i", name, T.unquote_sql("m"), "m" if context else "''"))


def _pattern(rank: int, via: str, pattern: str, group: int = 1) -> str:
    return _each(pattern, _cand(rank, "i", S.quote(via), S.extract("m", ci(pattern), group), "m"))


_CSS_URL = r"url\(\s*([\"']?)([^\"')]+)\1\s*\)"


def media_channels() -> list[str]:
    return [
        _paired_tags(0), _lone_tags(1), _attributes(2, fv.MEDIA_DATA_ATTRS),
        _pattern(3, "css-url", _CSS_URL, 2), _pattern(4, "javascript-string", fv.MEDIA_QUOTED),
        _pattern(5, "embedded-player", fv.MEDIA_PLAYER),
    ]


def _explode(pages: DataFrame, channels: list[str]) -> DataFrame:
    every = f"filter(flatten(array({', '.join(channels)})), x -> x.raw IS NOT NULL AND x.raw <> '')"
    return pages.selectExpr("page_id", "url", f"explode({every}) AS x").select("page_id", "url", "x.*")


_NO_LINK = r"(?i)^(?:javascript:|mailto:|tel:|#|data:|blob:)"


def _usable(refused: str) -> str:
    """SQL text: the cleaned reference of ``raw``, NULL for refused schemes."""
    return S.let(U.reference_sql("raw", unescape_slashes=True), "c", f"if(c = '' OR {S.rlike('c', refused)}, NULL, c)")


def _media_rows(pages: DataFrame) -> DataFrame:
    """Resolved, classified media mentions; links and noise dropped."""
    rows = _explode(pages, media_channels())
    rows = U.resolved(rows, _usable(_NO_LINK), "url", "href").drop("raw")
    u = F.col("href")
    rows = rows.where(~M.is_media_noise(u, F.col("context"))).withColumn("provider", M.provider(u))
    rows = rows.withColumn("kind", M.media_kind(u, F.concat_ws(" ", "via", "context"), F.col("provider")))
    label = F.when(F.col("text") != "", F.col("text")).otherwise(F.col("context"))
    return rows.where("kind <> 'link'").select(
        "page_id", "rank", "at", "via", "href", U.asset_key(u).alias("file_key"), "kind", "provider",
        M.is_downloadable(u, F.col("kind")).alias("downloadable"),
        F.substring(clean_text(label), 1, 1000).alias("link_text"),
    )


def merge_mentions(rows: DataFrame, keep: list[str], keys: list[str]) -> DataFrame:
    """One row per file: channels joined, first text, facts of the first mention."""
    order = F.struct("rank", "at")
    return rows.groupBy(*keys).agg(
        *[F.min_by(k, order).alias(k) for k in keep],
        F.array_join(F.array_sort(F.collect_set("via")), "+").alias("discovered_via"),
        F.coalesce(F.min_by("link_text", F.when(F.col("link_text") != "", order)), F.lit("")).alias("link_text"),
        F.min(order).alias("first_at"),
    )


def media_candidates(pages: DataFrame) -> DataFrame:
    """Typed media of each page, one row per file."""
    merged = merge_mentions(_media_rows(pages), ["href", "kind", "provider", "downloadable"], ["page_id", "file_key"])
    return merged.drop("first_at")


def attachments(pages: DataFrame) -> DataFrame:
    """Attachment candidates: known files and download-labelled links."""
    parts = [S.extract("m", ci(ANCHOR), g) for g in (1, 2, 3, 4)]
    anchors = _each(
        ANCHOR, _cand(0, "i", "'href'", f"concat({', '.join(parts[:3])})", text=clean_sql(parts[3]))
    )
    rows = _explode(pages, [
        anchors, _attributes(1, ["src"], "src", context=False, boundary=False), _attributes(2, ["data"], "object-data"),
        _attributes(3, fv.ATTACHMENT_DATA_ATTRS), _pattern(4, "javascript-string", fv.ATTACHMENT_QUOTED),
    ])
    rows = U.resolved(rows, decode_sql("raw"), "url", "href")
    u = F.col("href")
    kind = F.when(M.is_content_image(u), "image").when(M.is_document(u), "document")
    plain = rows.select(
        "page_id", "rank", "at", "via", "href", U.asset_key(u).alias("file_key"), kind.alias("known"),
        F.lit(None).cast("string").alias("provider"), F.lit(True).alias("downloadable"), F.trim("text").alias("link_text"),
    )
    labelled = (F.col("via") == "href") & matches(F.col("link_text"), fv.DOWNLOAD_LABEL)
    plain = plain.where(F.col("known").isNotNull() | labelled)
    media = _media_rows(pages).where("kind <> 'image'").withColumn("rank", F.col("rank") + 5)
    media = media.withColumnRenamed("kind", "known").select(*plain.columns)
    both = plain.unionByName(media).where(~M.is_directory(u)).withColumn("kind", F.coalesce("known", F.lit("document")))
    merged = merge_mentions(both, ["href", "kind", "provider", "downloadable"], ["page_id", "file_key"])
    return merged.drop("first_at")


def _labelled_anchors() -> str:
    """SQL text: closed anchors; those that offer a download are ``download-anchor``."""
    anchor = r"<a\b([^>]*)href\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>]+))([^>]*)>([\s\S]*?)</a>"
    g = [S.extract("m", ci(anchor), k) for k in range(1, 7)]
    facts = f"named_struct('href', concat({g[1]}, {g[2]}, {g[3]}), 'text', {clean_sql(g[5])}, 'attrs', concat_ws(' ', {g[0]}, {g[4]}))"
    signal = S.rlike("concat_ws(' ', f.attrs, f.text, f.href)", ci(fv.DOWNLOAD_SIGNAL))
    labelled = _cand(10, "i", f"if({signal}, 'download-anchor', 'anchor')", "f.href", text="f.text")
    return _each(anchor, S.let(facts, "f", labelled))


def page_assets(pages: DataFrame) -> DataFrame:
    """Every asset a page refers to; first channel wins, force is sticky."""
    item = _cand(12, "i * 100 + k", "'html-srcset'", S.extract("trim(w)", r"^(\S+)"))
    srcset = _each(
        r"\b(?:srcset|data-srcset)\s*=\s*(?:\"[^\"]+\"|'[^']+')", f"transform(split({T.unquote_sql('m')}, ','), (w, k) -> {item})"
    )
    rows = _explode(pages, [
        _labelled_anchors(), _attributes(11, fv.PAGE_ASSET_ATTRS, "html-attribute", context=False), f"flatten({srcset})",
        _pattern(13, "inline-css-url", r"url\(\s*[\"']?([^\"')]+)[\"']?\s*\)"),
        _pattern(14, "javascript-string", fv.ASSET_QUOTED),
    ])
    rows = U.resolved(rows, "trim(raw)", "url", "href")
    rows = rows.select(
        "page_id", "rank", "at", "via", U.crawl_canonical(F.col("href")).alias("href"),
        (F.col("via") == "download-anchor").alias("force"), F.col("text").alias("link_text"),
    ).where((F.col("href") != "") & (F.col("force") | matches(F.col("href"), fv.CRAWL_ASSET_EXT)))
    media = _media_rows(pages).where("kind <> 'video_embed'").select(
        "page_id", "rank", "at", "via", U.crawl_canonical(F.col("href")).alias("href"), F.lit(True).alias("force"), "link_text"
    )
    order = F.struct("rank", "at")
    return rows.unionByName(media).groupBy("page_id", U.asset_key(F.col("href")).alias("file_key")).agg(
        F.min_by("href", order).alias("href"), F.min_by("via", order).alias("via"), F.bool_or("force").alias("force"),
        M.asset_class(F.first("href"), F.lit("")).alias("asset_class"),
    )


def page_like_assets(pages: DataFrame) -> DataFrame:
    """(page_id, file_key) of the ``page_assets`` that have no asset's extension, so that they may pass as pages.

    What other channels find is an asset by its extension only.
    """
    rows = _explode(pages, [f"filter({_labelled_anchors()}, x -> x.via = 'download-anchor')"])
    rows = U.resolved(rows, "trim(raw)", "url", "href").select("page_id", "href")
    media = _media_rows(pages).where("kind <> 'video_embed'").select("page_id", "href")
    # a generator, so that the filter on a key does not repeat its making
    keys = rows.unionByName(media).select("page_id", F.explode(F.array(U.asset_key(U.crawl_canonical(F.col("href"))))).alias("file_key"))
    return keys.where((F.col("file_key") != "") & ~matches(F.col("file_key"), fv.CRAWL_ASSET_EXT)).distinct()


def gallery_images(pages: DataFrame) -> DataFrame:
    """Album images with their evidence score, best channel per image."""
    pattern = r"<(a|img|source|meta|picture|div|figure|li|button)\b([^>]*)>"
    named = (
        f"concat(if(g.tag = 'a', {_named_attrs(0, fv.GALLERY_ANCHOR_ATTRS, "'NAME'")}, "
        f"{_named_attrs(0, fv.GALLERY_TAG_ATTRS, "'NAME'")}), {_srcset(0, "'srcset'")})"
    )
    rows = _explode(pages, [
        f"flatten({_each(pattern, S.let(_tag_parts(pattern), 'g', named))})",
        _pattern(1, "css-url", _CSS_URL, 2),
        _pattern(2, "json", r"[\"'](?:src|image|photo|full|original|large|url)[\"']\s*:\s*[\"']([^\"']+)[\"']"),
        _pattern(3, "script", r"[\"']([^\"']+\.(?:jpe?g|png|gif|webp|bmp)(?:\?[^\"']*)?)[\"']"),
    ])
    rows = U.resolved(rows, _usable(r"(?i)^(?:javascript:|mailto:|tel:|#|data:)"), "url", "href")
    u, context, via = F.col("href"), F.col("context"), F.col("via")
    rows = rows.withColumn("p", F.lower(U.path(u)))
    evidence = matches(F.col("p"), fv.GALLERY_PATH) | matches(context, fv.GALLERY_CONTEXT) | matches(F.col("p"), fv.GALLERY_FILE_LIKE)
    image = F.concat("p", U.search(u)).rlike(ci(fv.GALLERY_IMAGE_EXT))
    rows = rows.where(~M.is_gallery_control(u) & (evidence | ((via == "href") & image & ~M.is_template_asset(u, context))))
    album = bind(U.first_params(F.col("url")), lambda ps: U.album_id(F.col("url"), ps))
    marker = F.lower(F.concat(F.lit("/photoThumbnail/albums/a"), album, F.lit("_a/")))
    legacy = F.contains(F.lower(u), marker) & ~F.contains(F.lower(u), F.lit("/thumb/"))
    scored = rows.withColumn("score", M.gallery_score(u, context, via)).where(F.col("score") >= fv.GALLERY_SCORES["keep_from"])
    scored = scored.withColumn("bonus", F.when(legacy, fv.GALLERY_SCORES["legacy_marker"]).otherwise(0))
    best = F.struct(F.col("score"), -F.col("rank"), -F.col("at"))
    return scored.groupBy("page_id", U.canonical(u).alias("canon")).agg(
        F.max_by("href", best).alias("href"), F.max_by("via", best).alias("via"),
        (F.max("score") + F.max("bonus")).alias("score"),
    )


def page_images(pages: DataFrame) -> DataFrame:
    """Representative image: declared, full-size link, or largest picture."""
    wanted = S.rlike("m", r"(?i)\b(?:property|name|itemprop|rel)\s*=\s*[\"']?(?:og:image|og:image:url|image|image_src)[\"'\s/>]")
    declared = f"coalesce({T.attribute_sql('m', 'content')}, {T.attribute_sql('m', 'href')})"

    def size(tag: str, name: str) -> str:
        return f"coalesce(try_cast({S.extract(tag, ci(rf"""\b{name}\s*=\s*["']?([0-9]+)"""))} AS bigint), 0)"

    start, inner = S.extract("m", r"^(<[^>]*>)"), S.extract("m", ci(r"(<img\b[^>]*>)"))
    source = "coalesce(" + ", ".join(T.attribute_sql("m", n) for n in ["src", "data-src", "data-original"]) + ")"
    picture = f"if(z.w >= {fv.PAGE_IMAGE_MIN[0]} AND z.h >= {fv.PAGE_IMAGE_MIN[1]}, {source}, NULL)"
    sized = f"named_struct('w', {size('m', 'width')}, 'h', {size('m', 'height')})"
    rows = _explode(pages, [
        _each(r"<(?:meta|link)\b[^>]*>", _cand(0, "i", "'declared'", f"if({wanted}, {declared}, NULL)")),
        _each(r"<a\b[^>]*>[\s\S]*?</a>", _cand(1, "i", "'link'", T.attribute_sql(start, "href"), f"cast({size(inner, 'width')} AS string)")),
        _each(r"<img\b[^>]*>", S.let(sized, "z", _cand(2, "i", "'picture'", picture, "cast(z.w * z.h AS string)"))),
    ])
    rows = U.resolved(rows, decode_sql("raw"), "url", "href")
    u = F.col("href")
    rows = rows.where(u.rlike(r"(?i)\.(?:jpe?g|png|gif|webp|bmp)(?:[?#]|$)") & ~matches(u, fv.PAGE_IMAGE_NOISE))
    rows = rows.where(~((F.col("rank") == 1) & matches(u, fv.PAGE_IMAGE_THUMB)))
    weight = F.coalesce(F.col("context").try_cast("bigint"), F.lit(0))
    order = F.struct(F.col("rank"), F.when(F.col("rank") > 0, -weight).otherwise(0), F.col("at"))
    return rows.groupBy("page_id").agg(F.min_by("href", order).alias("href"), F.min_by("via", order).alias("source"))


def media_ordinals(images: DataFrame, media: DataFrame) -> DataFrame:
    """Image index per album; other media continue after the images.

    Both: ``album_id, pos, name``.
    """
    first = with_ordinal(images, ["album_id"], "pos", "media_index")
    later = with_ordinal(media, ["album_id"], "pos", "_n")
    totals = images.groupBy("album_id").agg(F.count("*").alias("_images"))
    later = later.join(totals, "album_id", "left").withColumn("media_index", F.col("_n") + F.coalesce("_images", F.lit(0)))
    return first.withColumn("kind", F.lit("image")).unionByName(
        later.select(*media.columns, "media_index").withColumn("kind", F.lit("media"))
    )


def resource_union(html_assets: DataFrame, rendered: DataFrame, network: DataFrame) -> DataFrame:
    """Page resources from three observers: sticky force, first known types.

    All: ``page_id, href, via, force, mime, resource_type, ord``.
    """
    network_force = F.col("resource_type").isin("image", "media", "font", "stylesheet", "script") | (
        (F.col("mime") != "") & ~F.col("mime").rlike("(?i)^(?:text/html|application/xhtml\\+xml)")
    )
    rows = (
        html_assets.withColumn("src", F.lit(0))
        .unionByName(rendered.withColumn("src", F.lit(1)))
        .unionByName(network.withColumn("src", F.lit(2)))
        .withColumn("force", F.col("force") | network_force)
    )
    rows = rows.where(F.col("force") | matches(F.col("href"), fv.CRAWL_ASSET_EXT))
    order = F.struct("src", "ord")

    def first_known(name: str):
        return F.coalesce(F.min_by(name, F.when(F.col(name) != "", order)), F.lit("")).alias(name)

    return rows.groupBy("page_id", U.asset_key(F.col("href")).alias("file_key")).agg(
        F.min_by("href", order).alias("href"), F.min_by("via", order).alias("via"), F.bool_or("force").alias("force"),
        first_known("mime"), first_known("resource_type"),
    )


def loaded_assets(assets: DataFrame, loaded: DataFrame) -> DataFrame:
    """Assets the browser really loaded: same URL, or same path, on the page.

    Two semi joins instead of one OR condition, so both stay equi joins.
    """
    keyed = assets.withColumn("_url", U.crawl_canonical(F.col("href"))).withColumn("_path", U.path(F.col("href")))
    seen = loaded.select("page_id", U.crawl_canonical(F.col("href")).alias("_url"), U.path(F.col("href")).alias("_path"))
    by_url = keyed.join(seen.select("page_id", "_url").distinct(), ["page_id", "_url"], "left_semi")
    rest = keyed.join(seen.select("page_id", "_url").distinct(), ["page_id", "_url"], "left_anti")
    by_path = rest.join(seen.select("page_id", "_path").distinct(), ["page_id", "_path"], "left_semi")
    return by_url.unionByName(by_path).select(*assets.columns)


def external_asset_policy(assets: DataFrame, loaded: DataFrame, include_external: bool = True) -> DataFrame:
    """Same-site assets stay; external ones only when loaded and allowed."""
    external = U.site(F.col("href")) != U.site(F.col("url"))
    inside = assets.where(~external).withColumn("decision", F.lit("keep"))
    outside = assets.where(external)
    kept = loaded_assets(outside, loaded).select("page_id", "href").distinct().withColumn("_loaded", F.lit(True))
    judged = outside.join(kept, ["page_id", "href"], "left").withColumn(
        "decision", F.when(F.col("_loaded") & F.lit(include_external), "keep").otherwise("skipped_external")
    )
    return inside.unionByName(judged.select(*inside.columns))
