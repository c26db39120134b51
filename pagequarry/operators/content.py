"""Page content jobs: titles, main block, text, dates, listing metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import dates as D
from pagequarry.functions import urls as U
from pagequarry.functions.text import (
    all_matches, bind, ci, clean_text, first_group, matches, squeeze, strip_scripts, thai_letters,
)
from pagequarry.operators.extract import is_useful_title


def _quoted(c: Column) -> Column:
    """Text as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("")), F.lit("\\E"))


# --- listing metadata --------------------------------------------------------------
def announcement_title(value: Column) -> Column:
    """Title without read counters, icons, leading labels and date tail."""

    def cleaned(text: Column) -> Column:
        for p in fv.READ_COUNTERS:
            text = F.regexp_replace(text, p, " ")
        text = F.regexp_replace(text, fv.TITLE_ICONS, " ")
        text = F.regexp_replace(text, r"^(?:ข่าว|ประกาศ)\s*[:：-]?\s*(?=เรื่อง\s*:)", "")
        return F.trim(F.regexp_replace(text, r"^เรื่อง\s*[:：-]?\s*", ""))

    labels = "|".join(fv.DATE_LABELS)

    def without_date(text: Column) -> Column:
        def cut(date: Column) -> Column:
            tail = F.concat(F.lit(rf"(?:(?:{labels})\s*:?\s*)?"), _quoted(date), F.lit(".*$"))
            return F.when(date != "", F.regexp_replace(text, tail, F.lit(" "))).otherwise(text)

        return bind(D.published_in_text(text), cut)

    out = bind(cleaned(squeeze(clean_text(value))), without_date)
    out = F.regexp_replace(out, r"\s*[-–—|:]\s*$", "")
    return squeeze(F.regexp_replace(out, fv.TITLE_BULLETS, ""))


def listing_metadata(links: DataFrame) -> DataFrame:
    """Add ``title`` and ``published_raw`` from link text and its context."""
    anchor, context = squeeze(clean_text(F.col("text"))), squeeze(clean_text(F.col("context_text")))
    own = announcement_title(anchor)
    title = bind(
        own,
        lambda t: F.when((F.length(t) < 4) | matches(t, fv.LISTING_DOWNLOAD_TITLE), announcement_title(context)).otherwise(t),
    )
    raw = F.coalesce(F.nullif(D.published_in_text(context), F.lit("")), D.published_in_text(anchor))
    return links.withColumn("title", title).withColumn("published_raw", raw)


def listing_by_detail(mentions: DataFrame) -> DataFrame:
    """Merge the mentions of a detail page on several listings.

    ``mentions``: ``canon, seq, listing_url, page_no, title, published_raw,
    context_text``.
    """
    dated = F.when(F.col("published_raw") != "", F.col("seq"))
    return mentions.groupBy("canon").agg(
        F.max_by("title", F.struct(F.length("title"), -F.col("seq"))).alias("title"),
        F.max_by("context_text", F.struct(F.length("context_text"), -F.col("seq"))).alias("context_text"),
        F.coalesce(F.max_by("published_raw", dated), F.lit("")).alias("published_raw"),
        F.max_by("listing_url", "seq").alias("listing_url"),
        F.max_by("page_no", "seq").alias("page_no"),
        F.count("*").alias("n_mentions"),
    )


def detail_with_listing(details: DataFrame, mentions: DataFrame) -> DataFrame:
    """Detail pages with their listing facts, defaults where unlisted."""
    listed = listing_by_detail(mentions)
    joined = details.join(listed, "canon", "left")
    return joined.fillna({"title": "", "context_text": "", "published_raw": "", "n_mentions": 0})


# --- dates ------------------------------------------------------------------------------
def published_dates(records: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Add ``published_raw``, ``published_on`` and ``published_at``."""
    found = D.published_in_text(squeeze(F.col(raw)))
    return records.withColumn("published_raw", found).select(
        "*", D.to_date(F.col("published_raw")).alias("published_on"), D.to_timestamp(F.col("published_raw")).alias("published_at")
    )


# --- titles -----------------------------------------------------------------------------
def detail_title(html: Column, u: Column, ident: Column, site_names: Sequence[str] = ()) -> Column:
    """First Thai candidate of ten pattern families, else first useful one.

    ``site_names``: names that end a site's titles and are no titles themselves.
    """
    names = "|".join(re.escape(n) for n in site_names)

    def candidate(raw: Column) -> Column:
        text = F.regexp_replace(clean_text(raw), ci(f"{fv.DETAIL_TITLE_TAIL}(?:{names}).*$"), "") if names else clean_text(raw)
        return F.trim(F.regexp_replace(text, r"^เรื่อง\s*:?\s*", ""))

    found = F.flatten(F.array(*[F.transform(all_matches(html, p, 1), candidate) for p in fv.DETAIL_TITLE_PATTERNS]))
    useful = F.filter(found, lambda t: is_useful_title(t, site_names))
    return bind(
        useful,
        lambda c: F.coalesce(
            F.get(F.filter(c, lambda t: t.rlike("[ก-๙]")), F.lit(0)), F.get(c, F.lit(0)),
            F.concat(F.lit("detail-"), F.coalesce(ident, F.lit(""))),
        ),
    )


def is_site_name(text: Column, host: Column) -> Column:
    """The text names the site rather than a section of it."""
    low = F.lower(text)
    words = F.filter(F.split(F.regexp_replace(host, "(?i)^www\\.", ""), "\\."), lambda w: F.length(w) >= 4)
    return (
        matches(low, fv.SITE_NAME_EXACT)
        | matches(low, fv.SITE_NAME_WORDS)
        | F.exists(words, lambda w: F.contains(low, F.lower(w)))
    )


def _first_good(candidates: Column, good) -> Column:
    return F.get(F.filter(candidates, good), F.lit(0))


def section_title(html: Column, u: Column) -> Column:
    """Heading, breadcrumb tail, title part, og:title or path, in order."""
    host = U.host(u)
    headings = F.filter(
        F.transform(all_matches(html, r"<h([12])\b[^>]*>[\s\S]*?</h\1>"),
                    lambda h: clean_text(h)),
        lambda t: F.length(t).between(3, 200),
    )
    heading = bind(headings, lambda hs: F.coalesce(_first_good(hs, lambda t: ~is_site_name(t, host)), F.get(hs, F.lit(0))))

    def not_root(t: Column) -> Column:
        return ~matches(t, fv.BREADCRUMB_ROOT) & (t != "")

    box = F.regexp_extract(html, ci(fv.BREADCRUMB_BOX), 1)
    crumb = bind(
        box,
        lambda b: F.coalesce(
            F.try_element_at(F.filter(F.transform(all_matches(b, r"<a\b[^>]*>([\s\S]*?)</a>", 1), clean_text), not_root), F.lit(-1)),
            F.try_element_at(F.filter(F.transform(F.split(clean_text(b), r"\s*(?:»|›|>)\s*"), F.trim), not_root), F.lit(-1)),
        ),
    )
    title_text = clean_text(F.regexp_extract(html, r"(?i)<title\b[^>]*>([\s\S]*?)</title>", 1))
    title_part = _first_good(
        F.transform(F.split(title_text, r"\s*(?:[|»>·]|::)\s*"), F.trim),
        lambda t: (F.length(t) >= 3) & ~is_site_name(t, host),
    )

    def without_site_suffix(t: Column) -> Column:
        suffix = F.regexp_extract(t, r"(\s*[-:]\s*[^-:]{2,})$", 1)
        return F.when(
            (suffix != "") & is_site_name(F.regexp_replace(suffix, r"^\s*[-:]\s*", ""), host),
            F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(suffix))),
        ).otherwise(t)

    og = F.trim(clean_text(F.coalesce(
        first_group(html, r"<meta\b[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)[\"']"),
        first_group(html, r"<meta\b[^>]*content=[\"']([^\"']+)[\"'][^>]*property=[\"']og:title[\"']"),
    )))
    name = U.decode_component(U.last_segment(u))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", ""), "[-_]+", " "))
    from_path = F.when((name != "") & ~matches(name, fv.GENERIC_PAGE_NAME), F.substring(name, 1, 120))
    candidates = F.array(heading, crumb, bind(title_part, without_site_suffix), og, from_path)
    chosen = _first_good(candidates, lambda t: F.length(t).between(3, 200) & ~is_site_name(t, host))
    return F.coalesce(F.substring(chosen, 1, 120), F.lit(""))


def crawl_title(html: Column) -> Column:
    return F.substring(clean_text(F.regexp_extract(html, r"(?i)<title\b[^>]*>([\s\S]*?)</title>", 1)), 1, 2000)


def title_fill(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Seed rows without a title take their page's title.

    ``titles``: ``page_url, page_title``, one row per URL.
    """
    filled = rows.join(titles, rows["url"] == titles["page_url"], "left")
    own = F.nullif(F.col("title"), F.lit(""))
    found = F.nullif(F.col("page_title"), F.lit(""))
    state = F.when(own.isNotNull(), "given").when(found.isNotNull(), "found").otherwise("missing")
    return filled.select(*[c for c in rows.columns if c != "title"], F.coalesce(own, found, F.lit("")).alias("title"), state.alias("state"))


# --- main block and text -----------------------------------------------------------------
def content_html(html: Column) -> Column:
    """Labelled cell, else the best-scoring content block, else ''."""
    labelled = [
        bind(F.regexp_extract(html, ci(p), 1), lambda b: F.when(clean_text(b) != "", F.trim(b))) for p in fv.CONTENT_LABELLED
    ]
    # no earlier place can hold the text of the first match
    area = bind(
        F.regexp_extract(html, ci(fv.CONTENT_AREA_START), 0),
        lambda start: F.when(start == "", html).otherwise(F.substring(html, F.position(start, html) + F.length(start), F.length(html))),
    )

    def scored(b: Column, i: Column, family: int) -> Column:
        return bind(
            clean_text(b),
            lambda t: F.struct(
                F.when((t == "") | t.rlike(ci(fv.CONTENT_EMPTY_TEXT)), F.lit(-1)).otherwise(F.length(t) + 2 * thai_letters(t)).alias("score"),
                F.lit(-family).alias("family"), (-i).alias("at"), F.trim(b).alias("html"),
            ),
        )

    def family_blocks(text: Column, n: int, p: str) -> Column:
        return F.transform(all_matches(text, p, 1), lambda b, i: scored(b, i, n))

    def best(text: Column) -> Column:
        blocks = F.flatten(F.array(*[family_blocks(text, n, p) for n, p in enumerate(fv.CONTENT_BLOCKS)]))
        return bind(F.array_max(blocks), lambda m: F.when(m["score"] >= 0, m["html"]))

    return F.coalesce(*labelled, bind(area, best), F.lit(""))


def tidy_fragment(block: Column) -> Column:
    """Content block without download boilerplate and extra line breaks."""
    gif = r"<img\b[^>]*\bsrc\s*=\s*(?:\"[^\"]*download\.gif[^\"]*\"|'[^']*download\.gif[^']*')[^>]*>"
    out = F.regexp_replace(block, ci(gif), " ")
    out = F.regexp_replace(out, rf"(?i)<a\b[^>]*>\s*{fv.CONTENT_MORE_TEXT}\s*</a>", " ")
    out = F.regexp_replace(out, fv.CONTENT_MORE_TEXT, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\r\n", "\n"), "\n{3,}", "\n\n"))


def _quiet(html: Column) -> Column:
    """A page without scripts, styles, menus, headers, footers, asides and forms."""
    return F.regexp_replace(
        strip_scripts(html), ci(r"<(?:nav|header|footer|aside|form)\b[\s\S]*?</(?:nav|header|footer|aside|form)>"), " "
    )


def page_body(html: Column) -> Column:
    """Text of a page's main part, else of its body, without menus, headers, footers, asides and forms."""

    def main(page: Column) -> Column:
        part = F.coalesce(
            first_group(page, r"<main\b[^>]*>([\s\S]*?)</main>"),
            first_group(page, r"<[^>]+\brole\s*=\s*[\"']main[\"'][^>]*>([\s\S]*?)</[^>]+>"),
            first_group(page, r"<body\b[^>]*>([\s\S]*?)</body>"),
            page,
        )
        return clean_text(part)

    return bind(_quiet(html), main)


def page_text(html: Column, block: Column, title: Column, limit: int | None = None, with_head: bool = False) -> Column:
    """Block text of 20+ characters, else the page body without furniture.

    ``limit``: characters kept (``fv.TEXT_LIMIT`` is usual); all if not given.
    ``with_head``: the text outside of the body, like the page's title, counts too.
    """

    def whole(page: Column) -> Column:
        text = clean_text(_quiet(page)) if with_head else page_body(page)
        return squeeze(_replace_first(text, F.trim(title)))

    text = bind(clean_text(block), lambda t: F.when(F.length(t) >= 20, t).otherwise(whole(html)))
    return text if limit is None else F.substring(text, 1, limit)


def _replace_first(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    rest = F.substring(text, at + F.length(part), F.length(text))
    return F.when((F.length(part) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), rest)).otherwise(text)


def declared_total(html: Column) -> Column:
    """'N items' counter of a listing page, 0 when there is none."""
    return bind(
        clean_text(html),
        lambda t: F.coalesce(
            *[F.replace(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("bigint") for p in fv.TOTAL_PATTERNS],
            F.lit(0).cast("bigint"),
        ),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Announcement record per detail page: title, block, text, date."""
    params = U.first_params(F.col("url"))
    out = pages.withColumn("detail_id", bind(params, lambda p: U.record_id(F.col("url"), p)))
    out = out.withColumn("detail_html", tidy_fragment(content_html(F.col("html"))))
    out = out.withColumn("title", announcement_title(detail_title(F.col("html"), F.col("url"), F.col("detail_id"))))
    return out.select(
        "page_id", "url", "detail_id", "title", "detail_html",
        page_text(F.col("html"), F.col("detail_html"), F.col("title")).alias("detail_text"),
        D.published_text(F.col("html")).alias("published_raw"),
    )


# --- album titles ---------------------------------------------------------------------------
def album_title_text(value: Column) -> Column:
    """Album title candidate without counters, dates and addresses."""
    text = clean_text(value)
    for pattern, replacement in fv.ALBUM_TITLE_CLEANUP:
        text = F.regexp_replace(text, ci(pattern), replacement)
    return squeeze(text)


def _is_album_boilerplate(value: Column, text: Column, site: Column) -> Column:
    acts = matches(text, fv.ALBUM_ACTION_WORDS)
    stop = F.array(*[F.lit(w) for w in fv.ALBUM_HOST_STOP])
    tokens = F.filter(F.split(site, "\\."), lambda t: ~F.array_contains(stop, t) & (F.length(t) >= 5))
    return (
        (text == "")
        | matches(value, fv.ALBUM_SITE_ADDRESS)
        | matches(text, fv.ALBUM_GENERIC_TITLE)
        | (matches(text, fv.ALBUM_ORGANISATION_TITLE) & ~acts)
        | (F.exists(tokens, lambda t: F.contains(F.lower(text), t)) & ~acts)
        | (matches(text, fv.ALBUM_ORGANISATION_START + r"\b") & matches(text, fv.ALBUM_AREA_WORDS) & ~acts)
    )


def album_title_score(value: Column, weight: Column, site: Column) -> Column:
    """Score of a cleaned candidate; below -1000 it cannot be a title."""
    w = fv.ALBUM_TITLE_SCORES

    def score(text: Column) -> Column:
        length = F.length(text)
        terms = [
            (text.rlike("[ก-๙]"), w["thai"]), (matches(text, fv.ALBUM_ACTION_WORDS), w["action"]),
            (_is_album_boilerplate(value, text, site), w["boilerplate"]),
            (matches(text, fv.ALBUM_GENERIC_TITLE), w["generic"]), (matches(text, fv.ALBUM_PLACEHOLDER), w["placeholder"]),
            (matches(text, fv.ALBUM_MENU_WORDS), w["menu"]),
        ]
        total = weight + F.least(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.lit(w["letters_cap"]))
        total = total + reduce(lambda a, b: a + b, [F.when(t, p).otherwise(0) for t, p in terms])
        total = total - F.when(length > w["long_from"], F.least(F.lit(w["long_cap"]), length - w["long_from"])).otherwise(0)
        return F.when(length < 4, F.lit(-10000)).otherwise(total)

    return bind(album_title_text(value), score)


def album_title_candidates(pages: DataFrame) -> DataFrame:
    """Weighted title pieces of album pages: ``page_id, site, ord, value, weight``."""
    html = F.col("html")

    def pieces(raw: Column) -> Column:
        parts = F.filter(F.split(raw, fv.ALBUM_TITLE_SPLIT), lambda p: (p != "") & (p != raw))
        return F.concat(F.array(raw), parts)

    found = [
        F.transform(pieces(F.regexp_extract(html, ci(p), 1)), _piece(n, w)) for n, (p, w) in enumerate(fv.ALBUM_TITLE_SOURCES)
    ]
    rows = pages.select("page_id", U.site(F.col("url")).alias("site"), F.explode(F.flatten(F.array(*found))).alias("c"))
    return rows.select("page_id", "site", "c.*").where("value <> ''")


def _piece(n: int, weight: int):
    return lambda v, i: F.struct((F.lit(n * 1000) + i).alias("ord"), v.alias("value"), F.lit(weight).alias("weight"))


def best_album_titles(candidates: DataFrame) -> DataFrame:
    """Best score, then longest title, per page."""
    clean = candidates.withColumn("title", album_title_text(F.col("value")))
    scored = clean.withColumn("score", album_title_score(F.col("title"), F.col("weight"), F.col("site")))
    kept = scored.where(F.col("score") > fv.ALBUM_TITLE_SCORES["discard"])
    best = F.struct(F.col("score"), F.length("title"), -F.col("ord"))
    return kept.groupBy("page_id").agg(F.max_by("title", best).alias("title"), F.max("score").alias("score"))


