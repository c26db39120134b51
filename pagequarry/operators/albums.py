"""Detail blocks and texts of album pages, cut between a page's landmarks.

A page's landmarks (the album's title, the first and last sign of its gallery,
the marker below it, what ends the content) are found once; areas between them
are candidates.  Everything is an expression over the page's row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions.text import bind, ci, clean_text, first_group, matches, strip_scripts, thai_letters
from pagequarry.operators.content import page_body

# Places count from 1; 0 is none.


def _first(text: Column, markers: list[str], start: Column | None = None) -> Column:
    """The first place of any of the markers, from ``start`` on."""
    start = F.lit(1) if start is None else start
    at = F.array(*[F.call_function("locate", F.lit(m), text, start) for m in markers])
    return F.coalesce(F.array_min(F.filter(at, lambda x: x > 0)), F.lit(0))


def _last(text: Column, markers: list[str]) -> Column:
    """The last place of any of the markers."""
    turned = F.reverse(text)
    places = [F.when(F.contains(text, F.lit(m)), F.length(text) - F.instr(turned, m[::-1]) - len(m) + 2).otherwise(0) for m in markers]
    return F.array_max(F.array(*places))


def _behind(text: Column, pattern: str) -> Column:
    """The place behind the first match."""
    found = F.regexp_substr(text, F.lit(ci(pattern)))
    return F.coalesce(F.instr(text, found) + F.length(found), F.lit(0))


def _between(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start, stop - start)


def trimmed(fragment: Column) -> Column:
    """A fragment without comments, scripts, styles, images and frames."""
    out = F.regexp_replace(fragment, r"^\s+|\s+$", "")
    for pattern in (r"<!--[\s\S]*?-->", r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"(?i)<(?:img|iframe)\b[\s\S]*?>", r"\s{2,}"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def _is_label_text(text: Column) -> Column:
    return bind(text, lambda t: (thai_letters(t) >= 5) & ~t.rlike(fv.ALBUM_NO_DETAIL))


def _is_full_text(text: Column) -> Column:
    return bind(text, lambda t: (thai_letters(t) >= 20) & (F.length(t) >= 80) & ~t.rlike(fv.ALBUM_NO_DETAIL))


def _is_trail(text: Column) -> Column:
    """Nothing but the way to the page."""
    steps = F.length(text) - F.length(F.replace(text, F.lit(">"), F.lit("")))
    sentences, size = text.rlike("[.!?ฯ]"), F.length(text)
    return (
        (thai_letters(text) < 10) | ((steps >= 2) & ~sentences & (size < 260)) | ((steps >= 1) & ~sentences & (size < 360))
        | (text.rlike(fv.ALBUM_TRAIL_WORDS) & (size < 360))
    )


def _score(fragment: Column, place: str) -> Column:
    w = fv.ALBUM_BLOCK_SCORES

    def score(text: Column) -> Column:
        points = thai_letters(text) + F.when(F.length(text) >= 30, w["long"]).otherwise(0) + F.when(text.rlike("[.!?ฯ]"), w["sentence"]).otherwise(0)
        points = points + w.get(place, w["else"]) - F.when(text.rlike(fv.ALBUM_DETAIL_NOISE), w["noise"]).otherwise(0)
        return F.when(text == "", 0).otherwise(points)

    return bind(clean_text(fragment), score)


def _best_of(candidates: list[tuple[str, Column]]) -> Column:
    """The fragment of the highest score, the earlier one of equals; empty ones do not take part."""
    scored = F.array(*[
        F.struct(_score(F.col(name), place).alias("score"), F.lit(-n).alias("n"), F.col(name).alias("fragment"))
        for n, (place, name) in enumerate(candidates)
    ])
    return F.coalesce(F.array_max(F.filter(scored, lambda s: s["fragment"] != ""))["fragment"], F.lit(""))


def _cleaned(text: Column, title: Column) -> Column:
    """A block's text without the album's name and the way to the page."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"\s*>\s*", " > "), r"\s+", " "))
    for pattern in (fv.ALBUM_TEXT_LEAD, fv.ALBUM_TEXT_TRAIL, fv.ALBUM_TEXT_STEPS):
        out = F.regexp_replace(out, ci(pattern), "")

    def unnamed(t: Column) -> Column:
        rest = F.substring(t, F.length(title) + 1, F.length(t))
        named = (title != "") & F.startswith(F.lower(t), F.lower(title)) & rest.rlike(r"^\s*>")
        return F.when(named, F.regexp_replace(rest, r"^\s*>\s*", "")).otherwise(t)

    return F.trim(F.regexp_replace(bind(out, unnamed), "<[^>]*$", ""))


def _page_text(html: Column, title: Column) -> Column:
    """The page's text without furniture; empty when hardly more than menus is left."""
    text = bind(page_body(html), lambda t: F.when((title != "") & (F.instr(t, title) > 0), F.concat(
        F.substring(t, F.lit(1), F.instr(t, title) - 1), F.lit(" "), F.substring(t, F.instr(t, title) + F.length(title), F.length(t))
    )).otherwise(t))
    for pattern in fv.ALBUM_PAGE_TRAILS:
        text = F.regexp_replace(text, pattern, " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return bind(text, lambda t: F.when((thai_letters(t) >= 12) & (F.length(t) >= 35), t).otherwise(""))


def album_details(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """page_id, album_block, album_text of album pages (``page_id, html, title``).

    The block is the page's marked detail, else the best area beside its
    gallery; the text is the block's, else the page's, and the block is empty
    then.  ``limit``: characters of text kept (``fv.TEXT_LIMIT`` is usual); a
    block keeps ``fv.ALBUM_BLOCK_LIMIT``.  A null page has neither.
    """
    c, html = F.col, F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", html.alias("html"), F.trim(F.coalesce("title", F.lit(""))).alias("title"))
    rows = rows.withColumns({
        "legacy": _first(c("html"), fv.ALBUM_LEGACY_GALLERY), "first": _first(c("html"), fv.ALBUM_GALLERY), "last": _last(c("html"), fv.ALBUM_GALLERY),
        "named": _behind(c("html"), fv.ALBUM_TITLE_BLOCK), "more": _behind(c("html"), fv.ALBUM_MORE_MARKER),
    })
    # marked details
    start = F.when(c("named") > 0, c("named")).otherwise(F.greatest(F.lit(1), c("legacy") - fv.ALBUM_REACH))
    above = F.when(c("legacy") > 0, _between(c("html"), start, c("legacy"))).otherwise("")
    stop = _first(c("html"), ["<iframe", "<form", "</body>"], c("more"))
    below = F.when(c("more") > 0, _between(c("html"), c("more"), F.when(stop > c("more"), stop).otherwise(F.length("html") + 1))).otherwise("")
    fragments = lambda area, pattern: F.transform(F.regexp_extract_all(area, F.lit(ci(pattern)), F.lit(1)), trimmed)

    def best_above(found: Column) -> Column:
        facts = F.transform(found, lambda f, i: F.struct(clean_text(f).alias("t"), (-i).alias("i"), f.alias("f")))
        good = F.filter(facts, lambda s: _is_label_text(s["t"]) & (thai_letters(s["t"]) >= 20) & (F.length(s["t"]) >= 60))
        return F.array_max(F.transform(good, lambda s: F.struct((thai_letters(s["t"]) + F.length(s["t"])).alias("n"), s["i"], s["f"])))["f"]

    empty = F.lit("")
    rows = rows.withColumns({
        "by_span": trimmed(F.coalesce(first_group(c("html"), fv.ALBUM_DETAIL_SPAN), empty)),
        "by_label": trimmed(F.coalesce(first_group(c("html"), fv.ALBUM_DETAIL_LABEL), empty)),
        "by_above": F.substring(F.coalesce(best_above(fragments(above, fv.ALBUM_ABOVE_DIV)), empty), 1, fv.ALBUM_BLOCK_LIMIT),
        "by_below": F.coalesce(F.get(F.filter(fragments(below, fv.ALBUM_BELOW_DIV), lambda f: _is_label_text(clean_text(f))), F.lit(0)), empty),
    })
    # areas beside the gallery
    ends = _first(c("html"), ["<!--attach files", "<iframe"], c("more"))
    foot = _first(c("html"), ["</table>", "</div>"], c("last"))
    tail = F.when(foot > c("last"), foot + 8).otherwise(c("last"))
    tail_end = _first(c("html"), fv.ALBUM_BELOW_ENDS, tail)
    middle = _first(c("html"), fv.ALBUM_MIDDLE_ENDS, c("more"))
    body = F.instr("html", "<body")
    open_end = F.when(body > 0, F.call_function("locate", F.lit(">"), c("html"), body) + 1).otherwise(0)
    close = _last(c("html"), ["</body>"])
    loose = F.when(c("first") > open_end, c("first")).otherwise(close)
    rows = rows.withColumns({
        "marked": F.when((c("more") > 0) & (ends > c("more")), F.trim(_between(c("html"), c("more"), ends))).otherwise(empty),
        "near_above": F.when((c("named") > 0) & (c("first") > c("named")), trimmed(_between(c("html"), c("named"), c("first")))).otherwise(empty),
        "near_below": F.when(c("last") > 0, trimmed(_between(c("html"), tail, F.when(tail_end > tail, tail_end).otherwise(F.length("html") + 1)))).otherwise(empty),
        "in_middle": F.when((c("more") > 0) & (middle > c("more")), trimmed(_between(c("html"), c("more"), middle))).otherwise(empty),
        "in_body": F.when((open_end > 0) & (close > open_end) & (loose > open_end), trimmed(_between(c("html"), open_end, loose))).otherwise(empty),
    })
    best = _best_of([("above", "near_above"), ("below", "near_below"), ("middle", "in_middle"), ("body", "in_body")])
    beside = F.when(_is_full_text(clean_text(c("near_below"))), c("near_below")).otherwise(best)
    sure = ["by_span", "by_label", "by_above", "by_below"]
    raw = F.coalesce(*[F.nullif(c(n), empty) for n in [*sure, "marked"]], F.substring(beside, 1, fv.ALBUM_BLOCK_LIMIT))
    rows = rows.withColumns({"raw": raw, "is_sure": reduce(lambda a, b: a | b, [c(n) != "" for n in sure])})
    text = _cleaned(clean_text(c("raw")), c("title"))
    rows = rows.withColumn("own_text", text if limit is None else F.substring(text, 1, limit))
    real = F.when(c("is_sure"), _is_label_text(clean_text(c("own_text")))).otherwise(_is_full_text(clean_text(c("own_text")))) & ~_is_trail(c("own_text"))
    page = _page_text(c("html"), c("title"))
    return rows.withColumn("real", real).select(
        "page_id", F.when(c("real"), c("raw")).otherwise(empty).alias("album_block"),
        F.when(c("real"), c("own_text")).otherwise(page if limit is None else F.substring(page, 1, limit)).alias("album_text"),
    )
