"""Extraction jobs: page rows to link, source and script URL rows.

Every job reads ``page_id, url, html``, explodes regular-expression matches
inside the page row, drops ``html`` right there, and only then resolves,
merges or shuffles the narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import sqltext as S
from pagequarry.functions import tags as T
from pagequarry.functions import urls as U
from pagequarry.functions.text import all_matches, bind, ci, clean_sql, clean_text, decode_sql, html_decode, letters, squeeze

ANCHOR = r"<a\b[^>]*href\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>]+))[^>]*>([\s\S]*?)</a>"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def explode_matches(pages: DataFrame, matches: Column, *keep: str) -> DataFrame:
    """One row per match: ``page_id, url, pos, m`` (plus ``keep``)."""
    return pages.select("page_id", "url", *keep, F.posexplode(matches).alias("pos", "m"))


def tagged(values: Column, via: str, name: str) -> Column:
    """array<struct<via, name>>: each value with its discovery channel."""
    return F.transform(values, lambda v: F.struct(F.lit(via).alias("via"), v.alias(name)))


def _matches_sql(pattern: str) -> str:
    return f"regexp_extract_all(html, {S.quote(ci(pattern))}, 0)"


def references(pages: DataFrame, names: list[str], keep_other_schemes: bool = True, distinct: bool = True, boundary: bool = False,
               decode: bool = True) -> DataFrame:
    """Resolved values of the listed attributes, one row each.

    Resolution and the per-page distinct both happen inside the page row, so
    no shuffle is needed (a page is one row).
    """
    found = _matches_sql((r"\b" if boundary else "") + f"(?:{'|'.join(names)}){T.VALUE}")
    ref = decode_sql(T.unquote_sql("m")) if decode else T.unquote_sql("m")
    value = U.resolve_sql(ref, "url", keep_other_schemes)
    links = f"filter(transform({f'array_distinct({found})' if distinct else found}, m -> {value}), h -> h IS NOT NULL)"
    return pages.selectExpr("page_id", "url", f"explode({f'array_distinct({links})' if distinct else links}) AS href")


def page_hrefs(pages: DataFrame) -> DataFrame:
    """Distinct resolved href values per page."""
    return references(pages, ["href"])


def page_anchors(pages: DataFrame) -> DataFrame:
    """Closed anchors with their text, duplicates kept, in page order."""
    g = [S.extract("m", ci(ANCHOR), k) for k in (1, 2, 3, 4)]
    href = U.resolve_sql(decode_sql(f"concat({g[0]}, {g[1]}, {g[2]})"), "url", True)
    item = f"named_struct('pos', i, 'href', {href}, 'text', {clean_sql(g[3])})"
    every = f"filter(transform({_matches_sql(ANCHOR)}, (m, i) -> {item}), a -> a.href IS NOT NULL)"
    return pages.selectExpr("page_id", "url", f"explode({every}) AS a").select("page_id", "url", "a.*")


def page_sources(pages: DataFrame) -> DataFrame:
    """Distinct resolved src and object data URLs per page and channel."""
    src = references(pages, ["src"]).select("page_id", F.lit("src").alias("via"), "href")
    data = references(pages, ["data"], boundary=True).select("page_id", F.lit("object-data").alias("via"), "href")
    return src.unionByName(data)


_SCRIPT_NEEDS = {4: r"\.php\?[^'\"]", 5: r"[?&](?:news_?id|id|nid|detail_?id|item_?id)="}
# texts of which a family's match holds one, in lower case
_SCRIPT_WORDS = [
    ["location"], ["open"], ["location."], ["openbrwindow", "popup", "openwin", "shownews", "viewnews"], [".php?"], ["id="],
]


def script_matches(source: Column) -> Column:
    """array<struct<family, at, raw>> of URLs named in script text."""

    def family(n: int, pattern: str) -> str:
        found = f"regexp_extract_all(t, {S.quote(ci(pattern))}, 1)"
        if n in _SCRIPT_NEEDS:
            # the long quoted-text patterns only run where they can succeed
            found = f"if({S.rlike('t', ci(_SCRIPT_NEEDS[n]))}, {found}, cast(array() AS array<string>))"
        words = " OR ".join(f"contains(low, {S.quote(w)})" for w in _SCRIPT_WORDS[n])
        found = f"if({words}, {found}, cast(array() AS array<string>))"
        return f"transform({found}, (m, i) -> named_struct('family', {n}, 'at', i, 'raw', m))"

    families = ", ".join(family(n, p) for n, p in enumerate(fv.SCRIPT_URLS))
    every = S.let("lower(t)", "low", f"flatten(array({families}))")
    return S.apply(S.let(decode_sql("v"), "t", every), source)


def resolve_links(rows: DataFrame) -> DataFrame:
    """Resolve ``raw`` against ``url``, keep http links, add their page key.

    Both come out of generators, so filters on them do not repeat their work.
    """
    ref = S.let(U.reference_sql("raw"), "c", f"if(c = '' OR {S.rlike('c', '(?i)^(?:javascript:|mailto:|tel:|#)')}, NULL, c)")
    return U.resolved(rows, ref, "url", "href").withColumn("canon", F.explode(F.array(U.canonical(F.col("href")))))


def script_urls(pages: DataFrame) -> DataFrame:
    """URLs found in script text, first mention per page key."""
    rows = pages.select("page_id", "url", F.explode(script_matches(F.col("html"))).alias("x"))
    rows = resolve_links(rows.select("page_id", "url", "x.family", "x.at", "x.raw"))
    return rows.groupBy("page_id", "canon").agg(F.min_by("href", F.struct("family", "at")).alias("href"))


def fingerprint_urls(pages: DataFrame) -> DataFrame:
    """``page_id, url, href``: distinct URLs a page mentions, its own address included."""
    found = references(pages, ["href", "src", "data-src", "data-url", "action"], boundary=True, decode=False)
    own = pages.select("page_id", "url", F.col("url").alias("href"))
    # a page may link to itself; everything else is distinct already
    foreign = found.where(F.col("href") != F.col("url")).select("page_id", "url", "href")
    return foreign.unionByName(own.where("href IS NOT NULL"))


def css_urls(sheets: DataFrame) -> DataFrame:
    """url(...) and @import targets of stylesheet bodies (``page_id, url, css``)."""
    css = F.col("css")
    channels = [
        ("css-url", r"url\(\s*[\"']?([^\"')]+)[\"']?\s*\)"),
        ("css-import", r"@import\s+(?:url\()?\s*[\"']([^\"']+)[\"']"),
    ]
    found = F.flatten(
        F.array(*[
            tagged(all_matches(css, p, 1), via, "raw") for via, p in channels
        ])
    )
    rows = sheets.select("page_id", "url", F.explode(found).alias("x")).select("page_id", "url", "x.via", "x.raw")
    links = U.resolved(rows, "trim(raw)", "url", "href")
    return links.select("page_id", "via", U.crawl_canonical(F.col("href")).alias("href"))


# --- navigation links ---------------------------------------------------------------
_CONTEXT_TAGS = ["tr", "li", "article", "section", "p", "div", "td"]
_CONTEXT_LIMIT = 8000
# where a link is found
_IN_ANCHOR, _IN_TAG, _IN_SCRIPT, _IN_FORM = range(4)
_FORM = r"<form\b([^>]*)>([\s\S]*?)</form>"
_WINDOW = 1200


def _tag_marks(pages: DataFrame) -> DataFrame:
    """Page rows with the tag list, the positions navigation needs and the items found in script text and forms."""
    marks = {
        "a_open": (["a"], r"a\b[^>]*>"), "a_close": (["/a>"], None), "text_end": (["/a>", "/td>", "/tr>", "br"], None),
        "row_open": (["tr"], r"tr\b[^>]*>"), "breaks": (["/tr>", "br"], None),
    }
    for t in _CONTEXT_TAGS:
        marks[f"open_{t}"] = [t], None
        marks[f"close_{t}"] = [f"/{t}>"], None
    rows = pages.select(
        "page_id", "url", T.split_tags(F.col("html")).alias("tags"), _script_items().alias("scripts"), _form_items().alias("forms")
    )
    rows = rows.selectExpr("page_id", "url", "tags", "scripts", "forms", f"{T.heads_sql('tags')} AS heads", "if(tags IS NULL, NULL, sequence(0, size(tags) - 1)) AS places")
    return rows.selectExpr(
        "page_id", "url", "tags", "scripts", "forms", *[f"{T.starts_sql('heads', 'places', names, p)} AS {n}" for n, (names, p) in marks.items()]
    )


def _context(at: str, end: str) -> str:
    """SQL text: smallest listed element around a tag, else the text around it."""
    enclosing = []
    for t in _CONTEXT_TAGS:
        # a place is looked for only where the ones before it leave an element possible
        text = S.let(f"concat({T.span('tags', 'a', 'z')}, '</{t}>')", "x", f"if(length(x) <= {_CONTEXT_LIMIT}, x, NULL)")
        opened = f"if(a > coalesce({T.last_before(f'close_{t}', f'{at} + 1')}, -1), {text}, NULL)"
        # a tag has a character at least, so a span of more tags is over the limit
        closed = S.let(T.first_after(f"close_{t}", end), "z", f"if(z - a <= {_CONTEXT_LIMIT}, {opened}, NULL)")
        start = S.let(T.last_before(f"open_{t}", f"{at} + 1"), "a", f"if(a IS NULL, NULL, {closed})")
        enclosing.append(f"if(size(open_{t}) = 0 OR size(close_{t}) = 0, NULL, {start})")
    # likewise, no more tags are put together than the window can show
    left = f"greatest(coalesce({T.last_before('breaks', at)}, 0), {at} - {_WINDOW} - 2)"
    right = f"least(coalesce({T.first_after('breaks', end)}, size(tags)), {end} + 2 * {_WINDOW})"
    near = f"right({T.span('tags', left, at)}, {_WINDOW} + 2)"
    before = f"right({S.extract(near, r'([^\n]*)$')}, {_WINDOW})"
    after = S.extract(T.span("tags", end, right), r"^(<[^>]*>[^\n]{0," + str(_WINDOW) + "})")
    return f"coalesce({', '.join(enclosing)}, concat({before}, {T.span('tags', at, end)}, {after}))"


def _anchor_items(with_context: bool) -> str:
    """SQL text: one struct per <a> start tag with its three texts and its context."""
    inside = "^<[^>]*>"
    close, previous = T.first_after("a_close", "i"), f"coalesce({T.last_before('a_close', 'i')}, -1)"
    facts = (
        f"named_struct('close', {close}, 'opens', {T.first_after('a_open', previous)} = i, 'stop', {T.first_after('text_end', 'i')}, "
        f"'row_start', {T.first_after('row_open', f'coalesce({T.last_before("close_tr", "i")}, -1)')}, 'row_stop', {T.first_after('close_tr', 'i')})"
    )
    closed = "(k.close IS NOT NULL AND k.opens)"
    rest = S.replace(T.span("tags", "i", "coalesce(k.stop, size(tags))"), inside, "")
    context = S.let(f"if({closed}, k.close, i)", "e", _context("i", "e"))
    if not with_context:
        # anchors without own text still borrow the text around them
        bare = S.replace("rest", r"(?i)<[^>]*>|&nbsp;|\s", "")
        context = f"if({bare} = '', {context}, '')"
    row = (
        f"named_struct('source', {_IN_ANCHOR}, 'pos', i, 'tag', get(tags, i), "
        f"'closed', if({closed}, if(k.close <=> k.stop, rest, {S.replace(T.span('tags', 'i', 'k.close'), inside, '')}), NULL), "
        f"'loose', if(k.stop IS NOT NULL, rest, substring(rest, 1, 1000)), "
        f"'row', if(k.row_start < i AND k.row_stop IS NOT NULL, {T.span('tags', 'k.row_start', 'k.row_stop')}, NULL), "
        f"'context', {context})"
    )
    return f"transform(a_open, i -> {S.let(facts, 'k', S.let(rest, 'rest', row))})"


def _tag_items(with_context: bool) -> str:
    """SQL text: one struct per tag with data-* attributes, an onclick handler or a meta refresh."""
    wanted = r"(?i)^[^>]+\b(?:onclick|data-href|data-url|data-link|data-target|data-detail-url|http-equiv)\s*="
    found = f"filter(transform(tags, (t, i) -> named_struct('pos', i, 'tag', t)), x -> instr(x.tag, '=') > 0 AND {S.rlike('x.tag', wanted)})"
    none = "cast(NULL AS string)"
    return (
        f"transform({found}, x -> named_struct('source', {_IN_TAG}, 'pos', x.pos, 'tag', x.tag, 'closed', {none}, 'loose', {none}, "
        f"'row', {none}, 'context', {_context('x.pos', 'x.pos') if with_context else "''"}))"
    )


def _hits(family: Column, via: Column, raws: Column) -> Column:
    """array<struct<kind, via, raw>> of found references; ``kind`` is the rank of their (first) mention."""
    return F.transform(raws, lambda r: F.struct(family.alias("kind"), via.alias("via"), r.alias("raw")))


def _tag_hits() -> Column:
    """References of a tag that is no anchor: data-* attribute, onclick handler, meta refresh."""
    tag = F.concat(F.lit("<"), F.regexp_extract("tag", r"^([^>]*>)", 1))
    data = rf"\b({'|'.join(fv.NAV_DATA_ATTRS)}){T.VALUE}"
    refresh = (
        r"(?i)^<meta\b[^>]*http-equiv\s*=\s*(?:\"refresh\"|'refresh'|refresh)[^>]*content\s*=\s*"
        r"(?:\"[^\"]*url=([^\";]+)\"|'[^']*url=([^';]+)'|[^>]*url=([^\s>]+))"
    )

    def hits(tag: Column) -> Column:
        # the attribute list is matched greedily, so the last one of a tag counts
        hit = F.nullif(F.regexp_extract(tag, ci(r"^<[^>]+" + f"({data})"), 1), F.lit(""))
        click = F.coalesce(
            F.nullif(F.regexp_extract(tag, r"(?i)^<[^>]+\bonclick\s*=\s*\"([^\"]+)\"", 1), F.lit("")),
            F.nullif(F.regexp_extract(tag, r"(?i)^<[^>]+\bonclick\s*=\s*'([^']+)'", 1), F.lit("")),
        )
        scripts = F.coalesce(F.transform(script_matches(click), lambda x: x["raw"]), F.array().cast("array<string>"))
        target = F.coalesce(*[F.nullif(F.regexp_extract(tag, refresh, g), F.lit("")) for g in (1, 2, 3)])
        found = F.concat(
            _hits(F.lit(3), F.lower(F.regexp_extract(hit, r"^([^\s=]+)", 1)), F.array_compact(F.array(T.unquote(hit)))),
            _hits(F.lit(4), F.lit("onclick"), scripts),
            _hits(F.lit(6), F.lit("meta-refresh"), F.array_compact(F.array(target))),
        )
        return F.struct(tag.alias("tag"), found.alias("found"))

    return bind(tag, hits)


def _anchor_hits() -> Column:
    """Reference of an anchor, or those of the script in its place."""
    tag = F.regexp_replace(F.regexp_replace("tag", r"^a\b|>[\s\S]*$", ""), "(?i)^a", "")

    def hits(raw: Column) -> Column:
        scripted = _hits(F.lit(0), F.lit("-javascript"), F.transform(script_matches(raw), lambda x: x["raw"]))
        plain = _hits(F.lit(0), F.lit(""), F.array(raw))
        found = F.when(raw.rlike("(?i)^javascript:"), scripted).when(raw.isNotNull(), plain)
        return F.struct(raw.alias("tag"), found.alias("found"))

    return bind(T.attribute(tag, "href"), hits)


def _item(source: int, pos: Column, raw: Column, context: Column) -> Column:
    """An item whose ``tag`` is the reference itself."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(source).alias("source"), pos.alias("pos"), raw.alias("tag"), none.alias("closed"), none.alias("loose"), none.alias("row"),
        context.alias("context"),
    )


def _script_items() -> Column:
    """One struct per URL named in the page's script text."""
    return F.transform(script_matches(F.col("html")), lambda x: _item(_IN_SCRIPT, F.lit(2**31 - 1), x["raw"], F.lit("")))


def _form_raw(piece: Column) -> Column:
    """A GET form as a link: action plus its named, non-empty inputs; NULL for other forms."""
    c = F.col
    attrs, body = F.regexp_extract(piece, ci("^" + _FORM), 1), F.regexp_extract(piece, ci("^" + _FORM), 2)
    method = F.lower(F.coalesce(T.attribute(attrs, "method"), F.lit("get")))
    action = F.coalesce(F.nullif(T.attribute(attrs, "action"), F.lit("")), c("url"))
    # a later input of the same name replaces the value, at its first place
    inputs = F.filter(
        F.transform(
            all_matches(body, rf"<input\b[^>]*\bname{T.VALUE}[^>]*>"),
            lambda t: F.struct(
                T.attribute(t, "name").alias("key"),
                html_decode(F.coalesce(T.attribute(t, "value"), F.lit(""))).alias("value"),
            ),
        ),
        lambda p: (p["value"] != "") & ~p["value"].isin('""', "''"),
    )

    def joined(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        last_of = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
        return F.array_join(F.transform(names, lambda k: F.concat(F.url_encode(k), F.lit("="), F.url_encode(last_of(k)))), "&")

    def link(target: Column) -> Column:
        head = F.regexp_extract(target, r"^([^?#]*)", 1)
        text = bind(F.concat(U.param_pairs(target), inputs), joined)
        return bind(text, lambda qs: F.when(qs != "", F.concat(head, F.lit("?"), qs)).otherwise(target))

    target = U.resolve(F.regexp_replace(action, "^(?:\"\"|'')$", ""), c("url"))
    return F.when(piece.rlike(ci("^" + _FORM)) & (method == "get"), bind(target, lambda t: F.when(t.isNotNull(), link(t))))


def _form_items() -> Column:
    """One struct per GET form of the page."""
    html = F.col("html")
    # the page cut at its forms, beside the forms' places in the tag list
    pieces = F.filter(F.split(html, r"(?i)(?=<form\b)"), lambda p: p.rlike(ci(r"^<form\b")))
    places = F.expr(T.positions_sql("split(html, '<')", r"form\b"))
    each = F.transform(
        F.arrays_zip(pieces.alias("piece"), places.alias("pos")),
        lambda x: _item(_IN_FORM, x["pos"], _form_raw(x["piece"]), F.regexp_extract(x["piece"], ci("^" + _FORM), 0)),
    )
    # most pages have none
    return F.when(html.rlike(ci(r"<form\b")), F.filter(each, lambda x: x["tag"].isNotNull()))


def _mentions(pages: DataFrame, with_context: bool) -> DataFrame:
    """Link mentions of all channels: anchors, data-* attributes, onclick handlers, meta refresh, script text, GET forms.

    A page is read, cut and marked once for all of them.  References are
    resolved before their texts are made, so a filter on the page key leaves
    out the texts too.
    """
    c = F.col
    none = "slice(tagged, 1, 0)"
    every = S.let(_tag_items(with_context), "tagged", f"concat({_anchor_items(with_context)}, tagged, coalesce(scripts, {none}), coalesce(forms, {none}))")
    rows = _tag_marks(pages).selectExpr("page_id", "url", f"explode({every}) AS a").select("page_id", "url", "a.*")
    found = (
        F.when(c("source") == _IN_ANCHOR, _anchor_hits()).when(c("source") == _IN_TAG, _tag_hits())
        .otherwise(F.struct(c("tag"), F.array(F.struct(
            F.when(c("source") == _IN_SCRIPT, 5).otherwise(7).alias("kind"),
            F.when(c("source") == _IN_SCRIPT, "javascript-string").otherwise("form-get").alias("via"), c("tag").alias("raw"),
        )).alias("found")))
    )
    # explode is a generator: what it gives is computed once per row
    rows = rows.withColumn("f", F.explode(F.array(found)))
    rows = rows.select("page_id", "url", "source", "pos", "closed", "loose", "row", "context", c("f.tag").alias("tag"), F.explode("f.found").alias("h"))
    rows = resolve_links(rows.select("*", c("h.raw").alias("raw"))).drop("raw")
    texts = rows.select(
        "page_id", "url", "source", "pos", "href", "canon", "h", "closed", "loose", "tag",
        F.when(c("h.kind") == 6, c("tag")).otherwise(c("context")).alias("context"),
        F.expr(f"if(closed IS NULL, NULL, {clean_sql('closed')})").alias("closed_text"),
        F.expr(f"if(row IS NULL, NULL, {clean_sql('row')})").alias("row_text"),
    )
    texts = texts.select("*", F.expr(clean_sql("context")).alias("context_text"))
    own = F.expr(f"if(loose <=> closed, closed_text, {clean_sql('loose')})")
    loose = bind(own, lambda t: F.when(t != "", t).otherwise(c("context_text")))
    anchored = F.filter(
        F.array(
            F.struct(F.lit(0).alias("rank"), F.concat(F.lit("href"), c("h.via")).alias("via"), c("closed_text").alias("text")),
            F.struct(F.lit(1).alias("rank"), F.concat(F.lit("href-loose"), c("h.via")).alias("via"), loose.alias("text")),
            F.struct(F.lit(2).alias("rank"), F.concat(F.lit("table-row"), c("h.via")).alias("via"), c("row_text").alias("text")),
        ),
        lambda m: m["text"].isNotNull(),
    )
    named = F.when(c("h.kind") >= 5, F.lit("")).otherwise(clean_text(c("tag")))
    single = F.array(F.struct(c("h.kind").alias("rank"), c("h.via").alias("via"), named.alias("text")))
    return texts.select(
        "page_id", "url", "pos", "href", "canon", "context", "context_text",
        F.when(c("source") == _IN_ANCHOR, anchored).otherwise(single).alias("mentions"),
    )


def navigation_links(pages: DataFrame, with_context: bool = True) -> DataFrame:
    """Links of a page from all discovery channels, one row per page key.

    Mentions of one key are folded in channel and page order: longer text
    wins, but a recovered anchor or row text of at least four characters
    replaces a text more than 1.5 times as long.  ``pos`` is the tag ordinal of
    the first mention.
    """
    c = F.col
    links = _mentions(pages, with_context)
    if not with_context:
        links = links.withColumn("context", F.lit("")).withColumn("context_text", F.lit(""))
    flat = F.transform(
        "mentions",
        lambda m: F.struct(
            m["rank"].alias("rank"), c("pos").alias("pos"), c("href").alias("href"), m["via"].alias("via"), m["text"].alias("text")
        ),
    )
    grouped = links.withColumn("mentions", flat).groupBy("page_id", "url", "canon").agg(
        F.array_sort(F.flatten(F.collect_list("mentions"))).alias("seen"),
        F.min("pos").alias("pos"),
        F.max_by(
            F.struct("context_text", "context"),
            F.struct(F.length("context_text"), -F.expr("mentions[0].rank"), -c("pos")),
        ).alias("ctx"),
    )

    def fold(acc: Column, m: Column) -> Column:
        size, current = F.length(m["text"]), F.length(acc["text"])
        recovered = m["via"].rlike("href-loose|table-row") & (size >= 4) & (current > size * 1.5)
        return F.struct(
            F.when((size > current) | recovered, m["text"]).otherwise(acc["text"]).alias("text"),
            F.when(acc["via"] == "", m["via"])
            .when(F.instr(acc["via"], m["via"]) > 0, acc["via"])
            .otherwise(F.concat(acc["via"], F.lit("+"), m["via"]))
            .alias("via"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("via"))
    return grouped.withColumn("merged", F.aggregate("seen", start, fold)).select(
        "page_id", "url", F.expr("seen[0].href").alias("href"), "canon", c("merged.text").alias("text"),
        c("ctx.context_text").alias("context_text"), c("ctx.context").alias("context_html"),
        c("merged.via").alias("via"), "pos",
    )


def is_useful_text(text: Column) -> Column:
    """Link text that can name a record: long enough, not a menu word."""
    t = squeeze(text)
    return F.length(t).between(4, 1000) & ~t.rlike(ci(fv.NAV_TEXT)) & (letters(t) >= 4)


def is_useful_title(text: Column, site_names: Sequence[str] = ()) -> Column:
    """Neither short nor a menu word nor one of the sites' own names."""
    low = F.lower(text)
    noise = [n.lower() for n in [*site_names, *fv.TITLE_NOISE]]
    starts = reduce(lambda a, b: a | b, [low.startswith(n + " ") for n in noise])
    return (F.length(text) >= 5) & ~low.isin(noise) & ~starts


def useful_links(anchors: DataFrame, site_names: Sequence[str] = ()) -> DataFrame:
    """Anchors whose text can serve as a title."""
    return anchors.where(is_useful_text(F.col("text")) & is_useful_title(F.col("text"), site_names))
