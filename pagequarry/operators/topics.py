"""Category topics: menu labels, category links, topic keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import all_matches, bind, ci, clean_text, squeeze
from pagequarry.operators.extract import ANCHOR, explode_matches, resolve_links

_URL_TEXT = r"(?i)^(?:https?://|\.{0,2}/)"


def _keyed_labels(rows: DataFrame) -> DataFrame:
    """Resolve ``raw`` and key each label by its category."""
    links = resolve_links(rows)
    key = bind(U.category_map(U.first_params(F.col("href"))), lambda m: U.category_key(F.col("href"), m))
    return links.select("page_id", key.alias("category_key"), "label", "ord")


def _some(text: Column) -> Column:
    """Generator of a text that is neither NULL nor empty; no filter repeats its work."""
    return F.explode(F.filter(F.array(text), lambda t: t != ""))


def menu_labels(pages: DataFrame) -> DataFrame:
    """Longest label per category from anchor images and script menus."""
    m = F.col("m")
    inner = F.regexp_extract(m, ci(ANCHOR), 4)
    alt = r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    title = r"\btitle\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    label = F.when(
        inner.rlike(ci(alt)), F.concat(F.regexp_extract(inner, ci(alt), 1), F.regexp_extract(inner, ci(alt), 2))
    ).otherwise(F.concat(F.regexp_extract(inner, ci(title), 1), F.regexp_extract(inner, ci(title), 2)))
    # an anchor or list without what a label needs is left out before it is taken apart
    found = F.filter(
        F.transform(all_matches(F.col("html"), ANCHOR), lambda a, i: F.struct(i.alias("pos"), a.alias("m"))),
        lambda x: x["m"].rlike(ci(r"\b(?:alt|title)\s*=")),
    )
    named = pages.select("page_id", "url", F.explode(found).alias("x")).select("page_id", "url", "x.*")
    anchors = named.select("*", _some(clean_text(label)).alias("label")).select(
        "page_id", "url", F.col("pos").alias("ord"),
        F.coalesce(*[F.nullif(F.regexp_extract(m, ci(ANCHOR), g), F.lit("")) for g in (1, 2, 3)]).alias("raw"), "label",
    )
    groups = explode_matches(pages, all_matches(F.col("html"), r"\[([^\[\]]{0,800})\]", 1)).where(F.contains("m", F.lit("=")))
    strings = groups.select("*", F.explode(F.array(F.regexp_extract_all("m", F.lit('"([^"]*)"'), F.lit(1)))).alias("strings"))

    def is_category(v: Column) -> Column:
        return v.rlike(_URL_TEXT) & v.rlike(ci(r"[?&](?:" + "|".join(fv.CATEGORY_PARAMS) + r")=[^&#]"))

    places = F.array_position(F.transform("strings", is_category), F.lit(True))
    strings = strings.select("page_id", "url", "pos", "strings", F.explode(F.filter(F.array(places), lambda p: p > 0)).alias("at"))
    at = F.col("at")
    labels = F.filter(
        F.transform(F.slice("strings", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), clean_text),
        lambda v: (v != "") & ~v.rlike(_URL_TEXT) & ~v.rlike(r"^-?[0-9]+$"),
    )
    scripts = strings.select(
        "page_id", "url", (F.col("pos") + 1_000_000).alias("ord"),
        F.get(F.col("strings"), (at - 1).cast("int")).alias("raw"),
        _some(F.try_element_at(labels, F.lit(-1))).alias("label"),
    )
    found = _keyed_labels(anchors.unionByName(scripts))
    return found.groupBy("page_id", "category_key").agg(
        F.max_by("label", F.struct(F.length("label"), -F.col("ord"))).alias("label")
    )


def category_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Category pages linked from each page, with the best title known.

    ``links`` is the navigation link table.
    """
    c = F.col
    # parameters and categories come out of generators, so the filters on them do not repeat their work
    # the page key keeps a link's site and its category, and a filter on it is applied before texts are made and merged
    category = ci(r"[?&](?:" + "|".join(fv.CATEGORY_PARAMS) + r")=[^&]")
    own = links.where(c("canon").rlike(category) & (U.site(c("canon")) == U.site(c("url"))))
    own = own.where((U.site(c("href")) == U.site(c("url"))) & ~U.is_link_asset(c("href")))
    facts = own.select("*", F.explode(F.array(U.first_params(c("href")))).alias("params"))
    facts = facts.select("*", F.explode(F.filter(F.array(U.category_map(c("params"))), lambda m: F.size(m) > 0)).alias("cats")).where(
        U.record_id(c("href"), c("params")).isNull()
        & U.pick_param(c("params"), fv.PAGE_PARAMS).isNull()
        & ~U.path(c("href")).rlike(ci(fv.PAGE_PATH))
    )
    keyed = facts.withColumn("category_key", U.category_key(c("href"), c("cats")))
    joined = keyed.join(labels, ["page_id", "category_key"], "left")
    title = F.substring(F.coalesce(F.nullif(squeeze(clean_text(c("text"))), F.lit("")), c("label"), F.lit("")), 1, 120)
    target = F.concat(U.scheme(c("url")), F.regexp_extract("canon", r"^https?(:.*)$", 1))
    rows = joined.select("page_id", "url", "category_key", "pos", title.alias("title"), target.alias("topic_url"))
    best = F.struct(F.length("title"), -c("pos"))
    return rows.groupBy("page_id", "url", "category_key").agg(
        F.max_by("topic_url", best).alias("topic_url"), F.max_by("title", best).alias("title")
    )


def merge_topics(topics: DataFrame) -> DataFrame:
    """Topics of all candidate pages of a site, longest title per URL."""
    best = F.struct(F.length("title"), -F.col("page_id"))
    return topics.groupBy(U.site(F.col("url")).alias("site"), "topic_url").agg(
        F.max_by("title", best).alias("title"), F.count("*").alias("n_pages")
    )


def slug(text: Column) -> Column:
    """Letters, marks, digits and underscores; everything else one '_'."""
    s = F.regexp_replace(F.trim(text), r"\s+", "_")
    s = F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}_]+", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")


def shorten(cleaned: Column) -> Column:
    """Names over 64 characters keep their head plus a 4-digit hash."""

    def short(name: Column) -> Column:
        head = F.regexp_replace(F.substring(name, 1, fv.TOPIC_NAME_LIMIT - 5), "_+$", "")
        cut = F.concat(head, F.lit("_"), F.substring(F.sha1(F.encode(name, "UTF-8")), 1, 4))
        return F.when(F.length(name) > fv.TOPIC_NAME_LIMIT, cut).otherwise(name)

    return bind(cleaned, short)


def name_from_url(u: Column) -> Column:
    """Topic name for an untitled link: first host label plus category or path."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", "_"), "_+", "_"), "^_|_$", "")

    label = F.coalesce(F.nullif(plain(F.regexp_extract(U.site(u), r"^([^.]+)", 1)), F.lit("")), F.lit("site"))

    def exact(ps: Column, name: str) -> Column:
        return F.nullif(F.get(F.filter(ps, lambda p: p["key"] == name), F.lit(0))["value"], F.lit(""))

    cat = bind(U.param_pairs(u), lambda ps: F.coalesce(exact(ps, "cat_id"), exact(ps, "cat"), exact(ps, "id")))
    last = plain(F.regexp_replace(U.last_segment(u), r"(?i)\.[a-z0-9]+$", ""))
    tail = bind(
        F.struct(cat.alias("cat"), last.alias("last")),
        lambda x: F.when(x["cat"].isNotNull(), F.concat(F.lit("_cat_"), x["cat"]))
        .when((x["last"] != "") & (F.length(x["last"]) <= 40), F.concat(F.lit("_"), x["last"]))
        .otherwise(F.lit("_page")),
    )
    return shorten(slug(F.substring(F.concat(label, tail), 1, 56)))


def topic_names(topics: DataFrame) -> DataFrame:
    """Table key per topic, with the reason a topic cannot be used.

    ``topics``: ``seq, title, url``.  The first topic of a key keeps it.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    has_url = F.coalesce(F.trim("url"), F.lit("")) != ""
    cleaned = slug(F.when(title != "", title).otherwise(name_from_url(F.col("url"))))
    rows = topics.withColumn("_clean", cleaned).withColumn("table_name", shorten(F.col("_clean")))
    rows = rows.withColumn("truncated", F.length("_clean") > fv.TOPIC_NAME_LIMIT)
    own_error = (
        F.when(~has_url, "missing_url")
        .when(~U.is_http(F.col("url")), "bad_url")
        .when(F.col("table_name") == "", "empty_name")
        .when(F.lower("table_name").isin(fv.RESERVED_TABLES), "reserved_name")
    )
    rows = rows.withColumn("_error", own_error).where((title != "") | has_url)
    first = rows.where("_error IS NULL").groupBy(F.lower("table_name").alias("_k")).agg(F.min("seq").alias("seq")).select("seq")
    marked = rows.join(first.withColumn("_first", F.lit(True)), "seq", "left")
    error = F.coalesce("_error", F.when(F.col("_first").isNull(), "duplicate_name"))
    return marked.select(*topics.columns, "table_name", "truncated", error.alias("error"))
