"""Site-level jobs: vendor fingerprints, section links, suggested sections.

Rules are a short fixed list, so each is one constant pattern evaluated in the
scan; a site's pages are reduced to matched rule numbers before any shuffle
and page text never leaves its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import clean_text, matches
from pagequarry.operators.extract import fingerprint_urls

_ORDER = {v: i for i, (v, _) in enumerate(fv.VENDORS)}


def _rule(n: int, vendor: str, target: str, weight: int, label: str) -> list[Column]:
    return [
        F.lit(n).alias("rule"), F.lit(vendor).alias("vendor_id"), F.lit(target).alias("target"),
        F.lit(weight).alias("weight"), F.lit(label).alias("label"),
    ]


def rule_hits(target: str, tests, value: Column) -> Column:
    """array<struct> of the matched rules of one target."""
    hits = [
        F.when(tests(p), F.struct(*_rule(n, v, t, w, label), value.alias("value")))
        for n, (v, t, p, w, label) in enumerate(fv.VENDOR_RULES)
        if t == target
    ]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def vendor_matches(pages: DataFrame) -> DataFrame:
    """Matched fingerprint rules per site, once each, with the first witness."""
    text = F.concat_ws("\n", F.col("html"), clean_text(F.col("html")))
    in_text = pages.select(
        U.site(F.col("url")).alias("site"), "page_id",
        # the text is made once per page, not once per rule
        F.explode(F.flatten(F.transform(F.array(text), lambda t: rule_hits("text", lambda p: matches(t, p), F.lit(None).cast("string"))))).alias("h"),
    )
    href = F.col("href")

    def url_hits(host: Column) -> Column:
        return rule_hits("url", lambda p: matches(href, p) | matches(host, p), href)

    in_url = fingerprint_urls(pages).select(
        U.site(F.col("url")).alias("site"), "page_id",
        F.explode(F.flatten(F.transform(F.array(F.lower(U.host(href))), url_hits))).alias("h"),
    )
    hits = in_text.unionByName(in_url).select("site", "page_id", "h.*")
    return hits.groupBy("site", "rule", "vendor_id", "target", "weight", "label").agg(
        F.min_by("value", F.struct("page_id", "value")).alias("value")
    )


def vendor_scores(found: DataFrame, manual: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """Score and evidence per site and vendor; vendors without hits score 0.

    ``manual``: ``site, vendor_id`` chosen by a person.  ``sites``: ``site`` of
    all sites, so that those without any hit are scored too.
    """
    summed = found.groupBy("site", "vendor_id").agg(
        F.sum("weight").alias("score"),
        F.array_sort(F.collect_list(F.struct("rule", "target", "label", "value", "weight"))).alias("evidence"),
    )
    vendors = F.array(*[F.struct(F.lit(v).alias("vendor_id"), F.lit(i).alias("vendor_order")) for v, i in _ORDER.items()])
    named = reduce(DataFrame.union, [rows.select("site") for rows in (found, manual, sites) if rows is not None])
    every = named.distinct().select("site", F.inline(vendors))
    scored = every.join(summed, ["site", "vendor_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    if manual is None:
        return scored
    chosen = manual.select("site", "vendor_id", F.lit(fv.VENDOR_MANUAL_BONUS).alias("_bonus"))
    return scored.join(chosen, ["site", "vendor_id"], "left").withColumn(
        "score", F.col("score") + F.coalesce("_bonus", F.lit(0))
    ).drop("_bonus")


def vendor_ranking(scores: DataFrame) -> DataFrame:
    """Vendors of a site best first; ties keep the rule-table order."""
    # a site has one row per vendor here, so the window is tiny
    w = Window.partitionBy("site").orderBy(F.desc("score"), "vendor_order")
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score", 1, 0).over(w))


def vendor_winner(scores: DataFrame, minimum: int = fv.VENDOR_MINIMUM_SCORE) -> DataFrame:
    """Winning vendor per site with margin and confidence, else generic."""
    top = vendor_ranking(scores).where("rank = 1")
    score, margin = F.col("score"), F.greatest(F.lit(0), F.col("score") - F.col("next_score"))
    known = score >= minimum
    strong = F.round(45 + F.least(F.lit(35.0), score / 6) + F.least(F.lit(20.0), margin / 5))
    confidence = F.when(known, F.greatest(F.lit(35), F.least(F.lit(100), strong))).otherwise(
        F.least(F.lit(34), F.round(score / 2))
    )
    names = F.create_map(*[F.lit(x) for pair in fv.VENDORS for x in pair])
    generic, generic_name = fv.VENDOR_UNKNOWN
    return top.select(
        "site",
        F.when(known, F.col("vendor_id")).otherwise(generic).alias("vendor_id"),
        F.when(known, names[F.col("vendor_id")]).otherwise(generic_name).alias("vendor_name"),
        score.cast("int").alias("score"), margin.cast("int").alias("margin"), confidence.cast("int").alias("confidence"),
    )


# --- section links ---------------------------------------------------------------------
def section_scores(text: Column, u: Column) -> Column:
    """array<struct<section, score>> of the sections a link could open."""
    hay = F.concat(F.lower(text), F.lit(" "), F.lower(u))
    pattern, points = fv.SECTION_PENALTY
    penalty = F.when(matches(hay, pattern), points).otherwise(0)
    scored = []
    for section in dict.fromkeys(s for s, _, _ in fv.SECTION_RULES):
        terms = [F.when(matches(hay, p), w).otherwise(0) for s, p, w in fv.SECTION_RULES if s == section]
        total = reduce(lambda a, b: a + b, terms) + penalty
        scored.append(F.struct(F.lit(section).alias("section"), total.alias("score")))
    return F.filter(F.array(*scored), lambda s: s["score"] > 0)


def section_links(anchors: DataFrame) -> DataFrame:
    """Best link per site and section; earlier page and anchor on ties."""
    here = U.site(F.col("url"))
    rows = anchors.where(U.site(F.col("href")) == here).select(
        here.alias("site"), "page_id", "pos", "href", F.inline(section_scores(F.col("text"), F.col("href")))
    )
    best = F.struct(F.col("score"), -F.col("page_id"), -F.col("pos"))
    return rows.groupBy("site", "section").agg(F.max_by("href", best).alias("href"), F.max("score").alias("score"))


def probe_urls(scope: DataFrame, limit: int = fv.VENDOR_PROBE_LIMIT) -> DataFrame:
    """Per config: roots of accepted URLs, then the URLs, first ``limit``.

    A config's list is capped while it is built (bounded sorted slice), never
    gathered whole: each URL is first reduced to its earliest position.
    """
    accepted = scope.where("accepted").withColumn("u", U.resolve(F.col("value"), F.col("value")))
    both = accepted.select(
        "config_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("grp"), F.col("ord"), F.concat(U.origin(F.col("u")), F.lit("/")).alias("probe")),
                F.struct(F.lit(1).alias("grp"), F.col("ord"), F.col("value").alias("probe")),
            )
        ),
    )
    first = both.groupBy("config_id", "probe").agg(F.min(F.struct("grp", "ord")).alias("at"))
    # the window keeps only rank <= limit per task before the final pass
    w = Window.partitionBy("config_id").orderBy("at")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("config_id", "n", "probe")


def suggested_sections(sites: DataFrame, configured: DataFrame, discovered: DataFrame, winners: DataFrame) -> DataFrame:
    """Configured, else discovered, else vendor-default URL per section.

    ``sites``: ``site, origin``; ``configured``: ``site, section, value``.
    """
    sections = F.array(*[F.lit(s) for s in dict.fromkeys(s for s, _, _ in fv.SECTION_RULES)])
    base = sites.select("site", "origin", F.explode(sections).alias("section")).join(
        winners.select("site", "vendor_id"), "site", "left"
    )
    default = F
    for vendor, section, path in fv.VENDOR_SECTIONS:
        default = default.when((F.col("vendor_id") == vendor) & (F.col("section") == section), F.concat("origin", F.lit(path)))
    joined = base.join(discovered.select("site", "section", "href"), ["site", "section"], "left").join(
        configured.select("site", "section", "value"), ["site", "section"], "left"
    )
    own = F.when(U.site(F.col("value")) == F.col("site"), F.trim("value"))
    source = (
        F.when(F.nullif(own, F.lit("")).isNotNull(), "configured")
        .when(F.col("href").isNotNull(), "discovered")
        .when(default.otherwise(None).isNotNull(), "vendor-default")
        .otherwise("none")
    )
    return joined.select(
        "site", "section", F.coalesce(F.nullif(own, F.lit("")), "href", default.otherwise(None), F.lit("")).alias("suggested"),
        source.alias("source"),
    )


def default_topics(winners: DataFrame, sites: DataFrame) -> DataFrame:
    """Vendor-default topics of each site of a known vendor."""
    topics = F.array(*[
        F.struct(F.lit(v).alias("topic_vendor"), F.lit(t).alias("title"), F.lit(p).alias("path")) for v, t, p in fv.VENDOR_TOPICS
    ])
    rows = winners.join(sites, "site").withColumn(
        "t", F.explode(F.filter(topics, lambda t: t["topic_vendor"] == F.col("vendor_id")))
    )
    return rows.select("site", "t.title", F.concat("origin", "t.path").alias("url"))


def site_profiles(winners: DataFrame, scores: DataFrame) -> DataFrame:
    """Stored profile per site: winner plus its evidence list."""
    evidence = scores.select("site", "vendor_id", F.to_json("evidence").alias("evidence_json"))
    return winners.join(evidence, ["site", "vendor_id"], "left").fillna({"evidence_json": "[]"})
