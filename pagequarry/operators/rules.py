"""Rules that users keep in tables: which URLs to skip, which adapter a vendor has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import urls as U
from pagequarry.functions.text import matches

#: Pattern and fragment rules are tested on every URL, so a table may hold so many of them; host rules are joined and have no limit.
MAX_PATTERNS = 1000


def _host_name(value: Column) -> Column:
    """A configured host without scheme, path, port, www. or edge dots."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "^https?://", ""), "[/:].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"^\.+|\.+$", "")


def _suffixes(host: Column) -> Column:
    """The host and the domains it lies in, from the longest on."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def host_reasons(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, host_reason): the first host rule, by ``rank``, that fits the host or a domain it lies in.

    A host is spelled once with all its suffixes, so rules are found by an equi
    join, whatever their number.
    """
    pre, post = fv.SKIP_HOST_REASON
    blocked = rules.where("kind = 'host'").select("rank", _host_name(F.col("pattern")).alias("suffix")).where("suffix <> ''")
    first = blocked.groupBy("suffix").agg(F.min("rank").alias("rank"))
    spelled = hosts.select("host").where("host <> ''").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
    best = spelled.join(first, "suffix").groupBy("host").agg(F.min(F.struct("rank", "suffix")).alias("r"))
    return best.select("host", F.concat(F.lit(pre), "r.suffix", F.lit(post)).alias("host_reason"))


def table_skips(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links with the reason to skip them (NULL keeps the link), by rules from a table.

    ``links`` has ``href``; ``rules``: ``rank, kind, pattern, reason``; kinds are
    ``url_regex``, ``host`` and ``fragment``, tried in this order behind the
    scheme, each by ``rank``.  Equal ranks go by pattern.  A rule without a
    pattern is none.
    """
    tested = rules.where("kind <> 'host' AND pattern <> ''").select("rank", "kind", "pattern", "reason").orderBy("rank", "pattern").limit(MAX_PATTERNS + 1).collect()
    if len(tested) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} pattern rules")
    url, low = F.col("href"), F.lower("href")
    scheme = F.when(~U.scheme(url).isin("http", "https"), F.concat(F.lit(fv.SKIP_SCHEME_PREFIX), U.scheme(url), F.lit(":")))
    regex, fragment = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(tested):
        if r["kind"] == "url_regex":
            regex = F.when(matches(url, r["pattern"]), F.lit(r["reason"])).otherwise(regex)
        elif r["kind"] == "fragment":
            fragment = F.when(F.contains(low, F.lit(r["pattern"].lower())), F.lit(fv.SKIP_FRAGMENT_PREFIX + r["pattern"].lower())).otherwise(fragment)
    rows = links.withColumn("_site", U.site(url))
    found = host_reasons(rows.select(F.col("_site").alias("host")), rules).withColumnRenamed("host", "_site")
    joined = rows.join(found, "_site", "left")
    reason = F.coalesce(scheme, regex, "host_reason", fragment)
    return joined.select(*links.columns, reason.alias("skip_reason"))


def with_adapters(sites: DataFrame, adapters: DataFrame, generic: str = fv.VENDOR_UNKNOWN[0]) -> DataFrame:
    """Sites (``vendor_id``, ...) with ``adapter_id, adapter_name, settings`` from a table of adapters.

    ``adapters``: ``adapter_id, adapter_name, settings`` (a map).  Ids are
    compared without case and outer blanks; a vendor without an adapter gets the
    ``generic`` one.  Of adapters with equal ids the one with the smallest name
    counts.
    """
    known = adapters.groupBy(F.lower(F.trim("adapter_id")).alias("adapter_id")).agg(
        F.min("adapter_name").alias("adapter_name"), F.min_by("settings", "adapter_name").alias("settings")
    )
    own = known.select(F.col("adapter_id").alias("_vendor"), F.struct("adapter_id", "adapter_name", "settings").alias("_own"))
    rest = known.where(F.col("adapter_id") == generic).select(F.struct("adapter_id", "adapter_name", "settings").alias("_rest"))
    joined = sites.withColumn("_vendor", F.lower(F.trim("vendor_id"))).join(own, "_vendor", "left")
    fallback = rest.select("_rest").scalar()  # one row: ids are unique
    chosen = joined.withColumn("_adapter", F.coalesce("_own", fallback))
    return chosen.select(*sites.columns, "_adapter.adapter_id", "_adapter.adapter_name", "_adapter.settings")
