"""File index jobs: lookup by URL and digest, duplicates, pairing, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import urls as U
from pagequarry.session import cut_lineage


def content_duplicates(files: DataFrame) -> DataFrame:
    """Per digest: copies, first URL and bytes a single copy would save.

    ``files``: ``seq, url, content, file_size``.  Only the digest travels.
    """
    hashed = files.select("seq", "url", "file_size", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(
        F.count("*").alias("copies"),
        F.min_by("url", "seq").alias("first_url"),
        ((F.count("*") - 1) * F.max("file_size")).alias("wasted"),
    )


def index_keys(index: DataFrame) -> DataFrame:
    """Index records in long form, one row per lookup key (url or digest)."""
    entries = F.array(
        F.struct(F.lit("url").alias("kind"), U.asset_key(F.col("url")).alias("lookup")),
        F.struct(F.lit("url").alias("kind"), U.asset_key(F.col("final_url")).alias("lookup")),
        F.struct(F.lit("sha256").alias("kind"), F.col("sha256").alias("lookup")),
    )
    long = index.withColumn("_e", F.explode(entries)).select("_e.kind", "_e.lookup", *index.columns)
    return long.where("lookup IS NOT NULL AND lookup <> ''")


def latest_index(index: DataFrame) -> DataFrame:
    """The record each key resolves to: the one registered last."""
    record = F.struct(*index.columns)
    winners = index_keys(index).groupBy("kind", "lookup").agg(F.max_by(record, "seq").alias("r"))
    return winners.select("kind", "lookup", "r.*")


def index_lookup(
    fetched: DataFrame, index: DataFrame, skip_existing: bool = True, force_refresh: bool = False
) -> DataFrame:
    """Fetch results with the stored file they repeat, if any.

    Looked up by URL, then final URL, then digest: three equi joins against
    one-row-per-key tables, so neither side is duplicated and skew in the
    fetched side is split by the adaptive join.  ``force_refresh`` disables
    the URL lookups, ``skip_existing=False`` all of them.
    """
    keys = latest_index(index)

    def by(kind: str, name: str) -> DataFrame:
        return keys.where(F.col("kind") == kind).select(F.col("lookup").alias(f"_{name}"), F.col("local_path").alias(f"_{name}_path"))

    rows = fetched.withColumn("_u", U.asset_key(F.col("url"))).withColumn("_f", U.asset_key(F.col("final_url")))
    rows = (
        rows.join(by("url", "k1"), F.col("_u") == F.col("_k1"), "left")
        .join(by("url", "k2"), F.col("_f") == F.col("_k2"), "left")
        .join(by("sha256", "k3"), F.col("sha256") == F.col("_k3"), "left")
    )
    urls_on, any_on = skip_existing and not force_refresh, skip_existing
    hits = [(F.lit(urls_on), "url", "_k1_path"), (F.lit(urls_on), "final_url", "_k2_path"), (F.lit(any_on), "sha256", "_k3_path")]
    path: Column = F.coalesce(*[F.when(on, F.col(p)) for on, _, p in hits])
    found = F.coalesce(*[F.when(on & F.col(p).isNotNull(), F.lit(n)) for on, n, p in hits])
    return rows.select(
        *fetched.columns, path.alias("stored_path"), found.alias("found_by"),
        F.when(path.isNotNull(), "already_exists").otherwise("downloaded").alias("status"),
    )


def register(fetched: DataFrame) -> DataFrame:
    """Index records for fetch results that have a URL and a stored path."""
    return fetched.where("url IS NOT NULL AND local_path IS NOT NULL").select(
        "seq", "url", F.when(F.col("final_url") != F.col("url"), F.col("final_url")).otherwise("").alias("final_url"),
        "local_path", F.coalesce("sha256", F.lit("")).alias("sha256"), "file_size",
        F.coalesce("mime_type", F.lit("")).alias("mime_type"), "added_at",
    )


def _earlier_in_batch(fetched: DataFrame) -> DataFrame:
    """(seq, lead): the first row of the batch, by ``seq``, that registers a key of this row."""
    keys = index_keys(fetched).select("kind", "lookup", "seq", F.expr("url IS NOT NULL AND local_path IS NOT NULL").alias("_kept"))
    first = keys.where("_kept").groupBy("kind", "lookup").agg(F.min("seq").alias("lead"))
    return keys.join(first, ["kind", "lookup"]).where("lead < seq").groupBy("seq").agg(F.min("lead").alias("lead"))


def batch_lookup(fetched: DataFrame, index: DataFrame) -> DataFrame:
    """``index_lookup`` as if the rows, in ``seq`` order, were looked up and registered one by one.

    A row that shares a URL or a digest with an earlier row of the batch repeats
    that row's file, or the file which that row repeats.  A missing digest
    matches nothing.  ``seq`` is unique.
    """
    known = index_lookup(fetched, index).join(_earlier_in_batch(fetched), "seq", "left")
    known = cut_lineage(known.withColumn("root", F.when(F.col("stored_path").isNull(), F.col("lead")).otherwise(F.col("seq"))))
    known = known.withColumn("root", F.coalesce("root", "seq"))
    point, moved = known.select("seq", "root"), True
    while moved:  # each round halves the way to the row whose file counts
        onward = point.select(F.col("seq").alias("root"), F.col("root").alias("far"))
        ahead = cut_lineage(point.join(onward, "root").select("seq", "root", "far"))
        moved = not ahead.where("root <> far").isEmpty()
        point = ahead.select("seq", F.col("far").alias("root"))
    paths = known.select(F.col("seq").alias("root"), F.coalesce("stored_path", "local_path").alias("_path"))
    rows = known.drop("root").join(point.join(paths, "root"), "seq")
    repeats = F.col("root") != F.col("seq")
    return rows.select(
        *fetched.columns, F.when(repeats, F.col("_path")).otherwise(F.col("stored_path")).alias("stored_path"),
        F.when(repeats, "batch").otherwise(F.col("found_by")).alias("found_by"),
        F.when(repeats, "already_exists").otherwise(F.col("status")).alias("status"),
    )


def suppress_known_bad(fetched: DataFrame) -> DataFrame:
    """Mentions after the first HTML answer of a URL become invalid_content."""
    rows = fetched.withColumn("_key", U.asset_key(F.col("file_url")))
    first = rows.where("status = 'invalid_content'").groupBy("run_id", "_key").agg(F.min("seq").alias("_bad_seq"))
    joined = rows.join(first, ["run_id", "_key"], "left")
    suppressed = F.coalesce(F.col("seq") > F.col("_bad_seq"), F.lit(False))
    return joined.select(
        *[c for c in fetched.columns if c != "status"],
        F.when(suppressed, "invalid_content").otherwise(F.col("status")).alias("status"),
        suppressed.alias("suppressed"),
    )


def thumbnail_pairs(album: DataFrame) -> DataFrame:
    """Album images with their full-size partner; lone thumbnails stay.

    ``album``: ``album_id, pos, image_name``.
    """
    thumb = F.col("image_name").rlike("(?i)^t_")
    full = album.groupBy("album_id", F.lower("image_name").alias("stem")).agg(F.min_by("image_name", "pos").alias("full_name"))
    rows = album.withColumn("stem", F.when(thumb, F.lower(F.regexp_replace("image_name", "(?i)^t_", ""))))
    joined = rows.join(full, ["album_id", "stem"], "left")
    return joined.select(*album.columns, "full_name", F.col("full_name").isNull().alias("keep"))


def file_name(u: Column) -> Column:
    return F.lower(F.regexp_extract(U.decode_component(U.path(u)), r"([^/]+)/*$", 1))


def tiered_match(targets: DataFrame, cached: DataFrame) -> DataFrame:
    """Best cached asset per target: same URL, same path+query, same name.

    ``targets``: ``target_id, href``; ``cached``: ``cache_seq, href``.  Each
    tier keeps one cached row per key before joining, so a popular file name
    cannot multiply rows.
    """
    tiers = [
        (1, U.asset_key), (2, lambda u: F.concat(U.path(u), U.search(u))), (3, file_name),
    ]
    rows = targets
    for tier, key in tiers:
        best = cached.groupBy(key(F.col("href")).alias(f"_c{tier}")).agg(F.min("cache_seq").alias(f"_s{tier}"))
        best = best.where(F.col(f"_c{tier}") != "")
        rows = rows.withColumn(f"_t{tier}", key(F.col("href"))).join(best, F.col(f"_t{tier}") == F.col(f"_c{tier}"), "left")
    # path+query and name compete in cache order, an exact URL comes first
    seq = F.coalesce("_s1", F.least("_s2", "_s3"))
    tier = (
        F.when(F.col("_s1").isNotNull(), 1)
        .when(F.col("_s2").isNotNull() & (F.coalesce("_s3", "_s2") >= F.col("_s2")), 2)
        .when(F.col("_s3").isNotNull(), 3)
    )
    return rows.select(*targets.columns, seq.alias("cache_seq"), tier.alias("tier"))


def uncaptured_images(candidates: DataFrame, captured: DataFrame) -> DataFrame:
    """Images of the HTML that were not captured while rendering.

    ``candidates``: ``album_id, pos, href``; ``captured``: ``album_id, href``.
    First candidate per file and album.
    """
    keyed = candidates.withColumn("_key", U.asset_key(F.col("href")))
    seen = captured.select("album_id", U.asset_key(F.col("href")).alias("_key")).distinct()
    missing = keyed.join(seen, ["album_id", "_key"], "left_anti")
    return missing.groupBy("album_id", "_key").agg(F.min("pos").alias("pos"), F.min_by("href", "pos").alias("href")).drop("_key")


def missing_ids(seeds: DataFrame, details: DataFrame, cap: int | None = None) -> DataFrame:
    """Ids to probe per seed that declares more records than were found.

    ``seeds``: ``seed, declared, has_category``; ``details``: ``seed,
    detail_id``.  ``sequence`` expands inside the seed row; the range is cut
    into blocks first so one seed's range spreads over tasks.
    """
    seen = details.groupBy("seed").agg(F.count_distinct("detail_id").alias("found"), F.max("detail_id").alias("max_id"))
    short = seeds.join(seen, "seed", "left").where("has_category AND declared > coalesce(found, 0)")
    top = F.coalesce(F.lit(cap).cast("bigint"), F.nullif(F.col("max_id"), F.lit(0)), F.lit(3000))
    block = 100_000
    blocks = short.select("seed", top.alias("top")).select(
        "seed", "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("top") - 1) / block))).alias("b")
    ).repartition("seed", "b")
    ids = blocks.select(
        "seed",
        F.explode(F.sequence(F.col("b") * block + 1, F.least((F.col("b") + 1) * block, F.col("top")))).alias("detail_id"),
    )
    return ids.join(details, ["seed", "detail_id"], "left_anti")


def id_gap_ranges(seeds: DataFrame, details: DataFrame, cap: int | None = None, ranges: int | None = None) -> DataFrame:
    """(seed, first, last): the runs of ids to probe per seed that declares more records than were found.

    Ids run from 1 to ``cap``, or to the largest id seen; a seed without either
    has no runs.  Ids are sorted over the cluster by ranges; a gap lies between
    neighbours inside a range or between the ends of ranges, so neither a hot
    seed nor a far id is spelled out or gathered.
    """
    n = ranges or int(details.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = details.where("detail_id >= 1").select("seed", F.col("detail_id").cast("bigint").alias("detail_id")).distinct()
    found = details.groupBy("seed").agg(F.count_distinct("detail_id").alias("found"), F.max("detail_id").alias("max_id"))
    short = seeds.join(found, "seed", "left").where("has_category AND declared > coalesce(found, 0)")
    short = short.select("seed", F.coalesce(F.lit(cap), "max_id").cast("bigint").alias("top")).where("top >= 1")
    dealt = cut_lineage(ids.join(short, "seed").repartitionByRange(n, "seed", "detail_id").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", "seed").orderBy("detail_id")
    near = dealt.select("seed", "top", F.lag("detail_id").over(inside).alias("before"), F.col("detail_id").alias("after")).where("before IS NOT NULL")
    # the first and last id of each range meet the neighbouring ranges of their seed: one row per seed and range
    ends = dealt.groupBy("seed", "top", "_range").agg(F.min("detail_id").alias("lo"), F.max("detail_id").alias("hi"))
    order = Window.partitionBy("seed", "top").orderBy("_range")
    ends = ends.select("seed", "top", "lo", "hi", F.lag("hi", 1, 0).over(order).alias("earlier"), F.lead("lo").over(order).alias("later"))
    between = ends.select("seed", "top", F.col("earlier").alias("before"), F.col("lo").alias("after"))
    behind = ends.where("later IS NULL").select("seed", "top", F.col("hi").alias("before"), (F.col("top") + 1).alias("after"))
    whole = short.join(ids.select("seed").distinct(), "seed", "left_anti").select("seed", "top", F.lit(0).alias("before"), (F.col("top") + 1).alias("after"))
    gaps = near.unionByName(between).unionByName(behind).unionByName(whole)
    return gaps.select("seed", (F.col("before") + 1).alias("first"), F.least(F.col("after") - 1, "top").alias("last")).where("first <= last")


#: Longest category id that a mention is compared with.
CATEGORY_ID_CHARS = 64


def scan_readmitted(scanned: DataFrame, seeds: DataFrame, details: DataFrame) -> DataFrame:
    """(seed, detail_id, url): scanned pages that name their seed's category and were not known before.

    ``scanned``: ``detail_id, url, html``; ``seeds``: ``seed, cat_id``;
    ``details``: ``seed, detail_id``.  A page names a category if the category's
    id stands behind ``cat_id=``, whatever follows.  The beginnings of what
    stands there, at the lengths that category ids have, are keys; they leave
    the page's row, its text does not.
    """
    wanted = seeds.where("cat_id <> ''").select("seed", F.lower("cat_id").alias("cat_key")).distinct()
    longest = f"(?i)news\\.php\\?cat_id=(?=([\\s\\S]{{0,{CATEGORY_ID_CHARS}}}))"
    lengths = wanted.agg(F.collect_set(F.char_length("cat_key"))).first()[0]  # at most CATEGORY_ID_CHARS numbers count
    if any(n > CATEGORY_ID_CHARS for n in lengths):
        raise ValueError(f"category ids of more than {CATEGORY_ID_CHARS} characters")
    named = F.transform(F.regexp_extract_all("html", F.lit(longest), F.lit(1)), lambda m: F.lower(m))
    keys = F.array_distinct(F.flatten(F.transform(named, lambda m: F.array(*[F.substring(m, 1, n) for n in sorted(lengths)])))) if lengths else F.array().cast("array<string>")
    rows = scanned.select("detail_id", "url", F.explode(keys).alias("cat_key"))
    hits = rows.join(wanted, "cat_key").select("seed", "detail_id", "url").distinct()
    return hits.join(details.select("seed", "detail_id").distinct(), ["seed", "detail_id"], "left_anti")


def missing_files(recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """Share of recorded paths that still exist, per table."""
    paths = recorded.where("local_path IS NOT NULL AND local_path <> ''")
    present = listing.select("local_path").distinct().withColumn("_there", F.lit(True))
    counted = paths.join(present, "local_path", "left").groupBy("table_name").agg(
        F.count("*").alias("checked"), F.count_if(F.col("_there").isNull()).alias("missing")
    )
    intact = F.round(100 * (F.col("checked") - F.col("missing")) / F.col("checked"))
    return counted.withColumn("pct_intact", intact.cast("int"))


