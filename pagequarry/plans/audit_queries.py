"""Queries over audit rows and the file index."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.operators import audit as A
from pagequarry.operators import file_index as X
from pagequarry.operators import policy as P
from pagequarry.plans import duck as D
from pagequarry.plans import views as V
from pagequarry.plans.registry import plan
from pagequarry.plans.views import Tables

c = F.col

_UNIQUE = f"""{D.AUDIT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY prio DESC, seq) AS rn, count(*) OVER (PARTITION BY file_key) AS n_references FROM audit),
uniq AS (SELECT * FROM ranked WHERE rn = 1)"""
_FAILED = D.words(A.FAILED)
_STATUSES = [
    "downloaded", "already_exists", "not_found", "forbidden", "unauthorized", "rate_limited", "server_error", "timeout",
    "network_error", "invalid_content", "empty_file", "skipped_external", "referenced_embed", "referenced_stream",
]
_MEASURES = (
    "CAST(sum(n_references) AS BIGINT) AS total_references, count(*) AS unique_files, "
    "count(*) FILTER (status IN ('downloaded', 'already_exists')) AS downloadable, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUSES)
    + f", count(*) FILTER (status IN ('referenced_embed', 'referenced_stream')) AS referenced, count(*) FILTER (status IN {_FAILED}) AS failed, "
    "CAST(sum(n_references) - count(*) AS BIGINT) AS duplicate_references"
)


@plan(f"WITH {_UNIQUE} SELECT file_key, n_references, seq, run_id, section_key, file_url, status, error_message FROM uniq")
def audit_unique(t: Tables):
    """One record per file: best status, first on ties."""
    return A.unique_files(t.audit).select("file_key", "n_references", "seq", "run_id", "section_key", "file_url", "status", "error_message")


@plan(f"WITH {_UNIQUE} SELECT {_MEASURES} FROM uniq")
def audit_summary(t: Tables):
    """The audit measures over all unique files."""
    return A.audit_summary(t.audit)


@plan(f"WITH {_UNIQUE} SELECT status, count(*) AS n FROM uniq GROUP BY status")
def audit_by_status(t: Tables):
    """Unique files per status."""
    return A.status_histogram(t.audit)


@plan(f"""WITH {D.AUDIT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, section_key, file_key ORDER BY prio DESC, seq) AS rn,
  count(*) OVER (PARTITION BY run_id, section_key, file_key) AS n_references FROM audit),
m AS (SELECT run_id, section_key, {_MEASURES} FROM ranked WHERE rn = 1 GROUP BY run_id, section_key),
s AS (SELECT run_id, section_key, count(*) AS rows, count(*) FILTER (status IN ('downloaded', 'already_exists')) AS saved_rows FROM audit GROUP BY run_id, section_key)
SELECT m.*, s.rows, s.saved_rows, '{fv.SECTION_LABEL_DEFAULT}' AS section_label FROM m JOIN s USING (run_id, section_key)""")
def section_summary(t: Tables):
    """Audit measures per run and section, deduplicated inside the section."""
    return A.section_summary(t.audit)


@plan(f"""WITH {D.AUDIT}, e AS (SELECT {D.host('file_url')} AS host, TRY_CAST({D.extract('error_message', 'HTTP +([0-9]{3})')} AS INT) AS code, error_message AS msg FROM audit WHERE error_message IS NOT NULL)
SELECT host, CASE WHEN code IN (404, 410) THEN 'not_found' WHEN code = 403 THEN 'forbidden' WHEN code = 401 THEN 'unauthorized' WHEN code = 429 THEN 'rate_limited'
  WHEN code >= 500 THEN 'server_error' WHEN {D.rx('msg', fv.TIMEOUT_MESSAGE)} THEN 'timeout' WHEN {D.rx('msg', fv.NETWORK_MESSAGE)} THEN 'network_error' ELSE 'failed' END AS status, count(*) AS n FROM e GROUP BY ALL""")
def error_classes(t: Tables):
    """Failures per host and class."""
    return A.error_classes(t.audit.where("error_message IS NOT NULL"))


@plan(f"WITH {_UNIQUE} SELECT seq, file_key, status, rn > 1 AS is_duplicate FROM ranked")
def duplicate_refs(t: Tables):
    """Every audit row with its duplicate flag."""
    return A.flag_duplicates(t.audit).select("seq", "file_key", "status", "is_duplicate")


@plan(f"""WITH {D.AUDIT} SELECT run_id, seq, CASE WHEN row_number() OVER (PARTITION BY run_id, file_key ORDER BY seq) > 1 THEN file_key END AS duplicate_of_url FROM audit""")
def first_mentions(t: Tables):
    """Later mentions of a file in a run point at its key."""
    return A.first_mentions(t.audit, ["run_id"]).select("run_id", "seq", "duplicate_of_url")


@plan(f"""WITH {_UNIQUE}, hit AS (SELECT * FROM ranked WHERE rn = 1 AND status = 'downloaded' AND (contains(lower(file_url), '.pdf') OR contains(lower(error_message), '.pdf')))
SELECT seq, file_url, status, error_message, (SELECT count(*) FROM hit) AS total_matched FROM hit ORDER BY seq LIMIT 50 OFFSET 5""")
def audit_search(t: Tables):
    """A page of the audit table: one status, text match, offset and limit."""
    found = P.audit_search(A.flag_duplicates(t.audit), status="downloaded", search=".PDF", offset=5, limit=50)
    return found.select("seq", "file_url", "status", "error_message", "total_matched")


# --- file index -------------------------------------------------------------------------------
@plan(f"""WITH a AS ({V.ASSETS}) SELECT sha256(content) AS sha256, count(*) AS copies, arg_min(url, seq) AS first_url, (count(*) - 1) * max(file_size) AS wasted FROM a GROUP BY 1""")
def content_duplicates(t: Tables):
    """Copies, first address and wasted bytes per content."""
    return X.content_duplicates(t.assets)


def fetched_view(t: Tables):
    """Documents as fetch results with digest and storage path."""
    seq = c("seq")
    return t.assets.select(
        "seq", "url", F.when(seq % 4 == 0, F.concat("url", F.lit("?final=1"))).otherwise(c("url")).alias("final_url"),
        F.concat(F.lit("/data/"), "site", F.lit("/"), seq.cast("string")).alias("local_path"),
        F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), "file_size", F.lit("text/plain").alias("mime_type"),
        F.lit(None).cast("timestamp_ntz").alias("added_at"),
    )


def index_view(t: Tables):
    """Three of four documents are already indexed, some under other URLs."""
    seq = c("seq")
    url = F.when(seq % 5 == 0, F.concat("url", F.lit("/old"))).otherwise(c("url"))
    return fetched_view(t).where(seq % 4 != 1).withColumn("url", url)


_FETCHED = f"""fetched AS (SELECT seq, url, CASE WHEN seq % 4 = 0 THEN url || '?final=1' ELSE url END AS final_url, '/data/' || site || '/' || seq AS local_path, sha256(content) AS sha256, file_size FROM ({V.ASSETS}) a),
idx AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN url || '/old' ELSE url END AS url, final_url, local_path, sha256, file_size FROM fetched WHERE seq % 4 <> 1),
keys0 AS (SELECT 'url' AS kind, url AS lookup, seq, local_path FROM idx UNION ALL SELECT 'url', final_url, seq, local_path FROM idx UNION ALL SELECT 'sha256', sha256, seq, local_path FROM idx),
keys AS (SELECT kind, lookup, max(seq) AS seq, arg_max(local_path, seq) AS local_path FROM keys0 GROUP BY kind, lookup)"""


@plan(f"WITH {_FETCHED} SELECT kind, lookup, seq, local_path FROM keys")
def index_latest(t: Tables):
    """The record each index key resolves to."""
    return X.latest_index(index_view(t)).select("kind", "lookup", "seq", "local_path")


@plan(f"""WITH {_FETCHED} SELECT f.seq, coalesce(a.local_path, b.local_path, d.local_path) AS stored_path,
  CASE WHEN a.seq IS NOT NULL THEN 'url' WHEN b.seq IS NOT NULL THEN 'final_url' WHEN d.seq IS NOT NULL THEN 'sha256' END AS found_by,
  CASE WHEN coalesce(a.seq, b.seq, d.seq) IS NULL THEN 'downloaded' ELSE 'already_exists' END AS status
FROM fetched f LEFT JOIN keys a ON a.kind = 'url' AND a.lookup = f.url LEFT JOIN keys b ON b.kind = 'url' AND b.lookup = f.final_url LEFT JOIN keys d ON d.kind = 'sha256' AND d.lookup = f.sha256""")
def index_lookup(t: Tables):
    """Fetch results against the index: URL, final URL, digest."""
    return X.index_lookup(fetched_view(t), index_view(t)).select("seq", "stored_path", "found_by", "status")


@plan(f"""WITH a AS ({V.ALBUM}) SELECT a.album_id, a.pos, a.image_name, f.full_name, f.full_name IS NULL AS keep FROM a LEFT JOIN
  (SELECT album_id, lower(image_name) AS stem, arg_min(image_name, pos) AS full_name FROM a GROUP BY ALL) f
  ON f.album_id = a.album_id AND starts_with(a.image_name, 't_') AND f.stem = substr(a.image_name, 3)""")
def thumb_pairs(t: Tables):
    """Thumbnails with their full-size partner in the album."""
    return X.thumbnail_pairs(t.album)


@plan(f"""WITH {D.AUDIT}, bad AS (SELECT run_id, file_key, min(seq) AS bad_seq FROM audit WHERE status = 'invalid_content' GROUP BY ALL)
SELECT a.seq, CASE WHEN a.seq > b.bad_seq THEN 'invalid_content' ELSE a.status END AS status, coalesce(a.seq > b.bad_seq, false) AS suppressed FROM audit a LEFT JOIN bad b USING (run_id, file_key)""")
def bad_url_suppression(t: Tables):
    """Mentions after an HTML answer are not fetched again in the run."""
    return X.suppress_known_bad(t.audit).select("seq", "status", "suppressed")


_CACHED = f"""tgt AS (SELECT event_id AS target_id, 'https://h' || (user_id % 10) || '.example.org/img/' || (user_id % 50) || '/p' || (event_id % 40) || '.jpg?v=' || (event_id % 3) AS href FROM events),
cache AS (SELECT event_id AS cache_seq, 'https://h' || (user_id % 7) || '.example.org/img/' || (user_id % 9) || '/p' || (event_id % 30) || '.jpg?v=' || (event_id % 2) AS href FROM events WHERE event_type = 'view')"""


@plan(f"""WITH {_CACHED}, pq AS (SELECT *, {D.extract('href', '^https?://[^/]*(.*)$')} AS k FROM cache), nm AS (SELECT *, {D.extract('href', '/([^/?]*)[?]')} AS k FROM cache),
 e AS (SELECT href, min(cache_seq) AS s FROM cache GROUP BY 1), p AS (SELECT k, min(cache_seq) AS s FROM pq GROUP BY 1), n AS (SELECT k, min(cache_seq) AS s FROM nm GROUP BY 1)
SELECT t.target_id, t.href, coalesce(e.s, least(p.s, n.s)) AS cache_seq, CASE WHEN e.s IS NOT NULL THEN 1 WHEN p.s IS NOT NULL AND coalesce(n.s, p.s) >= p.s THEN 2 WHEN n.s IS NOT NULL THEN 3 END AS tier
FROM tgt t LEFT JOIN e ON e.href = t.href LEFT JOIN p ON p.k = {D.extract('t.href', '^https?://[^/]*(.*)$')} LEFT JOIN n ON n.k = {D.extract('t.href', '/([^/?]*)[?]')}""")
def tiered_match(t: Tables):
    """Best cached asset per target: URL, path and query, file name."""
    e = t.table("events")

    def href(host_mod: int, dir_mod: int, name_mod: int, v_mod: int):
        return F.concat(
            F.lit("https://h"), (c("user_id") % host_mod).cast("string"), F.lit(".example.org/img/"), (c("user_id") % dir_mod).cast("string"),
            F.lit("/p"), (c("event_id") % name_mod).cast("string"), F.lit(".jpg?v="), (c("event_id") % v_mod).cast("string"),
        ).alias("href")

    targets = e.select(c("event_id").alias("target_id"), href(10, 50, 40, 3))
    cached = e.where("event_type = 'view'").select(c("event_id").alias("cache_seq"), href(7, 9, 30, 2))
    return X.tiered_match(targets, cached)


@plan(f"""WITH a AS ({V.ALBUM}), cand AS (SELECT album_id, pos, 'https://a.example.org/' || image_name || CASE WHEN pos % 3 = 0 THEN '#x' ELSE '' END AS href FROM a),
 seen AS (SELECT DISTINCT album_id, 'https://a.example.org/' || image_name AS k FROM a WHERE pos % 2 = 1 AND album_id % 3 = 0),
 k AS (SELECT *, {D.drop_fragment('href')} AS k FROM cand)
SELECT k.album_id, min(pos) AS pos, arg_min(href, pos) AS href FROM k ANTI JOIN seen s ON s.album_id = k.album_id AND s.k = k.k GROUP BY k.album_id, k.k""")
def uncaptured_images(t: Tables):
    """Album images of the HTML that rendering did not capture."""
    url = F.concat(F.lit("https://a.example.org/"), "image_name")
    cand = t.album.select("album_id", "pos", F.concat(url, F.when(c("pos") % 3 == 0, "#x").otherwise("")).alias("href"))
    seen = t.album.where("pos % 2 = 1 AND album_id % 3 = 0").select("album_id", url.alias("href"))
    return X.uncaptured_images(cand, seen)


