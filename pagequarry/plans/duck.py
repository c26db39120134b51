"""Building blocks of the DuckDB check queries.

The checks restate each job in plain SQL for the URL shapes the benchmark
tables contain; they share the view text and nothing else with the jobs.
"""

from __future__ import annotations

from pagequarry import fixed_values as fv
from pagequarry.plans import views as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(value: str, pattern: str) -> str:
    """Case-insensitive partial match, false on NULL."""
    return f"coalesce(regexp_matches({value}, {lit(pattern)}, 'i'), false)"


def extract(value: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"regexp_extract({value}, {lit(pattern)}, {group}, {lit(flags)})"


def extract_all(value: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({value}, {lit(pattern)}, {group}, 'i')"


def sub(value: str, pattern: str, to: str, flags: str = "gi") -> str:
    return f"regexp_replace({value}, {lit(pattern)}, {lit(to)}, {lit(flags)})"


def words(names: list[str]) -> str:
    return "(" + ", ".join(lit(n) for n in names) + ")"


VALUE = r"""\s*=\s*(?:"[^"]+"|'[^']+'|[^\s>]+)"""


def unquote(m: str) -> str:
    return sub(sub(m, r"^[^=]*=\s*", "", "i"), """^(?:"([^"]+)"|'([^']+)')$""", r"\1\2", "i")


def decode(x: str) -> str:
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")]:
        x = sub(x, f"&{name};", char)
    return x


SPACE = r"[\s\x{00a0}\x{feff}]+"


def squeeze(x: str) -> str:
    return f"trim({sub(x, SPACE, ' ')})"


def clean(x: str) -> str:
    x = sub(sub(decode(x), r"<script[\s\S]*?</script>", " "), r"<style[\s\S]*?</style>", " ")
    return squeeze(sub(x, "<[^>]+>", " "))


def ascii_only(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ''), "
        "lambda ch: CASE WHEN unicode(ch) > 127 THEN url_encode(ch) ELSE ch END), '')"
    )


def origin(u: str) -> str:
    return extract(u, "^(https?://[^/?#]*)")


def host(u: str) -> str:
    return extract(u, "^https?://([^/?#:]*)")


def site(u: str) -> str:
    return sub(f"lower({host(u)})", r"^www\.", "", "i")


def path(u: str) -> str:
    return extract(u, "^https?://[^/?#]*([^?#]*)")


def query(u: str) -> str:
    return extract(u, r"^[^?#]*\?([^#]*)")


def resolve(ref: str, base: str) -> str:
    return ascii_only(
        f"(CASE WHEN {rx(ref, '^https?://')} THEN {ref} WHEN starts_with({ref}, '/') THEN {origin(base)} || {ref} "
        f"WHEN starts_with({ref}, '?') THEN {sub(base, '[?#].*$', '', 'i')} || {ref} END)"
    )


def drop_fragment(u: str) -> str:
    return sub(u, "#.*$", "", "i")


def pairs(u: str) -> str:
    return f"list_filter(string_split({query(u)}, '&'), lambda kv: kv <> '')"


def key_of(kv: str) -> str:
    return f"lower(split_part({kv}, '=', 1))"


def value_of(kv: str) -> str:
    return f"substr({kv}, strpos({kv} || '=', '=') + 1)"


def _rebuilt(u: str, kept: str) -> str:
    head = sub(u, "[?#].*$", "", "i")
    return f"({head} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def canonical(u: str) -> str:
    kept = f"list_sort(list_filter({pairs(u)}, lambda kv: {key_of('kv')} NOT IN {words(fv.TRACKERS)}))"
    return _rebuilt(u, kept)


def crawl_canonical(u: str) -> str:
    kept = f"list_filter({pairs(u)}, lambda kv: {key_of('kv')} NOT IN {words(fv.CRAWL_TRACKERS)})"
    return f"(CASE WHEN {rx(u, '^https?:')} THEN {_rebuilt(u, kept)} ELSE '' END)"


def pick(u: str, names: list[str]) -> str:
    """Value of the first listed parameter that has one, else NULL."""
    tests = ", ".join(
        f"nullif({value_of(f'list_filter({pairs(u)}, lambda kv: {key_of('kv')} = {lit(n)})[1]')}, '')" for n in names
    )
    return f"coalesce({tests})"


def asset_class(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {rx(u, ext)} THEN {lit(n)}" for n, ext, _ in fv.ASSET_CLASSES) + " ELSE 'other' END"


def public_page(u: str) -> str:
    return (
        f"(NOT {rx(u, fv.CRAWL_ASSET_EXT)} AND NOT {rx(u, fv.BLOCKED_ROUTE)} AND {rx(u, '^https?:')} "
        f"AND NOT {rx(path(u), fv.EXECUTABLE_EXT)} AND NOT {rx(u, '[?&]download(?:=|&|#|$)')})"
    )


def priority(status: str) -> str:
    return f"CASE {status} " + " ".join(f"WHEN {lit(s)} THEN {p}" for s, p, _ in fv.AUDIT_STATUSES) + " ELSE 0 END"


HTML = f"html_pages AS ({V.HTML})"
ALL_PAGES = f"{HTML}, all_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT -page_id - 1, url, html FROM html_pages)"
HREFS = (
    f"{ALL_PAGES}, raw_hrefs AS (SELECT page_id, url, unnest(list_distinct({extract_all('html', 'href' + VALUE)})) AS m FROM all_pages), "
    f"hrefs AS (SELECT DISTINCT page_id, url, {resolve(decode(unquote('m')), 'url')} AS href FROM raw_hrefs)"
)
ANCHOR = r"""<a\b[^>]*href\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s>]+))[^>]*>([\s\S]*?)</a>"""


def anchors(source: str) -> str:
    m = "m"
    raw = "coalesce(" + ", ".join(f"nullif({extract(m, ANCHOR, g)}, '')" for g in (1, 2, 3)) + ")"
    return (
        f"anchor_m AS (SELECT page_id, url, unnest({extract_all('html', ANCHOR)}) AS m, "
        f"generate_subscripts({extract_all('html', ANCHOR)}, 1) - 1 AS pos FROM {source}), "
        f"anchors AS (SELECT page_id, url, pos, {resolve(decode(raw), 'url')} AS href, {clean(extract(m, ANCHOR, 4))} AS text FROM anchor_m)"
    )


# of a page's resources those that can pass as public pages: downloads by their label, media without an extension
_DOWNLOAD = r"""<a\b([^>]*)href\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s>]+))([^>]*)>([\s\S]*?)</a>"""
_MEDIA_TAG = r"<(?:source|embed|img|iframe|video|audio|object)\b[^>]*>"
_MEDIA_EXT = "|".join([fv.MEDIA_VIDEO_EXT, fv.MEDIA_AUDIO_EXT, fv.MEDIA_IMAGE_EXT, fv.MEDIA_DOCUMENT_EXT])
_PLAYERS = "|".join([f"^{h}$" for _, hosts, _ in fv.MEDIA_PROVIDERS for h in hosts] + [f"{h}$" for _, _, ends in fv.MEDIA_PROVIDERS for h in ends])


def _resources() -> str:
    href = "coalesce(" + ", ".join(f"nullif({extract('m', _DOWNLOAD, g)}, '')" for g in (2, 3, 4)) + ")"
    label = f"concat_ws(' ', {extract('m', _DOWNLOAD, 1)}, {extract('m', _DOWNLOAD, 5)}, {clean(extract('m', _DOWNLOAD, 6))}, {href})"
    named = ", ".join(f"{{'name': {lit(n)}, 'raw': {unquote(extract('attrs', rf'\b{n}' + VALUE, 0))}}}" for n in fv.LONE_TAG_ATTRS)
    data = rf"\b(?:{'|'.join(fv.MEDIA_DATA_ATTRS)})" + VALUE
    srcset = extract("attrs", r"""\bsrcset\s*=\s*("[^"]+"|'[^']+')""")
    return (
        f"download_m AS (SELECT page_id, url, unnest({extract_all('html', _DOWNLOAD)}) AS m FROM all_pages), "
        f"media_m AS (SELECT page_id, url, unnest(list_concat({extract_all('html', r'<a\b[^>]*>[\s\S]*?</a>')}, {extract_all('html', _MEDIA_TAG)})) AS m FROM all_pages), "
        f"media_tags AS (SELECT page_id, url, lower({extract('m', '^<([a-z]+)')}) AS tag, {extract('m', r'^<[a-z]+\b([^>]*)>')} AS attrs FROM media_m), "
        f"media_refs AS (SELECT page_id, url, tag || '-' || x.name AS via, tag || ' ' || attrs AS context, x.raw AS raw "
        f"FROM (SELECT *, unnest([{named}]) AS x FROM media_tags) WHERE tag <> 'a' OR x.name IN {words(fv.PAIRED_TAG_ATTRS)} "
        f"UNION ALL SELECT page_id, url, tag || '-srcset', tag || ' ' || attrs, {extract('trim(w)', r'^(\S+)')} "
        f"FROM (SELECT *, unnest(string_split({sub(srcset, '^.|.$', '')}, ',')) AS w FROM media_tags WHERE tag <> 'a') "
        f"UNION ALL SELECT page_id, url, lower({extract('m', r'^([^\s=]+)')}), m, {unquote('m')} "
        f"FROM (SELECT page_id, url, unnest({extract_all('html', data)}) AS m FROM all_pages) "
        f"UNION ALL SELECT page_id, url, 'css-url', m, {extract('m', _CSS)} "
        f"FROM (SELECT page_id, url, unnest({extract_all('html', _CSS)}) AS m FROM all_pages)), "
        f"media_urls AS (SELECT page_id, {resolve(decode('raw'), 'url')} AS u, context, via || ' ' || context AS hint FROM media_refs WHERE raw <> ''), "
        f"resources AS (SELECT page_id, {crawl_canonical(resolve(f'trim({href})', 'url'))} AS link FROM download_m WHERE {rx(label, fv.DOWNLOAD_SIGNAL)} "
        f"UNION SELECT page_id, {crawl_canonical('u')} FROM media_urls WHERE u IS NOT NULL AND NOT {rx("u || ' ' || context", fv.MEDIA_NOISE)} "
        f"AND NOT {rx(site('u'), _PLAYERS)} AND ({rx('u', _MEDIA_EXT)} OR {rx('hint', fv.MEDIA_VIDEO_HINT)} "
        f"OR {rx("u || ' ' || hint", rf'\b(?:video|audio|image)/|{fv.MEDIA_DOCUMENT_HINT}')}))"
    )


_CSS = r"""url\(\s*["']?([^"')]+)["']?\s*\)"""
RESOURCES = _resources()

AUDIT = (
    f"audit0 AS ({V.AUDIT}), audit AS (SELECT *, {drop_fragment('trim(file_url)')} AS file_key, "
    f"{priority('status')} AS prio FROM audit0)"
)
