"""URL columns: resolution against a base, parts, canonical forms, parameters.

``resolve`` produces serialised URLs; every other builder here expects
such a serialised URL (lower-case scheme and host, non-empty path, percent
encoding applied), so a single simple pattern per part is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import sqltext as S
from pagequarry.functions.text import bind, ci, decode_sql

# --- parts of a serialised URL ----------------------------------------------
def scheme(u: Column) -> Column:
    return F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*):", 1)


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def site(u: Column) -> Column:
    """Host without a leading www., the unit of 'same site'."""
    return F.regexp_replace(F.lower(host(u)), r"^www\.", "")


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    """Query text without '?', empty when there is none."""
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def search(u: Column) -> Column:
    """Query text with '?', empty when there is nothing after it."""
    q = query(u)
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))


def origin(u: Column) -> Column:
    return F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def base_name(p: Column) -> Column:
    """Last path segment, ignoring trailing slashes."""
    return F.regexp_extract(p, r"([^/]*)/*$", 1)


def directory(p: Column) -> Column:
    """Path up to and including the last slash."""
    return F.regexp_extract(p, r"^(.*/)", 1)


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*https?:/*[^/?#\s]"), F.lit(False))


def decode_component(c: Column) -> Column:
    """Percent-decode, keeping '+' and leaving malformed text alone."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


# --- resolution ---------------------------------------------------------------
_SEP = "\x1f"
_FRAGMENT = r"#[\s\S]*$"
# (pattern over "<base><SEP><reference>", replacement); the first that fits
# consumes the separator, so at most one applies
_JOIN_RULES = [
    (rf"(?i)^[^{_SEP}]*{_SEP}(https?):[\\/]*", "$1://"),
    (rf"(?i)^[^{_SEP}]*{_SEP}([a-z][a-z0-9+.-]*:)", "$1"),
    (rf"(?i)^(https?):[^{_SEP}]*{_SEP}[\\/]{{2,}}", "$1://"),
    (rf"(?i)^(https?://[^/?#{_SEP}]*)[^{_SEP}]*{_SEP}[\\/]", "$1/"),
    (rf"^([^?#{_SEP}]*)[^{_SEP}]*{_SEP}\?", "$1?"),
    (rf"^([^#{_SEP}]*)(?:#[^{_SEP}]*)?{_SEP}(#|$)", "$1$2"),
    (rf"(?i)^(https?://[^/?#{_SEP}]*/(?:[^?#{_SEP}]*/)?)[^{_SEP}]*{_SEP}", "$1"),
    (rf"(?i)^(https?://[^/?#{_SEP}]*)[^{_SEP}]*{_SEP}", "$1/"),
]
_VALID_ORIGIN = r"^https?://(?:[^/?#@]*@)?[^\s<>^|%\[\]\\:@]+(?::[0-9]+)?$"


def _encode_sql(x: str) -> str:
    """Percent-encode what a path, query and fragment cannot hold."""
    unsafe = "t"
    for char, escape in [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E")]:
        unsafe = f"replace({unsafe}, {S.quote(char)}, {S.quote(escape)})"
    for char, escape in [("`", "%60"), ("\\{", "%7B"), ("\\}", "%7D"), ("\\^", "%5E")]:
        # path only: the match may not run past '?' or '#'
        unsafe = S.replace(unsafe, rf"\G([^?#{char}]*){char}", "$1" + escape)
    plain = S.let(x, "t", f"if({S.rlike('t', '[ \"<>`{}^]')}, {unsafe}, t)")
    q = S.extract("t", r"^[^?#]*(\?[^#]*)")
    quotes = (
        f"concat({S.extract('t', '^([^?#]*)')}, replace({q}, {S.quote("'")}, '%27'), "
        f"{S.extract('t', r'^[^#]*(#[\s\S]*)$')})"
    )
    quoted = S.let(plain, "t", f"if(instr({q}, {S.quote("'")}) > 0, {quotes}, t)")
    runs = f"regexp_extract_all(t, {S.quote(r'[^\x00-\x7f]+')}, 0)"
    longest = f"array_sort(array_distinct({runs}), (a, b) -> length(b) - length(a))"
    encoded = f"aggregate({longest}, t, (acc, r) -> replace(acc, r, url_encode(r)))"
    return S.let(quoted, "t", f"if({S.rlike('t', r'[^\x00-\x7f]')}, {encoded}, t)")


def _dots_sql(x: str) -> str:
    """Resolve '.' and '..' path segments."""
    path_text = S.replace(S.extract("t", "^([^?#]*)"), r"(?i)(/(?:\.|%2e){1,2})$", "$1/")
    step = S.let(
        S.replace("s", "(?i)%2e", "."), "d",
        "CASE WHEN d = '.' OR (d = '..' AND size(acc) <= 1) THEN acc WHEN d = '..' THEN slice(acc, 1, size(acc) - 1) ELSE concat(acc, array(s)) END",
    )
    kept = f"aggregate(split({path_text}, '/'), cast(array() AS array<string>), (acc, s) -> {step})"
    dotted = S.rlike("t", r"(?i)^[^?#]*/(?:\.|%2e){1,2}(?:[/?#]|$)")
    rest = S.extract("t", r"^[^?#]*([\s\S]*)$")
    return S.let(x, "t", f"if({dotted}, concat(array_join({kept}, '/'), {rest}), t)")


def resolve_sql(ref: str, base: str, keep_other_schemes: bool = False) -> str:
    """SQL text of ``resolve``.

    The common shapes (absolute, root-relative, query-only) are told apart by
    their first characters; only the rest goes through the pattern rules.
    """
    rules = f"concat({base}, {S.quote(_SEP)}, r)"
    for pattern, replacement in _JOIN_RULES:
        rules = S.replace(rules, pattern, replacement)
    with_path = S.replace("r", r"^(https?://[^/?#]+)(?=[?#]|$)", "$1/")
    joined = (
        f"CASE WHEN {S.rlike('r', '^https?://[^/]')} THEN {with_path} "
        f"WHEN startswith(r, '/') AND {S.rlike('r', r'^/[^/\\]')} THEN concat({S.extract(base, '^(https?://[^/?#]*)')}, r) "
        f"WHEN startswith(r, '?') AND {S.rlike(base, '^https?://[^/?#]+/')} THEN concat({S.extract(base, '^([^?#]*)')}, r) "
        f"ELSE {S.replace(rules, '(?i)^(https?://[^/?#]+)(?=[?#]|$)', '$1/')} END"
    )
    slashes = S.replace("j", r"\G([^?#\\]*)\\", "$1/")
    joined = S.let(joined, "j", f"if(instr(j, {S.quote('\\')}) > 0, {slashes}, j)")
    head = f"lower({S.extract('u', '(?i)^(https?://[^/?#]*)')})"
    ports = S.replace("h", r"^(http://[^/]*?):(?:80)?$|^(https://[^/]*?):(?:443)?$", "$1$2")
    tail = "substring(u, length(h) + 1)"
    valid = S.let(
        f"if(instr(substring(h, 8), ':') > 0, {ports}, h)", "o",
        f"if({S.rlike('o', _VALID_ORIGIN)}, concat(o, {_encode_sql(_dots_sql(tail))}), NULL)",
    )
    web = S.let(head, "h", valid)
    other = (
        f"WHEN {S.rlike('u', '(?i)^[a-z][a-z0-9+.-]*:[^' + _SEP + ']*$')} THEN "
        f"concat(lower({S.extract('u', '^([^:]*)')}), {S.extract('u', r'^[^:]*([\s\S]*)$')})"
    )
    serialised = S.let(
        joined, "u",
        f"CASE WHEN {S.rlike('u', '(?i)^https?://')} THEN {web} WHEN {S.rlike('u', '(?i)^https?:')} THEN NULL {other if keep_other_schemes else ''} END",
    )
    trimmed = S.replace("r0", r"[\t\r\n\x1f]|^[\x00-\x20]+|[\x00-\x20]+$", "")
    return S.let(S.let(ref, "r0", f"if({S.rlike('r0', r'[\x00-\x20]')}, {trimmed}, r0)"), "r", serialised)


def reference_sql(raw: str, unescape_slashes: bool = False) -> str:
    """SQL text: attribute text to a reference, one quote dropped at either end."""
    ref = S.replace(decode_sql(f"trim({raw})"), "^['\"]|['\"]$", "")
    if unescape_slashes:
        ref = f"replace({ref}, {S.quote(r'\/')}, '/')"
    return S.replace(ref, "(?i)&amp;", "&")


def resolve(ref: Column, base: Column, keep_other_schemes: bool = False) -> Column:
    """The serialised URL of ``ref`` relative to the http(s) URL ``base``.

    NULL when it is not a URL, or not http(s) unless ``keep_other_schemes``.
    """
    body = resolve_sql("v.ref", "v.base", keep_other_schemes)
    return S.apply(body, F.struct(ref.alias("ref"), base.alias("base")))


def resolved(df: DataFrame, ref: str, base: str, out: str, keep_other_schemes: bool = False) -> DataFrame:
    """Add ``out``, the URL of SQL text ``ref``; rows without one are dropped.

    The value comes out of a generator, which no filter is pushed through, so
    it is computed once per row.
    """
    value = resolve_sql(ref, base, keep_other_schemes)
    return df.selectExpr("*", f"explode(filter(array({value}), h -> h IS NOT NULL)) AS {out}")


_QUERY = r"^[^?#]*\?([^#]*)"


def _pairs_sql(u: str) -> str:
    def part(pattern: str) -> str:
        return S.let(S.extract("x", pattern), "y", "coalesce(try_url_decode(y), y)")

    both = f"named_struct('key', {part('^([^=]*)')}, 'value', {part(r'^[^=]*=([\s\S]*)$')})"
    return f"transform(filter(split({S.extract(u, _QUERY)}, '&'), x -> x <> ''), x -> {both})"


def _joined_sql(pairs: str) -> str:
    return f"array_join(transform({pairs}, p -> concat(url_encode(p.key), '=', url_encode(p.value))), '&')"


def _with_query_sql(u: str, pairs: str) -> str:
    head = S.extract(u, r"^([^?]*)")
    return S.let(_joined_sql(pairs), "q", f"if(q <> '', concat({head}, '?', q), {head})")


def param_pairs(u: Column) -> Column:
    """Query parameters in order as array<struct<key, value>>, decoded."""
    return S.apply(_pairs_sql("v"), u)


def first_params(u: Column) -> Column:
    """Parameters with lower-cased names, first occurrence of a name only."""
    named = f"transform({_pairs_sql('v')}, p -> named_struct('name', lower(p.key), 'key', p.key, 'value', p.value))"
    return S.apply(S.let(named, "ps", "filter(ps, (p, i) -> array_position(ps.name, p.name) = i + 1)"), u)


def pick_param(params: Column, names: list[str]) -> Column:
    """struct<rank, key, value> of the first listed name with a value."""
    ranked = (
        f"transform(v, p -> named_struct('rank', array_position({S.strings(names)}, p.name), 'key', p.key, 'value', p.value))"
    )
    return S.apply(f"array_min(filter({ranked}, r -> r.rank > 0 AND r.value <> ''))", params)


def category_map(params: Column) -> Column:
    """Category constraints of a URL as map<name, value>."""
    order = F.array(*[F.lit(n) for n in fv.CATEGORY_PARAMS])
    hits = F.filter(params, lambda p: F.array_contains(order, p["name"]) & (p["value"] != ""))
    return F.map_from_entries(F.transform(hits, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value"))))


def category_key(u: Column, constraints: Column) -> Column:
    """Host, path and sorted category pairs: equal for equal categories."""
    pairs = F.transform(
        F.array_sort(F.map_keys(constraints)),
        lambda k: F.concat(k, F.lit("="), F.element_at(constraints, k)),
    )
    return F.concat(site(u), F.lower(path(u)), F.lit("?"), F.array_join(pairs, "&"))


def drop_fragment(u: Column) -> Column:
    return F.regexp_replace(u, _FRAGMENT, "")


def asset_key(u: Column) -> Column:
    """Key of a file: its URL without the fragment."""
    return drop_fragment(u)


def canonical(u: Column) -> Column:
    """Page key: no fragment, no trackers, parameters sorted by name."""
    kept = f"filter({_pairs_sql('b')}, p -> NOT array_contains({S.strings(fv.TRACKERS)}, lower(p.key)))"
    ordered = (
        f"array_sort(transform({kept}, (p, i) -> named_struct('name', translate(lower(p.key), '_-', ' !'), 'at', i, "
        "'key', p.key, 'value', p.value)))"
    )
    return S.apply(S.let(S.replace("v", _FRAGMENT, ""), "b", f"if(instr(b, '?') > 0, {_with_query_sql('b', ordered)}, b)"), u)


def crawl_canonical(u: Column) -> Column:
    """Crawl key: no fragment, no trackers, parameter order kept."""
    kept = f"filter(ps, p -> NOT array_contains({S.strings(fv.CRAWL_TRACKERS)}, lower(p.key)))"
    rebuilt = S.let(
        _pairs_sql("b"), "ps", S.let(kept, "k", f"if(size(k) < size(ps), {_with_query_sql('b', 'k')}, b)")
    )
    body = f"CASE WHEN NOT {S.rlike('b', '^https?:')} THEN '' WHEN instr(b, '?') > 0 THEN {rebuilt} ELSE b END"
    return S.apply(S.let(S.replace("v", _FRAGMENT, ""), "b", body), u)


def path_and_query(u: Column) -> Column:
    """Path plus query cut to 1,024 characters."""
    return F.substring(F.concat(path(u), search(u)), 1, 1024)


def align_origin(target: Column, referer: Column) -> Column:
    """Same-site targets take scheme, host and port of the referer."""
    tail = F.regexp_extract(target, r"^[a-z][a-z0-9+.-]*://[^/?#]*([\s\S]*)$", 1)
    return F.when(site(target) == site(referer), F.concat(origin(referer), tail)).otherwise(target)


# --- derived facts -------------------------------------------------------------------
def is_link_asset(u: Column) -> Column:
    return F.concat(path(u), search(u)).rlike(ci(fv.LINK_ASSET_EXT)) | path(u).rlike(ci(fv.LINK_ASSET_PATH))


def page_number(u: Column, params: Column, names: list[str] | None = None) -> Column:
    """Listing page: a pagination parameter, else /page/N, else 1."""
    named = pick_param(params, names or fv.PAGE_PARAMS)["value"]
    in_path = F.nullif(F.regexp_extract(path(u), ci(fv.PAGE_PATH), 1), F.lit(""))
    return F.coalesce(named, in_path, F.lit("1"))


def last_segment(u: Column) -> Column:
    return base_name(path(u))


def unknown_id(params: Column, known: list[str], hex_pattern: str, skip_actions: bool) -> Column:
    """First parameter outside the known names that looks like an id."""
    ignored = F.array(*[F.lit(n) for n in known])

    def looks_like_id(p: Column) -> Column:
        ok = ~F.array_contains(ignored, p["name"]) & (p["value"] != "")
        if skip_actions:
            ok = ok & ~p["value"].rlike(ci(fv.ACTION_VALUE))
        return ok & (p["value"].rlike(fv.NUMERIC_ID) | p["value"].rlike(ci(hex_pattern)))

    return F.get(F.filter(params, looks_like_id), 0)


def record_path_token(u: Column) -> Column:
    """Last path segment when it can serve as a record id."""

    def token(last: Column) -> Column:
        usable = (
            ~last.rlike(ci(fv.GENERIC_LAST_SEGMENT))
            & ~last.rlike(ci(fv.SCRIPT_FILE))
            & last.rlike(ci(fv.PATH_TOKEN))
        )
        return F.when(usable, last)

    return bind(decode_component(last_segment(u)), token)


RECORD_KNOWN = fv.CATEGORY_PARAMS + fv.PAGE_PARAMS + fv.TRACKERS + fv.NEUTRAL_PARAMS
ALBUM_KNOWN = fv.ALBUM_ID_PARAMS + fv.ALBUM_PAGE_PARAMS + fv.TRACKERS + fv.ALBUM_NEUTRAL_PARAMS


def record_unknown_id(params: Column) -> Column:
    return unknown_id(params, RECORD_KNOWN, fv.HEX_ID, True)


def record_id(u: Column, params: Column) -> Column:
    """Record identity: known parameter, unknown id-like one, path token."""
    return F.coalesce(
        pick_param(params, fv.RECORD_ID_PARAMS)["value"], record_unknown_id(params)["value"], record_path_token(u)
    )


def record_id_source(u: Column, params: Column) -> Column:
    return F.coalesce(
        pick_param(params, fv.RECORD_ID_PARAMS)["key"],
        record_unknown_id(params)["key"],
        F.when(record_path_token(u).isNotNull(), F.lit("path")),
    )


def album_path(u: Column) -> Column:
    """Path with repeated and trailing slashes removed."""
    p = F.regexp_replace(F.regexp_replace(path(u), "/{2,}", "/"), "/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def _usable_album_token(t: Column) -> Column:
    t = F.trim(t)
    return (
        (t != "")
        & ~F.lower(t).isin(fv.ALBUM_RESERVED_SEGMENTS)
        & ~t.rlike(r"(?i)^(?:data|index|view|detail|show)(?:\.(?:php|html?|aspx?))?$")
        & t.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}_-]{0,180}$")
    )


def album_path_token(u: Column, start: Column | None = None) -> Column:
    """Album id found in the path: after detail/view/show, parent, or last."""
    found = F.transform(F.filter(F.split(album_path(u), "/"), lambda s: s != ""), decode_component)
    token = bind(found, _album_token)
    if start is None:
        return token
    start_n = F.size(F.filter(F.split(album_path(start), "/"), lambda s: s != ""))
    return F.when(F.size(found) > start_n, token)


def _album_token(segments: Column) -> Column:
    n = F.size(segments)
    last = F.element_at(segments, -1)
    after_verb = F.get(
        F.filter(
            segments,
            lambda s, i: (i > 0)
            & F.lower(F.get(segments, i - 1)).isin("detail", "view", "show")
            & _usable_album_token(s),
        ),
        0,
    )
    parent = F.when(n >= 2, F.get(segments, n - 2))
    index_file = last.rlike(r"(?i)^(?:data|index|view|detail|show)\.(?:php|html?|aspx?)$")
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(after_verb.isNotNull(), after_verb)
        .when(index_file, F.when(_usable_album_token(parent), parent))
        .when(last.rlike(r"(?i)^(?:index|view|detail|show|gallery|album|activity|activities)(?:\.php)?$"), None)
        .when(last.rlike(ci(fv.SCRIPT_FILE)), None)
        .when(F.lower(last).isin(fv.ALBUM_RESERVED_SEGMENTS), None)
        .when(last.rlike("^[0-9]+$") & (F.lower(parent) == "page"), None)
        .when(_usable_album_token(last), last)
    )


def album_unknown_id(params: Column) -> Column:
    return unknown_id(params, ALBUM_KNOWN, fv.ALBUM_HEX_ID, False)


def album_id(u: Column, params: Column, start: Column | None = None) -> Column:
    return F.coalesce(
        pick_param(params, fv.ALBUM_ID_PARAMS)["value"],
        album_unknown_id(params)["value"],
        album_path_token(u, start),
    )
