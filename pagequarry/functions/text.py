"""Column builders for HTML text: entity decoding, tag stripping, trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions import sqltext as S

# Whitespace as browsers see it; Java's \s alone misses the Unicode spaces.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_AMP_HOLD = "\ue000"
_NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Nested builders that mention their input several times would otherwise
    grow exponentially once the optimizer inlines or pushes them down.
    """
    return F.array_max(F.transform(F.array(value), body))


def any_text(pattern: str) -> str:
    """The pattern with its ``[\\s\\S]*?`` spelled as Java walks through it several times faster."""
    return pattern.replace(r"[\s\S]*?", "(?s:.*?)")


def ci(pattern: str) -> str:
    """The pattern, matched without regard to case."""
    return "(?i)" + any_text(pattern)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(ci(pattern))


def _decode_sql(x: str) -> str:
    """Entities of ``x`` decoded, each once; a decoded '&' waits its turn."""
    digits = S.extract("e", "(?i)^&#x?([0-9a-f]+);$")
    code = f"if({S.rlike('e', '(?i)^&#x')}, upper({digits}), conv({digits}, 10, 16))"
    char = S.let(f"decode(unhex(lpad({code}, 8, '0')), 'UTF-32')", "c", f"if(c = '&', {S.quote(_AMP_HOLD)}, c)")
    found = f"array_distinct(regexp_extract_all(n, {S.quote(r'(?i)&#(?:x[0-9a-f]{1,5}|[0-9]{1,6});')}, 0))"
    numeric = f"if(instr(n, '&#') > 0, aggregate({found}, n, (acc, e) -> replace(acc, e, {char})), n)"
    named = "d"
    for name, text in _NAMED:
        named = S.replace(named, f"(?i)&{name};", text)
    # most texts hold no name but &amp;
    some = S.rlike("d", f"(?i)&(?:{'|'.join(name for name, _ in _NAMED)});")
    named = S.let(numeric, "d", f"if({some}, {named}, d)")
    named = f"translate({S.replace(named, '(?i)&amp;', '&')}, {S.quote(_AMP_HOLD)}, '&')"
    return S.let(x, "n", f"if(instr(n, '&') > 0, {named}, n)")


def _squeeze_sql(x: str) -> str:
    return f"trim({S.replace(x, SPACE + '+', ' ')})"


def clean_sql(x: str) -> str:
    """SQL text of ``clean_text``."""
    plain = S.replace(S.replace("d", r"(?i)<script[\s\S]*?</script>", " "), r"(?i)<style[\s\S]*?</style>", " ")
    plain = f"if({S.rlike('d', '(?i)<s(?:cript|tyle)')}, {plain}, d)"
    plain = S.let(_decode_sql(x), "d", f"if(instr(d, '<') > 0, {S.replace(plain, '<[^>]+>', ' ')}, d)")
    return f"coalesce({_squeeze_sql(plain)}, '')"


decode_sql = _decode_sql


def html_decode(c: Column) -> Column:
    """Decode numeric and the six named entities, each once."""
    return S.apply(_decode_sql("v"), c)


def squeeze(c: Column) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_scripts(c: Column) -> Column:
    c = F.regexp_replace(c, ci(r"<script[\s\S]*?</script>"), " ")
    return F.regexp_replace(c, ci(r"<style[\s\S]*?</style>"), " ")


def clean_text(c: Column) -> Column:
    """Visible text of an HTML fragment: entities first, then tags."""
    return S.apply(clean_sql("v"), c)


def letters(c: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def thai_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^ก-๙]", ""))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, ci(pattern), group), F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(ci(pattern)), F.lit(group))


def is_true_word(c: Column) -> Column:
    """Option text: anything but 0/false/no/off counts as true."""
    from pagequarry.fixed_values import FALSE_WORDS

    return ~F.lower(F.trim(c)).isin(FALSE_WORDS)


def safe_name(c: Column) -> Column:
    """A name usable as a file name, at most 180 characters."""
    c = F.regexp_replace(html_decode(c), "<[^>]+>", " ")
    c = F.regexp_replace(c, r'[/\\?%*:|"<>\x00-\x1f]', "_")
    c = F.substring(squeeze(c), 1, 180)
    return F.when(F.length(c) > 0, c).otherwise(F.lit("file"))
