"""Tag-level views of a page: attribute values and spans between tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions import sqltext as S
from pagequarry.functions.text import all_matches, ci

VALUE = r"\s*=\s*(?:\"[^\"]+\"|'[^']+'|[^\s>]+)"
VALUE_OR_EMPTY = r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"


_ASSIGNED = r"^[^=]*=\s*([\s\S]*)$"
_QUOTED = "^(?:\"([^\"]+)\"|'([^']+)')$"


def unquote(assignment: Column) -> Column:
    """Value of ``name = value`` text, without its quotes."""
    return F.regexp_replace(F.regexp_extract(assignment, _ASSIGNED, 1), _QUOTED, "$1$2")


def unquote_sql(assignment: str) -> str:
    """SQL text of ``unquote``."""
    return S.replace(S.extract(assignment, _ASSIGNED), _QUOTED, "$1$2")


def attribute_sql(tag: str, name: str) -> str:
    """SQL text of ``attribute``."""
    found = f"nullif({S.extract(tag, ci(rf'\b{name}{VALUE}'), 0)}, '')"
    return unquote_sql(found)


def assignments(html: Column, names: list[str], boundary: bool = True) -> Column:
    """All ``name = value`` texts of the given attributes, in page order."""
    start = r"\b" if boundary else ""
    return all_matches(html, f"{start}(?:{'|'.join(names)}){VALUE}")


def attribute(tag: Column, name: str) -> Column:
    """Value of one attribute of a tag, NULL when absent or empty."""
    return S.apply(attribute_sql("v", name), tag)


def split_tags(html: Column) -> Column:
    """Page text cut at every '<'; item 0 is what precedes the first tag."""
    return F.split(html, "<")


def positions_sql(tags: str, pattern: str) -> str:
    """Indices of the items that start with the given tag pattern."""
    return f"filter(transform({tags}, (t, i) -> if({S.rlike('t', ci('^(?:' + pattern + ')'))}, i, NULL)), i -> i IS NOT NULL)"


def heads_sql(tags: str) -> str:
    """SQL text: the items' first characters in lower case; only A-Z become other letters of a tag's name."""
    return f"transform({tags}, t -> lower(replace(substring(t, 1, 10), 'İ', '_')))"


def starts_sql(heads: str, places: str, names: list[str], pattern: str | None = None, tags: str = "tags") -> str:
    """SQL text: those of the ascending ``places`` whose head starts with one of the names (and whose tag fits)."""
    test = " OR ".join(f"startswith(get({heads}, i), {S.quote(n)})" for n in names)
    fits = f" AND {S.rlike(f'get({tags}, i)', ci('^(?:' + pattern + ')'))}" if pattern else ""
    return f"filter({places}, i -> ({test}){fits})"


def _count_sql(positions: str, below: str) -> str:
    """SQL text: how many of the ascending positions are ``below`` (``<`` or ``<=``) ``q``, by halving."""
    bits = f"sequence(length(bin(size({positions}))) - 1, 0, -1)"
    return f"aggregate({bits}, 0, (n, b) -> if(coalesce(get({positions}, n + shiftleft(1, b) - 1) {below} q, false), n + shiftleft(1, b), n))"


def last_before(positions: str, at: str) -> str:
    """SQL text: the last of the ascending positions before ``at``, or NULL."""
    return S.let(at, "q", f"if(size({positions}) = 0, NULL, get({positions}, {_count_sql(positions, '<')} - 1))")


def first_after(positions: str, at: str) -> str:
    """SQL text: the first of the ascending positions after ``at``, or NULL."""
    return S.let(at, "q", f"if(q IS NULL OR size({positions}) = 0, NULL, get({positions}, {_count_sql(positions, '<=')}))")


def span(tags: str, start: str, stop: str) -> str:
    """Page text from tag ``start`` up to, not including, tag ``stop``."""
    return f"concat('<', array_join(slice({tags}, {start} + 1, greatest({stop} - {start}, 0)), '<'))"
