"""SQL-text lambdas: large, closed expressions built once per session.

Building an expression node by node costs a JVM call per node.  The builders
that occur everywhere (entity decoding, tag stripping, URL resolution, page
keys) are written as SQL text over one variable ``v`` instead, parsed once,
and applied with ``array_max(transform(array(value), v -> ...))``.  That also makes
the value computed once, however often the text mentions ``v``.  ``array_max`` of
the one result is used rather than an index because it resolves its type once,
not by walking the whole nested expression for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_PARSED: dict[tuple[str, str], Column] = {}


def quote(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def rlike(value: str, pattern: str) -> str:
    return f"({value} RLIKE {quote(pattern)})"


def replace(value: str, pattern: str, to: str) -> str:
    return f"regexp_replace({value}, {quote(pattern)}, {quote(to)})"


def extract(value: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({value}, {quote(pattern)}, {group})"


def let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``."""
    return f"array_max(transform(array({value}), {name} -> {body}))"


def strings(values: list[str]) -> str:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def lambda_text(text: str) -> Column:
    """The parsed lambda, reused within a session."""
    session = SparkSession.getActiveSession()
    key = (session.sparkContext.applicationId if session else "", text)
    if key not in _PARSED:
        _PARSED[key] = F.expr(text)
    return _PARSED[key]


def apply(body: str, value: Column) -> Column:
    """``body``, SQL text over ``v``, for this value."""
    return F.array_max(F.call_function("transform", F.array(value), lambda_text(f"v -> {body}")))


def apply_all(body: str, values: Column) -> Column:
    """``body`` for every item of an array."""
    return F.call_function("transform", values, lambda_text(f"v -> {body}"))
