"""Thai and numeric publication dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions.text import bind, ci, clean_text, squeeze


def _gregorian(year: Column) -> Column:
    return F.when(year > fv.BUDDHIST_YEAR_FROM, year - fv.BUDDHIST_YEAR_OFFSET).otherwise(year)


def _month_number(name: Column) -> Column:
    spelled = F.create_map(*[x for n, names in fv.THAI_MONTHS for s in names for x in (F.lit(s), F.lit(n))])
    return F.coalesce(spelled[name], spelled[F.replace(name, F.lit("."), F.lit(""))])


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _make(year: Column, month: Column, day: Column) -> Column:
    """A DATE, or NULL when the day does not exist."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                       F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def to_date(raw: Column) -> Column:
    """ISO, d/m/y, or '<day> <Thai month> <year>', Buddhist era included."""
    return bind(squeeze(raw), _date_in)


def _date_in(text: Column) -> Column:
    iso = r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b"
    slash = r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b"
    thai = r"([0-9]{1,2})\s*([ก-๙.]+)\s*([0-9]{2,4})"

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(text, p, i)

    slash_year = _int(g(slash, 3))
    slash_year = F.when(slash_year < 100, slash_year + 2000).otherwise(slash_year)
    thai_year = _int(g(thai, 3))
    return (
        F.when(text.rlike(iso), _make(_gregorian(_int(g(iso, 1))), _int(g(iso, 2)), _int(g(iso, 3))))
        .when(text.rlike(slash), _make(_gregorian(slash_year), _int(g(slash, 2)), _int(g(slash, 1))))
        .when(
            # two-digit years next to a month name stay undated
            thai_year >= 1000,
            _make(_gregorian(thai_year), _month_number(g(thai, 2)), _int(g(thai, 1))),
        )
    )


def to_timestamp(raw: Column) -> Column:
    """Date plus an optional HH:MM[:SS], midnight when there is no time."""
    return bind(squeeze(raw), _timestamp_in)


def _timestamp_in(text: Column) -> Column:
    iso = r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[T\s]+([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?"
    clock = r"(?i)(?:เวลา\s*)?([0-9]{1,2})[:.]([0-5][0-9])(?::([0-5][0-9]))?\s*(?:น\.?|นาฬิกา)?"

    def g(p: str, i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")), F.lit("0"))

    def stamp(day: Column, p: str, first: int) -> Column:
        hms = F.concat_ws(":", *[F.lpad(g(p, first + k), 2, "0") for k in range(3)])
        return F.concat_ws(" ", day.cast("string"), hms).try_cast("timestamp_ntz")

    iso_day = _make(_gregorian(_int(g(iso, 1))), _int(g(iso, 2)), _int(g(iso, 3)))
    from_iso = bind(iso_day, lambda d: F.when(d.isNotNull(), stamp(d, iso, 4)))
    from_text = bind(_date_in(text), lambda d: F.when(d.isNotNull(), stamp(d, clock, 1)))
    return F.when(text.rlike(iso), from_iso).otherwise(from_text)


def published_raw(c: Column) -> Column:
    """Date text after a publication label, else the first date anywhere."""
    return published_in_text(clean_text(c))


def _published(text: Column) -> Column:
    labelled = [
        F.nullif(F.regexp_extract(text, f"(?i)(?:{label})\\s*:?\\s*({fv.DATE_VALUE})", 1), F.lit(""))
        for label in fv.DATE_LABELS
    ]
    anywhere = F.nullif(F.regexp_extract(text, f"(?i)({fv.DATE_VALUE})", 1), F.lit(""))
    return squeeze(F.coalesce(*labelled, anywhere, F.lit("")))


def published_in_text(text: Column) -> Column:
    """The same for text that is already clean."""
    return bind(text, _published)


def published_text(html: Column) -> Column:
    """Publication date text of a page: metadata and labels, then any date."""

    def tidied(raw: Column) -> Column:
        # most pages have no match to tidy
        return F.when(raw != "", F.nullif(F.trim(F.regexp_replace(clean_text(raw), "::.*$", "")), F.lit("")))

    found = [bind(F.regexp_extract(html, ci(p), 1), tidied) for p in fv.PUBLISHED_PATTERNS]
    return F.coalesce(*found, F.nullif(published_raw(html), F.lit("")), F.lit(""))
