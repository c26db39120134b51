"""Host names of all scripts: ASCII forms of labels, short forms of IPv6 addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of the ASCII form of international labels (fixed values).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: A label has at most 63 characters; a number of that range has at most this many digits and halvings.
MOST_DIGITS, MOST_HALVINGS = 8, 6


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _number(delta: Column, bias: Column) -> Column:
    """``delta`` in digits of falling weight; each digit's threshold follows from its place and ``bias``."""
    start = F.struct(delta.alias("rest"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def digit(s: Column, place: Column) -> Column:
        least = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), place * BASE - bias)).cast("bigint")
        last = s["rest"] < least
        value = F.when(last, s["rest"]).otherwise(least + (s["rest"] - least) % (BASE - least))
        return F.when(s["done"], s).otherwise(
            F.struct(
                _div(F.greatest(s["rest"] - least, F.lit(0).cast("bigint")), BASE - least).alias("rest"),
                F.concat(s["out"], F.substring(F.lit(DIGITS), value.cast("int") + 1, F.lit(1))).alias("out"), last.alias("done"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), start, digit, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias behind a number: how large numbers have been."""
    small = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    start = F.struct((small + _div(small, points)).alias("d"), F.lit(0).cast("bigint").alias("k"))
    limit = ((BASE - T_MIN) * T_MAX) // 2
    halved = lambda s: F.struct(_div(s["d"], BASE - T_MIN).alias("d"), (s["k"] + BASE).alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_HALVINGS)), start, lambda s, _: F.when(s["d"] > limit, halved(s)).otherwise(s),
        lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW),
    )


def ascii_label(label: Column) -> Column:
    """The ASCII form of a lower-cased label; labels of ASCII letters stay.

    The other characters are taken by code and place.  Each is told by how far
    it lies, in steps over codes and places, behind the one before; the steps
    are a fold over the sorted characters.
    """
    chars = F.filter(F.split(label, ""), lambda c: c != "")
    coded = F.transform(chars, lambda c, i: F.struct(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint").alias("code"), i.alias("at")))
    basic = F.array_join(F.filter(chars, lambda c: F.octet_length(c) == 1), "")
    late = F.array_sort(F.filter(coded, lambda c: c["code"] >= FIRST_CODE))
    n_basic = F.char_length(basic).cast("bigint")
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit(FIRST_CODE).cast("bigint").alias("code"), zero.alias("at"), zero.alias("n"), F.lit(FIRST_BIAS).cast("bigint").alias("bias"), F.lit("").alias("out")
    )

    def step(s: Column, c: Column) -> Column:
        points = n_basic + s["n"] + 1
        # where it goes in: behind all earlier characters that are there by now
        place = F.size(F.filter(coded, lambda o: (o["at"] < c["at"]) & (o["code"] <= c["code"]))).cast("bigint")
        delta = (c["code"] - s["code"]) * points + place - s["at"]
        return F.struct(
            c["code"].alias("code"), (place + 1).alias("at"), (s["n"] + 1).alias("n"), _adapted(delta, points, s["n"] == 0).alias("bias"),
            F.concat(s["out"], _number(delta, s["bias"])).alias("out"),
        )

    folded = F.aggregate(late, start, step, lambda s: s["out"])
    return F.when(F.octet_length(label) == F.char_length(label), label).otherwise(
        F.concat(F.lit("xn--"), F.when(basic != "", F.concat(basic, F.lit("-"))).otherwise(""), folded)
    )


def _short_ipv6(inner: Column) -> Column:
    """Eight groups without leading zeros, the first longest run of two or more zero groups as ``::``."""
    halves = F.split(inner, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    missing = 8 - F.size(groups(0)) - F.size(groups(1))
    full = F.when(F.size(halves) == 2, F.concat(groups(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), groups(1))).otherwise(groups(0))
    bare = F.array_join(F.transform(full, lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":")
    runs = F.array(*[
        F.struct(F.lit(n).alias("n"), (-F.lit(at)).alias("at"), F.lit(":".join(["0"] * n)).alias("run")) for n in range(8, 1, -1) for at in range(9 - n)
    ])
    parts = F.split(bare, ":")
    fits = F.filter(runs, lambda r: F.array_join(F.slice(parts, 1 - r["at"], r["n"]), ":") == r["run"])
    longest = F.array_max(fits)
    cut = F.concat(
        F.array_join(F.slice(parts, F.lit(1), -longest["at"]), ":"), F.lit("::"), F.array_join(F.slice(parts, 1 - longest["at"] + longest["n"], F.lit(8)), ":")
    )
    valid = inner.rlike("^[0-9A-Fa-f:]+$") & (F.size(full) == 8)
    return F.when(valid, F.when(F.size(fits) > 0, cut).otherwise(bare))


def ascii_host(host: Column) -> Column:
    """A host as it is sent: lower case, ASCII labels, short IPv6 in brackets; NULL for a broken IPv6 address.

    All four dots of the standard part labels.  Characters are taken as they
    are composed.
    """
    low = F.lower(F.regexp_replace(host, "[。．｡]", "."))
    labels = F.transform(F.split(low, r"\."), ascii_label)
    inner = _short_ipv6(F.regexp_extract(low, r"^\[(.*)\]$", 1))
    return F.when(low.startswith("["), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.array_join(labels, "."))
