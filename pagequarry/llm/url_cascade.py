"""URL filter: host rules, then exact membership through a Bloom filter cascade.

Level 1 encodes the listed keys.  Its false positives among all keys of the
corpus are encoded in level 2, the listed keys that level 2 wrongly hits in
level 3, and so on until a level makes no mistake.  A key of the corpus is
listed exactly when the first level that misses it is an even one, so rows are
judged without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.shared import ship, written

#: (verdict, host, path); a rule fits its host, all subdomains and paths below.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Error rate of a level; a level has 1.44 * log2(1 / rate) bits for each key.
ERROR_RATE = 1 / 64
#: Broadcast filters up to this size; above it membership is an equi-join.
MAX_FILTER_BYTES = 64 << 20
#: A host is listed when this share of its pages carries campaign parameters.
CAMPAIGN_PERCENT = 15

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none; ties go to the first in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


@dataclass
class Cascade:
    """Bit arrays of the levels; level ``i`` has ``bits[i]`` bits."""

    hashes: int
    bits: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)

    @property
    def n_bytes(self) -> int:
        return sum(w.nbytes for w in self.words)


def _pair(key: Column, level: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))]


def _positions(a: np.ndarray, b: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    a, b = a.astype(np.uint64), b.astype(np.uint64) | np.uint64(1)
    for i in range(hashes):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


def _hits(cascade: Cascade, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words, found = cascade.words[level], np.ones(len(a), dtype=bool)
    for at in _positions(a, b, cascade.bits[level], cascade.hashes):
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _encode(keys: DataFrame, cascade: Cascade, level: int, n: int, error: float) -> None:
    """Append the level's filter over ``keys``; only distinct set words reach the driver."""
    bits = max(64, math.ceil(n * 1.4427 * math.log2(1 / error) / 64) * 64)

    def set_bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.concatenate(list(_positions(frame["a"].to_numpy(), frame["b"].to_numpy(), bits, hashes)))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0]) if len(word) else []
            if len(word):
                yield pd.DataFrame({"word": word[order][first], "mask": np.bitwise_or.reduceat(bit[order], first).view(np.int64)})

    hashes = cascade.hashes
    a, b = _pair(F.col("key"), level)
    merged = (
        keys.select(a.alias("a"), b.alias("b")).mapInPandas(set_bits, "word long, mask long")
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    )
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[merged["word"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    cascade.bits.append(bits)
    cascade.words.append(words)


def build_cascade(
    universe: DataFrame, error: float = ERROR_RATE, max_bytes: int = MAX_FILTER_BYTES,
) -> Cascade | None:
    """The cascade over ``universe`` (key, listed), keys distinct; None if it outgrows ``max_bytes``.

    The size is known from the count of a level's keys before it is built.
    """
    spark = universe.sparkSession
    cascade = Cascade(hashes=max(1, round(math.log2(1 / error))))
    mine, others = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key")
    level, n = 0, mine.count()
    while n:
        if cascade.n_bytes + n * 1.4427 * math.log2(1 / error) / 8 > max_bytes:
            return None
        _encode(mine, cascade, level, n, error)
        shared = spark.sparkContext.broadcast(cascade)

        def wrong(frames: Iterator[pd.DataFrame], level: int = level, shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.loc[_hits(shared.value, level, frame["a"].to_numpy(), frame["b"].to_numpy()), ["key"]]

        a, b = _pair(F.col("key"), level)
        mistakes = written(others.select("key", a.alias("a"), b.alias("b")).mapInPandas(wrong, "key string"), "cascade")
        mine, others = mistakes, mine
        level, n = level + 1, mistakes.count()
    return cascade


def is_listed(rows: DataFrame, key: str, cascade: Cascade) -> DataFrame:
    """``rows`` with boolean ``listed``; exact for keys of the universe."""
    levels = len(cascade.bits)
    if not levels:
        return rows.withColumn("listed", F.lit(False))
    shared = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def member(pairs: pd.DataFrame) -> pd.Series:
        found = np.full(len(pairs), levels)
        for level in reversed(range(levels)):
            a, b = pairs.iloc[:, 2 * level].to_numpy(), pairs.iloc[:, 2 * level + 1].to_numpy()
            found[~_hits(shared.value, level, a, b)] = level
        return pd.Series(found % 2 == 1)

    hashed = F.struct(*[c.alias(f"h{2 * i + j}") for i in range(levels) for j, c in enumerate(_pair(F.col(key), i))])
    return rows.withColumn("listed", member(hashed))


def listed_hosts(pages: DataFrame, percent: int = CAMPAIGN_PERCENT, url_col: str = "url") -> DataFrame:
    """(key, listed) of every distinct host; listed where enough pages carry ``utm_`` parameters."""
    host, _ = host_and_path(F.col(url_col))
    tagged = F.coalesce(F.instr(F.col(url_col), "utm_") > 0, F.lit(False)).cast("long")
    counts = pages.select(host.alias("key"), tagged.alias("tagged")).groupBy("key").agg(
        F.sum("tagged").alias("tagged"), F.count(F.lit(1)).alias("n")
    )
    return counts.select("key", (100 * F.col("tagged") >= percent * F.col("n")).alias("listed"))


def judged_urls(
    pages: DataFrame, universe: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url",
    max_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages``.

    ``universe`` has (key, listed) for every host of the corpus, by default
    from ``listed_hosts``.  A rule's verdict goes before the list's.  A null
    url, or one without ``://``, has empty host and path and is judged as the
    host "".  An empty table gives no rows; other columns are ignored.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = written(listed_hosts(pages, url_col=url_col) if universe is None else universe, "hosts")
    cascade = build_cascade(known, max_bytes=max_bytes)
    if cascade is not None:
        found = is_listed(rows, "host", cascade)
    else:
        listed = known.where("listed").select(F.col("key").alias("_key"))
        found = rows.join(listed, F.col("host") == F.col("_key"), "left").withColumn("listed", F.col("_key").isNotNull())
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (
  SELECT host, 100 * sum(CASE WHEN contains(url, 'utm_') THEN 1 ELSE 0 END) >= 15 * count(*) AS listed FROM p GROUP BY host),
r AS (
  SELECT page_id, p.host, path, listed,
    CASE WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN l ON p.host = l.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
