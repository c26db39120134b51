"""Quality rules judged per host: failure rates shrunk by an empirical beta prior.

Every document is measured inside its own row with built-in functions.  A rule
is a boolean over the measures.  Failures are summed per host, the beta prior
of each rule is fitted to the hosts' rates by moments, and a host whose shrunk
rate of any rule exceeds the limit loses its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.shared import SPACE_CHARS, SPACE_CLASS, bound, written

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A host goes when the shrunk failure rate of a rule is above this.
HOST_LIMIT = 0.5

RULES = {
    "base": lambda: F.col("base_failed"),
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("word_chars"),
    "lines": lambda: F.col("n_dup_lines") * 5 > F.col("n_words"),
}


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_CLASS + "+", -1))


def _covered(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice; equal hashes are compared as text."""
    gram = lambda i: F.concat_ws(" ", F.slice(words, i + 1, WINDOW))
    windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), gram(i).alias("g"), i.alias("i"))))

    def starts(w: Column) -> Column:
        same = lambda a, b: (F.get(w, a)["h"] == F.get(w, b)["h"]) & (F.get(w, a)["g"] == F.get(w, b)["g"])
        twice = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1),
            lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda k: F.get(w, k)["i"]))

    def length(s: Column) -> Column:
        reach = lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)))
        return F.aggregate(F.transform(s, reach), F.lit(0), lambda total, x: total + x)

    return bound(windows, lambda w: bound(starts(w), length))


def _repeat_words(words: Column) -> Column:
    def hashes() -> Column:
        at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(words, h))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(bound(hashes(), counted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    )
    has_word = F.filter(F.split("body", "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    found = base.select(
        "doc_id", "host",
        bound(
            _words(F.col("body")),
            lambda w: F.struct(
                F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")
            ),
        ).alias("m"),
        (F.length("body") - F.length(F.regexp_replace("body", "[#*$%&|<>]+", ""))).alias("n_symbols"),
        bound(has_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
    )
    whole = found.select(
        "doc_id", "host",
        *[F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in ("m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return whole.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, worst_rate, host_failed: one row per host of ``measures``.

    The prior of a rule has the mean of the hosts' rates and the strength
    mean * (1 - mean) / variance - 1, at least 1; without variance (one host,
    equal rates) the strength is the number of documents of an average host.
    """
    names = list(RULES)
    per_host = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(RULES[r]().cast("long")).alias(f"f_{r}") for r in names]
    )
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in names}
    # one row of moments, whatever the number of hosts
    prior = per_host.agg(
        F.avg("n_docs").alias("docs"),
        *[F.avg(F.col(f"f_{r}") / F.col("n_docs")).alias(f"mean_{r}") for r in names],
        *[F.var_samp(F.col(f"f_{r}") / F.col("n_docs")).alias(f"var_{r}") for r in names],
    ).first()

    def shrunk(r: str) -> Column:
        mean, var = prior[f"mean_{r}"] or 0.0, prior[f"var_{r}"] or 0.0
        strength = max(1.0, mean * (1 - mean) / var - 1) if var > 0 else prior["docs"] or 1.0
        return (F.col(f"f_{r}") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))

    judged = per_host.withColumn("worst_rate", F.greatest(*[shrunk(r) for r in names]))
    return judged.select("host", "n_docs", "worst_rate", (F.col("worst_rate") > limit).alias("host_failed"))


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    One row per row of ``docs``.  A null or empty text has no words and fails;
    a null host is a host of its own; repeated rows are judged like others; an
    empty table gives no rows; other columns are ignored.
    """
    measured = written(measures(docs, id_col, text_col, host_col), "measures")
    hosts = host_verdicts(measured, limit).select(F.col("host").alias("judged_host"), "worst_rate", "host_failed")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("judged_host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), F.col("worst_rate").alias("host_rate"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, source, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, sum(reach) AS n FROM (
        SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS reach FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, sum(CAST(base_failed AS BIGINT)) AS f1,
        sum(CAST(n_symbols * 10 > word_chars AS BIGINT)) AS f2, sum(CAST(n_dup_lines * 5 > n_words AS BIGINT)) AS f3
      FROM b GROUP BY source),
p AS (SELECT avg(n_docs) AS nd, avg(f1 / n_docs) AS m1, avg(f2 / n_docs) AS m2, avg(f3 / n_docs) AS m3,
        coalesce(var_samp(f1 / n_docs), 0) AS v1, coalesce(var_samp(f2 / n_docs), 0) AS v2, coalesce(var_samp(f3 / n_docs), 0) AS v3 FROM h),
s AS (SELECT *, CASE WHEN v1 > 0 THEN greatest(1, m1 * (1 - m1) / v1 - 1) ELSE nd END AS s1,
        CASE WHEN v2 > 0 THEN greatest(1, m2 * (1 - m2) / v2 - 1) ELSE nd END AS s2,
        CASE WHEN v3 > 0 THEN greatest(1, m3 * (1 - m3) / v3 - 1) ELSE nd END AS s3 FROM p),
j AS (SELECT source, greatest((f1 + s1 * m1) / (n_docs + s1), (f2 + s2 * m2) / (n_docs + s2), (f3 + s3 * m3) / (n_docs + s3)) AS rate FROM h, s)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source
"""
