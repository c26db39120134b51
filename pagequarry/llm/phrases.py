"""Phrase collocations from count streams in prefix and in suffix order.

Every word position starts a window of up to five words of its piece.  Windows
sorted in word order hold the counts of all their beginnings as runs, so one
pass over a sorted stream counts phrases of every length.  The counts are kept
as two streams.  In prefix order a phrase stands behind its own beginnings and
before its extensions to the right; in suffix order behind its own endings and
before its extensions to the left.  A stack of at most five phrases walks each
stream; a sort-merge join of the two brings both sides together.

Two filters of bounded size make windows short: a word, and then a pair of
words, that occurs too seldom is in no candidate.  They let some rare ones
through, which only costs time; every count comes from the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.gather import combined, summed_rows
from pagequarry.llm.labelled import runs, text_bytes
from pagequarry.llm.shared import ship, written
from pagequarry.llm.tokens import sliced

#: Words of the longest phrase.
LONGEST = 5
#: Bits for each key of a filter, and the most bits a filter has (32 MB).
KEY_BITS, FILTER_BITS = 16, 1 << 28
#: First pairs that start more than this share of all pairs; their windows are dealt out by all their words.
HOT_SHARE = 1 / 1000
#: Pairs of words that a task counts at a time (32 MB).
PAIRS = 1 << 22
#: Bytes of text read at a time, and rows and bytes that a task gathers before it adds up equal ones.
SLICE, GATHER = 1 << 20, (1 << 19, 24 << 20)

_SEP = 9
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9]] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: In keys the separator is the smallest byte: characters below it are spelled with this one, which no other text holds then.
_ESCAPE = "\ue000"
_BELOW = [chr(b) for b in range(_SEP)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _escaped(text: str) -> str:
    text = text.replace(_ESCAPE, _ESCAPE + "0")
    for i, c in enumerate(_BELOW):
        text = text.replace(c, _ESCAPE + chr(ord("a") + i))
    return text


def _escaped_lang(lang: str | None) -> str:
    # languages stand in keys too, where a separator may not occur
    return _escaped("und" if lang is None else lang).replace("\t", _ESCAPE + "t")


def _plain(key: Column) -> Column:
    spelled = [("t", "\t"), *((chr(ord("a") + i), c) for i, c in enumerate(_BELOW)), ("0", _ESCAPE)]
    return reduce(lambda text, s: F.replace(text, F.lit(_ESCAPE + s[0]), F.lit(s[1])), spelled, key)


class Words:
    """The lower-cased words of some texts, one after the other in ``flat``.

    ``begin`` has a word's first byte in ``flat`` and one entry more; behind
    each word stands a separator.  ``reach`` is how many words of its piece
    follow from a word on, itself included; ``lang`` the number of its language
    in ``langs``; ``hash`` covers language and word.
    """

    def __init__(self, batch: pa.RecordBatch):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        data, offsets = text_bytes(texts)
        if len(data) and (data.min() < _SEP or (data == 0xEE).any()):
            texts = pa.array([_escaped(t) for t in texts.to_pylist()], pa.large_string())
            data, offsets = text_bytes(texts)
        data = _LOWER[data]
        first, end = runs(~(_BLANK[data] | _CUT[data]), offsets)
        n = len(first)
        row = np.searchsorted(offsets, first, side="right") - 1
        cuts = np.r_[0, np.cumsum(_CUT[data])]
        # a word opens a piece if it is the first of its row or a cut stands before it
        opens = np.ones(n, dtype=bool)
        opens[1:] = (row[1:] != row[:-1]) | (cuts[first[1:]] != cuts[end[:-1]])
        bounds = np.r_[np.flatnonzero(opens), n]
        self.reach = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
        size = end - first
        self.begin = np.r_[0, np.cumsum(size + 1)]
        inside = np.arange(self.begin[-1], dtype=np.int32) - np.repeat(self.begin[:-1].astype(np.int32), size + 1)
        at = np.repeat(first.astype(np.int32), size + 1) + inside
        # the byte behind the last word may be behind the last text
        self.flat = data.take(at, mode="clip") if len(data) else np.zeros(0, dtype=np.uint8)
        self.flat[self.begin[1:] - 1] = _SEP
        coded = pa.array([_escaped_lang(x) for x in batch.column("lang").to_pylist()], pa.string()).dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[row] if n else np.zeros(0, dtype=np.int32)
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max(initial=0)), _ODD[0], dtype=np.uint64)])
        total = np.zeros(len(inside) + 1, dtype=np.uint64)
        weighed = power[inside]
        weighed *= self.flat + np.uint64(7)
        np.cumsum(weighed, out=total[1:])
        del weighed, inside, at, data
        seeds = np.array([int.from_bytes(x.encode(), "little") % (2**61 - 1) for x in self.langs.to_pylist()] or [0], dtype=np.uint64)
        self.hash = _mixed(total[self.begin[1:]] - total[self.begin[:-1]] + _mixed(seeds)[self.lang] * _ODD[1])

    def strings(self, at: np.ndarray, n_words: np.ndarray) -> pa.Array:
        """The texts of ``n_words`` words from the words ``at`` on, with separators."""
        start = self.begin[at]
        size = self.begin[at + n_words] - 1 - start
        ends = np.r_[0, np.cumsum(size)]
        source = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.flat[source]))

    def pair_hash(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.hash[at] * _ODD[1] + self.hash[at + 1] * _ODD[2])

    def lang_of(self, at: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.lang[at], pa.int32()), self.langs).cast(pa.string())


def _ones(n: int) -> pa.Array:
    return pa.array(np.ones(n, dtype=np.int64))


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(batch: pa.RecordBatch) -> pa.Table:
        words = Words(batch)
        every = np.arange(len(words.hash))
        texts = words.strings(every, np.ones(len(every), dtype=np.int64)).cast(pa.string())
        return summed_rows(pa.table({"lang": words.lang_of(every), "key": texts, "hash": pa.array(words.hash.view(np.int64)), "n": _ones(len(every))}))

    yield from combined(map(counted, sliced(batches, "text", SLICE)), *GATHER)


class HashFilter:
    """A bit array of bounded size over 64-bit hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hashes), dtype=bool)
        for at in (hashes & self.mask, (hashes >> np.uint64(29)) & self.mask):
            hit &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return hit


def _filter_of(hashes: DataFrame) -> HashFilter:
    """Bits are set by the executors; at most 32 MB come to the driver, whatever the number of hashes."""
    n = hashes.count()
    size = min(FILTER_BITS, max(1 << 12, 1 << (KEY_BITS * n).bit_length()))
    at = hashes.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 29))).alias("at")).select(F.col("at").bitwiseAND(F.lit(size - 1)).alias("at"))
    bits = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(size // 64, dtype=np.uint64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return HashFilter(words)


def _counted_hashes(arrays: Iterator[np.ndarray], room: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """(hash, n): equal hashes among ``room`` are counted by sorting them in place."""
    held, used = np.empty(room, dtype=np.int64), 0

    def out() -> Iterator[pa.RecordBatch]:
        held[:used].sort()
        ends = np.flatnonzero(np.r_[held[1:used] != held[: used - 1], used > 0]) + 1
        for lo in range(0, len(ends), 65_536):
            end = ends[lo : lo + 65_536]
            n = np.diff(end, prepend=ends[lo - 1] if lo else 0)
            yield pa.RecordBatch.from_arrays([pa.array(held[end - 1]), pa.array(n)], names=["hash", "n"])

    for hashes in arrays:
        while len(hashes):
            some, hashes = hashes[: room - used], hashes[room - used :]
            held[used : used + len(some)] = some
            used += len(some)
            if used == room:
                yield from out()
                used = 0
    if used:
        yield from out()


def _pairs_of(words: Words, common: HashFilter) -> np.ndarray:
    """The words that begin a pair of two common words."""
    is_common = common.has(words.hash)
    at = np.flatnonzero(is_common & (words.reach > 1))
    return at[is_common[at + 1]]


def _summed_hashes(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(hash, n) of the hashes whose counts come to ``least``; rows are sorted by hash."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last run of a batch may go on in the next one
        keys, totals = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            keys, totals = np.r_[keys[-1:], batch.column("hash").to_numpy()], np.r_[totals[-1:], batch.column("n").to_numpy()]
            if len(keys):
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, totals = keys[starts], np.add.reduceat(totals, starts)
                yield frequent(keys[:-1], totals[:-1])
        yield frequent(keys[-1:], totals[-1:])

    def frequent(keys: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        keep = totals >= least
        return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(totals[keep])], names=["hash", "n"])

    return add


def _pair_counts(rows: DataFrame, common: HashFilter, least: int = 1) -> DataFrame:
    """(hash, n) of the pairs of common words that occur ``least`` times; tasks have added up already, so Spark only sorts."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(batch: pa.RecordBatch) -> np.ndarray:
            words = Words(batch)
            return words.pair_hash(_pairs_of(words, shared.value)).view(np.int64)

        yield from _counted_hashes(map(pairs, sliced(batches, "text", SLICE)))

    counted = rows.mapInArrow(count, "hash long, n long")
    return counted.repartition("hash").sortWithinPartitions("hash").mapInArrow(_summed_hashes(least), "hash long, n long")


def _windows(rows: DataFrame, common: HashFilter, pairs: HashFilter, hot: np.ndarray) -> DataFrame:
    """(part, hot, key, n): windows of two to five words whose pairs all pass, language first.

    Windows with one first pair share ``part``; those of a hot first pair are
    dealt out by all their words.
    """
    shared = rows.sparkSession.sparkContext.broadcast((common, pairs, hot))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, pairs, hot = shared.value

        def windows(batch: pa.RecordBatch) -> pa.Table:
            words = Words(batch)
            at = _pairs_of(words, common)
            first = words.pair_hash(at)
            held = pairs.has(first)
            at, first = at[held], first[held]
            # how many good pairs follow each other from a word on
            good = np.zeros(len(words.hash) + LONGEST, dtype=bool)
            good[at] = True
            more = reduce(lambda run, i: run + (run == i) * good[at + i], range(1, LONGEST - 1), np.ones(len(at), dtype=np.int64))
            is_hot = np.isin(first, hot)
            whole = first.copy()
            for i in range(1, LONGEST - 1):
                longer = more > i
                whole[longer] = _mixed(whole[longer] * _ODD[0] + words.hash[at[longer] + i + 1])
            part = np.where(is_hot, whole, first).view(np.int64)
            texts = words.strings(at, more + 1).cast(pa.string())
            keys = pc.binary_join_element_wise(words.lang_of(at), texts, "\t")
            return summed_rows(pa.table({"part": pa.array(part), "key": keys, "hot": pa.array(is_hot), "n": _ones(len(at))}))

        yield from combined(map(windows, sliced(batches, "text", SLICE)), *GATHER)

    return rows.mapInArrow(cut, "part long, key string, hot boolean, n long")


def _run_counts(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrase counts from sorted windows: a phrase's count is the sum of the run of windows that begin with it.

    Runs of hot first pairs may go on in other tasks, so they are given out whatever their size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_runs: list[tuple[tuple[str, ...], int, bool] | None] = [None] * (LONGEST + 1)
        done: list[tuple[str, int]] = []

        def close(k: int) -> None:
            run = open_runs[k]
            if run is not None and (run[2] or run[1] >= least):
                done.append(("\t".join(run[0]), run[1]))
            open_runs[k] = None

        for batch in batches:
            if not batch.num_rows:
                continue
            split = pc.split_pattern(batch.column("key"), "\t")
            size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            coded = split.flatten().dictionary_encode()
            grid = np.full((len(size), LONGEST + 1), -1, dtype=np.int64)
            grid[np.arange(LONGEST + 1)[None, :] < size[:, None]] = coded.indices.to_numpy(zero_copy_only=False)
            name, counts, hot = coded.dictionary, batch.column("n").to_numpy(), batch.column("hot").to_numpy(zero_copy_only=False)
            new = np.ones(len(size), dtype=bool)
            new[1:] = (grid[1:, :2] != grid[:-1, :2]).any(axis=1)
            for k in range(2, LONGEST + 1):
                new[1:] |= grid[1:, k] != grid[:-1, k]
                at = np.flatnonzero(new & (size > k))
                # a run ends where the next one begins or where a shorter window stands between
                ends = np.flatnonzero(new)
                stop = np.r_[ends[1:], len(size)][np.searchsorted(ends, at)]
                total = np.r_[0, np.cumsum(counts)]
                total = total[stop] - total[at]
                keep = hot[at] | (total >= least)
                if len(at):
                    keep[[0, -1]] = True
                words_of = lambda i: tuple(name[int(c)].as_py() for c in grid[i, : k + 1])
                carried = open_runs[k]
                if carried is not None and len(at) and at[0] == 0 and words_of(0) == carried[0]:
                    open_runs[k] = None
                else:
                    close(k)
                    carried = None
                for i, t in zip(at[keep], total[keep]):
                    close(k)
                    got = words_of(i)
                    open_runs[k] = (got, int(t) + (carried[1] if carried is not None and i == 0 else 0), bool(hot[i]))
                    carried = None
                if len(at) and stop[-1] < len(size):
                    close(k)
            if done:
                yield pa.RecordBatch.from_pydict({"key": [d[0] for d in done], "n": [d[1] for d in done]})
                done.clear()
        for k in range(2, LONGEST + 1):
            close(k)
        if done:
            yield pa.RecordBatch.from_pydict({"key": [d[0] for d in done], "n": [d[1] for d in done]})

    return count


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, shorter, longest) of a stream in which phrases follow their own beginnings.

    ``shorter``: the counts of the beginnings, shortest first; ``longest``: the
    largest count among the phrases that extend this one by a word.
    """
    stack: list[list] = []  # words, count, counts of its beginnings, largest extension
    rows: list[tuple] = []

    def pop() -> None:
        words, n, shorter, longest = stack.pop()
        if len(words) > 2:
            rows.append(("\t".join(words), n, shorter, longest))

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
            names=["key", "n", "shorter", "longest"],
        )
        rows.clear()
        return made

    for batch in batches:
        for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()):
            words = key.split("\t")
            while stack and stack[-1][0] != words[: len(stack[-1][0])]:
                pop()
            if stack:
                stack[-1][3] = max(stack[-1][3], n)
            stack.append([words, n, [s[1] for s in stack], 0])
        if rows:
            yield out()
    while stack:
        pop()
    if rows:
        yield out()


def _walked(counts: DataFrame, key: Column, n_parts: int, names: tuple[str, str]) -> DataFrame:
    """One order of the count stream: phrases that begin (or end) alike are neighbours."""
    ordered = counts.select(key.alias("key"), "n").withColumn("head", F.substring_index("key", "\t", 2))
    ordered = ordered.repartition(n_parts, "head").sortWithinPartitions("key").select("key", "n")
    walked = ordered.mapInArrow(_stacked, "key string, n long, shorter array<long>, longest long")
    return walked.withColumnsRenamed({"shorter": names[0], "longest": names[1]})


def _turned(key: Column) -> Column:
    """Language, then the words from the last to the first."""
    words = F.split(key, "\t")
    return F.array_join(F.concat(F.slice(words, 1, 1), F.reverse(F.slice(words, F.lit(2), F.size(words) - 1))), "\t")


def phrase_counts(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, n) of all phrases of up to five words that occur ``least`` times, and (lang, total) of all words."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(_counted_words, "lang string, key string, hash long, n long")
    words = words.groupBy("lang", "key", "hash").agg(F.sum("n").alias("n"))
    # few rows stay: the rare words only count for their language
    seen = written(
        words.groupBy("lang", F.when(F.col("n") >= least, F.col("key")).alias("key"), F.when(F.col("n") >= least, F.col("hash")).alias("hash"))
        .agg(F.sum("n").alias("n")),
        "words",
    )
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    single = seen.where("key IS NOT NULL")
    common = _filter_of(single.select("hash"))
    pairs = written(_pair_counts(rows, common, least), "pairs")
    all_pairs = seen.agg(F.sum("n")).first()[0] or 0
    # at most 1 / HOT_SHARE pairs can be that frequent
    hot = [r["hash"] for r in pairs.where(F.col("n") > max(all_pairs * HOT_SHARE, least)).select("hash").collect()]
    windows = _windows(rows, common, _filter_of(pairs.select("hash")), np.array(hot, dtype=np.int64).view(np.uint64))
    runs_of = windows.repartition(parts, "part").sortWithinPartitions("key").select("key", "n", "hot")
    counted = runs_of.mapInArrow(_run_counts(least), "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = single.select(F.concat_ws("\t", "lang", "key").alias("key"), "n").unionByName(counted)
    return written(counts, "phrases"), totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    A phrase of two to five words that occurs ``least`` times scores
    floor(1000 * a * n / (l * r)) at its lowest cut.  Phrases inside a longer
    one of the same count are left out.  A null language is ``und``; a null
    text and a text without words count nothing; equal rows count each.  An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts, totals = phrase_counts(docs, least, lang_col, text_col)
    ahead = _walked(counts, F.col("key"), parts, ("lefts", "right_longest"))
    back = _walked(counts, _turned(F.col("key")), parts, ("rights", "left_longest")).withColumn("key", _turned(F.col("key"))).drop("n")
    both = ahead.join(back.hint("merge"), "key").where((F.col("right_longest") < F.col("n")) & (F.col("left_longest") < F.col("n")))
    words = F.split("key", "\t")
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), "\t")
    named = both.select(F.get(words, F.lit(0)).alias("lang"), rest.alias("words"), F.col("n").alias("a"), "lefts", F.reverse("rights").alias("rights"))
    return scored(named.join(totals, "lang"), top)


def scored(found: DataFrame, top: int) -> DataFrame:
    """Scores, ranks and names of (lang, words, a, lefts, rights, total); ``lefts`` and ``rights`` go by cut."""
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.get("lefts", k - 1), F.get("rights", k - 1)
        score = F.call_function("div", wide(F.col("a")) * wide(F.col("total")) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = found.withColumn("phrase", _plain(F.replace("words", F.lit("\t"), F.lit(" ")))).withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.size("lefts")), cut)))
    place = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    first = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return first.select(
        _plain(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"),
    )


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
counts AS (
  SELECT lang, g, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) + 2 - k), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
        FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)
  GROUP BY lang, g HAVING count(*) >= 100),
phrases AS (SELECT lang, g, f, string_split(g, ' ') AS ws FROM counts WHERE contains(g, ' ')),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
inner_parts AS (
  SELECT lang, array_to_string(ws[i:j], ' ') AS p, max(f) AS most
  FROM phrases, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4, 5]) AS j)
  WHERE i < j AND j <= len(ws) AND j - i + 1 < len(ws) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.g AS phrase, c.f AS a, k, x.f AS l, y.f AS r, t.n,
         CAST((1000 * CAST(c.f AS HUGEINT) * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM phrases c JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < len(c.ws) JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.g = array_to_string(c.ws[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.g = array_to_string(c.ws[k + 1:], ' ')
  LEFT JOIN inner_parts q ON q.lang = c.lang AND q.p = c.g WHERE q.most IS NULL OR q.most < c.f),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
