"""Encoding and decoding with a sentence-piece vocabulary, as a lattice.

Texts are cut into words that no piece crosses.  The substrings of a word that
are pieces are the edges of its lattice, and a fold over the word picks the
pieces: Viterbi for unigram vocabularies; for BPE vocabularies, whose scores are
merge ranks and not log-probabilities, the best merge over the same edges, again
and again.

The words that are frequent in the corpus are encoded once, as relations: they
explode into substrings, an equi-join with the piece table makes the edges and
Spark's higher-order ``aggregate`` folds them.  Their ids go to all tasks as a
table of bounded size.  The other words are encoded with the documents that hold
them, as most of them occur once and sending every occurrence elsewhere and back
takes several times the input: the same edges, by a trie of the pieces, and the
same fold, over all words of one length at a time.  A fold's work grows with the
cube of a word's length, so long words take the same pieces with a heap or a
table of best scores.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.gather import combined
from pagequarry.llm.shared import bound, ship
from pagequarry.llm.tokens import PartEncoder, crc32_of

#: The mark that stands for a blank in pieces.
MARK = "▁"
#: Score of a character without a piece, below the worst piece, in unigram lattices.
UNKNOWN_PENALTY = 10.0
#: Words of more characters are cut in Python; a matter of speed, never of the result.
FOLD_CHARS = 64
#: Words whose ids all tasks get.
LEXICON = 50_000
#: How often a word must occur among those that a task gathers to be reported as frequent.
OFTEN = 8
#: Words of documents that are encoded at a time, and edges that are held at a time.
SLICE_WORDS, BLOCK_EDGES = 1 << 18, 1 << 22


@dataclass(frozen=True)
class Vocabulary:
    """``pieces``: (piece, id, score); ``byte_ids``: ids of the 256 byte pieces, or empty; ``unknown``: its id."""

    pieces: DataFrame
    bpe: bool
    longest: int
    word_pattern: str
    byte_ids: tuple[int, ...]
    unknown: int
    worst: float
    scores: dict[str, tuple[float, int]] = field(default_factory=dict, repr=False)


def vocabulary(spark: SparkSession, rows: list[tuple[str, int, float]], bpe: bool, byte_ids: tuple[int, ...] = (), unknown: int = 0) -> Vocabulary:
    """From (piece, id, score) rows; as large as the model, whatever the corpus.

    Words may also end between letters and other characters where no piece
    has both, which keeps words short in texts without blanks.
    """
    mixed = any(len({c.isalpha() for c in p.lstrip(MARK)}) > 1 for p, _, _ in rows)
    inside = any(MARK in p.lstrip(MARK) for p, _, _ in rows)
    letters = rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+"
    pattern = r"(?s).+" if inside else f"{MARK}*[^{MARK}]+|{MARK}+" if mixed else letters
    return Vocabulary(
        spark.createDataFrame(rows, "piece string, id int, score double"), bpe, max((len(p) for p, _, _ in rows), default=1),
        pattern, byte_ids, unknown, min((s for _, _, s in rows), default=0.0),
        {p: (s, i) for p, i, s in rows},
    )


def load_vocabulary(spark: SparkSession, model_path: str) -> Vocabulary:
    """The vocabulary of a sentence-piece model file with identity normalisation."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    rows, byte_ids = [], {}
    for i, p in enumerate(proto.pieces):
        if model.is_byte(i):
            byte_ids[int(p.piece[1:-1], 16)] = i
        elif not model.is_control(i) and not model.is_unknown(i):
            rows.append((p.piece, i, float(p.score)))
    return vocabulary(spark, rows, proto.trainer_spec.model_type == 2, tuple(byte_ids[b] for b in range(256)) if byte_ids else (), model.unk_id())


def _words(text: Column, vocab: Vocabulary) -> Column:
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    none = F.array().cast("array<string>")
    return F.when(text == "", none).otherwise(F.regexp_extract_all(marked, F.lit(f"({vocab.word_pattern})"), F.lit(1)))


def merged_cuts(word: str, scores: dict[str, tuple[float, int]]) -> list[int]:
    """As ``_merged``, in time n log n."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the begin of a part: its end, the part in front
    heap: list[tuple[float, int, int, int]] = []

    def pair(left: int) -> None:
        middle = after[left]
        if middle < n and (known := scores.get(word[left : after[middle]])):
            heapq.heappush(heap, (-known[0], left, middle, after[middle]))

    for i in range(n):
        pair(i)
    alive = [True] * n
    while heap:
        _, left, middle, end = heapq.heappop(heap)
        if not alive[left] or after[left] != middle or not alive[middle] or after[middle] != end:
            continue
        alive[middle], after[left] = False, end
        if end < n:
            before[end] = left
        if before[left] >= 0:
            pair(before[left])
        pair(left)
    return [*(i for i in range(n) if alive[i]), n]


def viterbi_cuts(word: str, scores: dict[str, tuple[float, int]], longest: int, worst: float) -> list[int]:
    """As ``_viterbi``."""
    best: list[tuple[float, int] | None] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        arrivals = []
        for begin in range(max(0, end - longest), end):
            known = scores.get(word[begin:end])
            if known or end - begin == 1:
                arrivals.append((best[begin][0] + (known[0] if known else worst - UNKNOWN_PENALTY), -begin))
        best.append(max(arrivals))
    cuts = [len(word)]
    while cuts[-1] > 0:
        cuts.append(-best[cuts[-1]][1])
    return cuts[::-1]


@dataclass(frozen=True)
class PlainVocabulary:
    """What a Python worker needs of a ``Vocabulary``."""

    scores: dict[str, tuple[float, int]]
    bpe: bool
    longest: int
    byte_ids: tuple[int, ...]
    unknown: int
    worst: float

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def word_ids(self, word: str) -> list[int]:
        """One word by itself, whatever its length."""
        cuts = merged_cuts(word, self.scores) if self.bpe else viterbi_cuts(word, self.scores, self.longest, self.worst)
        out = []
        for begin, end in zip(cuts, cuts[1:]):
            known = self.scores.get(word[begin:end])
            out.extend([known[1]] if known else self.unknown_ids(word[begin:end]))
        return out


def _plain(vocab: Vocabulary) -> PlainVocabulary:
    return PlainVocabulary(vocab.scores, vocab.bpe, vocab.longest, vocab.byte_ids, vocab.unknown, vocab.worst)


def _long_ids(spark: SparkSession, vocab: Vocabulary) -> Column:
    """Ids of words of more than ``FOLD_CHARS`` characters, NULL for others."""
    ship(spark)
    shared = spark.sparkContext.broadcast(_plain(vocab))  # bounded by the model

    @F.pandas_udf("array<int>")
    def of(words: pd.Series) -> pd.Series:
        plain = shared.value
        return pd.Series([None if w is None else plain.word_ids(w) for w in words], dtype=object)

    return of(F.when(F.length("word") > FOLD_CHARS, F.col("word")))


def _edges(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, edges, long_ids): the word's substrings that are pieces, as a map from begin and end to score and id.

    ``words`` is distributed by word, so the join and the grouping move nothing.
    Long words have ``long_ids`` and only one edge.
    """
    n = F.length("word")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(vocab.longest), n - i)),
            lambda k: F.struct(_span(i, i + k).alias("span"), F.substring(F.col("word"), i + 1, k).alias("part")),
        ),
    ))
    first = F.array(F.struct(F.lit(0).cast("long").alias("span"), F.substring("word", 1, 1).alias("part")))
    words = words.withColumn("long_ids", _long_ids(words.sparkSession, vocab))
    spans = F.when(n > FOLD_CHARS, first).otherwise(spans)
    exploded = words.select("word", "long_ids", F.explode(spans).alias("s")).select("word", "long_ids", "s.span", "s.part")
    pieces = F.broadcast(vocab.pieces)  # bounded by the model
    met = exploded.join(pieces, F.col("part") == F.col("piece"), "left").where("piece IS NOT NULL OR length(part) = 1")
    edge = F.struct("span", F.struct("score", "id").alias("piece"))
    return met.groupBy("word").agg(F.map_from_entries(F.collect_list(edge)).alias("edges"), F.first("long_ids").alias("long_ids"))


def _span(begin: Column, end: Column) -> Column:
    return begin.cast("long") * (65536 * 16) + end


def _merged(word: Column, edges: Column) -> Column:
    """Cut positions after all merges: of the pairs whose union is a piece the best, the leftmost of equals."""

    def step(cut: Column, _: Column) -> Column:
        def candidate(k: Column) -> Column:
            score = F.try_element_at(edges, _span(F.get(cut, k - 1), F.get(cut, k + 1)))["score"]
            return F.struct(score.alias("score"), (-k).alias("k"))

        pairs = F.transform(F.sequence(F.lit(1), F.size(cut) - 2), candidate)
        remove = lambda best: F.when(
            best["score"].isNull(), cut
        ).otherwise(F.filter(cut, lambda _c, i: i != -best["k"]))
        return F.when(F.size(cut) < 3, cut).otherwise(bound(F.array_max(pairs), remove))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.sequence(F.lit(0), F.length(word)), step)


def _viterbi(word: Column, edges: Column, vocab: Vocabulary) -> Column:
    """Cut positions of the best path; of equal paths the one whose last piece begins first."""
    state = "array<struct<score:double,back:int>>"

    def step(best: Column, end: Column) -> Column:
        def arrival(begin: Column) -> Column:
            score = F.try_element_at(edges, _span(begin, end))["score"]
            unknown = F.when(end - begin == 1, F.lit(vocab.worst - UNKNOWN_PENALTY))
            return F.struct((F.get(best, begin)["score"] + F.coalesce(score, unknown)).alias("score"), (-begin).alias("back"))

        begins = F.sequence(F.greatest(F.lit(0), end - vocab.longest), end - 1)
        top = bound(F.array_max(F.transform(begins, arrival)), lambda a: F.array(F.struct(a["score"].alias("score"), (-a["back"]).alias("back"))))
        return F.concat(best, top).cast(state)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back"))).cast(state)
    best = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)

    def path(b: Column) -> Column:
        def back(cut: Column, _: Column) -> Column:
            return F.when(F.get(cut, F.lit(0)) <= 0, cut).otherwise(F.concat(F.array(F.get(b, F.get(cut, F.lit(0)))["back"]), cut))

        return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.length(word)), back)

    return bound(best, path)


def _ids(word: Column, edges: Column, cuts: Column, vocab: Vocabulary) -> Column:
    """Ids of the pieces between the cuts; a character without a piece gives its byte pieces, or the unknown id."""
    def of(cut: Column) -> Column:
        def one(k: Column) -> Column:
            begin, end = F.get(cut, k - 1), F.get(cut, k)
            known = F.try_element_at(edges, _span(begin, end))["id"]
            if vocab.byte_ids:
                raw = F.encode(F.substring(word, begin + 1, end - begin), "UTF-8")
                table = F.array(*[F.lit(i) for i in vocab.byte_ids])
                number = lambda j: F.conv(F.hex(F.substring(raw, j, F.lit(1))), 16, 10).cast("int")
                unknown = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda j: F.get(table, number(j)))
            else:
                unknown = F.array(F.lit(vocab.unknown))
            return F.when(known.isNotNull(), F.array(known)).otherwise(unknown)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cut) - 1), one))

    return bound(cuts, of)


def encoded_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, ids) of distinct words."""
    lattice = _edges(words, vocab)
    cuts = _merged(F.col("word"), F.col("edges")) if vocab.bpe else _viterbi(F.col("word"), F.col("edges"), vocab)
    folded = _ids(F.col("word"), F.col("edges"), cuts, vocab)
    return lattice.select("word", F.when(F.length("word") > FOLD_CHARS, F.col("long_ids")).otherwise(folded).alias("ids"))


class Lattice:
    """The lattices of many words at once: a trie of the pieces finds the edges, words of one length are folded together."""

    def __init__(self, plain: PlainVocabulary):
        self.plain = plain
        steps: dict[int, int] = {}
        piece_at = [-1]
        for number, piece in enumerate(plain.scores):
            node = 0
            for char in piece:
                following = steps.setdefault(node << 21 | ord(char), len(piece_at))
                if following == len(piece_at):
                    piece_at.append(-1)
                node = following
            piece_at[node] = number
        # a last step that no text takes
        self.steps = np.array([*sorted(steps), np.iinfo(np.int64).max], dtype=np.int64)
        self.nodes = np.array([*(steps[k] for k in sorted(steps)), 0], dtype=np.int64)
        self.piece_at = np.array(piece_at, dtype=np.int32)
        # the last entry stands for no piece
        self.scores = np.array([*(s for s, _ in plain.scores.values()), -np.inf])
        self.ids = np.array([*(i for _, i in plain.scores.values()), -1], dtype=np.int32)

    def edges(self, chars: np.ndarray, room: np.ndarray) -> np.ndarray:
        """By the begin and the length - 1 of a substring: its piece, or -1; ``room`` is how far the word goes on."""
        found = np.full((len(chars), self.plain.longest), -1, dtype=np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        for k in range(self.plain.longest):
            step = node << 21 | chars[at + k]
            place = np.searchsorted(self.steps, step)
            hit = self.steps[place] == step
            at, node = at[hit], self.nodes[place[hit]]
            found[at, k] = self.piece_at[node]
            goes_on = room[at] > k + 1
            at, node = at[goes_on], node[goes_on]
        return found

    def _merged(self, edges: np.ndarray, begin: np.ndarray, n: int, opens: np.ndarray) -> None:
        """As ``_merged``: every row loses the cut of its best pair, the leftmost of equals, until it has no pair."""
        cut = np.tile(np.arange(n + 1), (len(begin), 1))
        while len(cut) and cut.shape[1] > 2:
            size = cut[:, 2:] - cut[:, :-2]
            piece = edges[begin[:, None] + cut[:, :-2], np.minimum(size, self.plain.longest) - 1]
            score = np.where(size <= self.plain.longest, self.scores[piece], -np.inf)
            best = score.argmax(axis=1)
            more = score[np.arange(len(cut)), best] > -np.inf
            opens[(begin[~more, None] + cut[~more, :-1]).ravel()] = True
            cut, begin, best = cut[more], begin[more], best[more]
            keep = np.ones(cut.shape, dtype=bool)
            keep[np.arange(len(cut)), best + 1] = False
            cut = cut[keep].reshape(len(cut), cut.shape[1] - 1)
        opens[(begin[:, None] + cut[:, :-1]).ravel()] = True

    def _viterbi(self, edges: np.ndarray, begin: np.ndarray, n: int, opens: np.ndarray) -> None:
        """As ``_viterbi``."""
        rows = np.arange(len(begin))
        best, back = np.zeros((len(begin), n + 1)), np.zeros((len(begin), n + 1), dtype=np.int64)
        for end in range(1, n + 1):
            first = max(0, end - self.plain.longest)
            starts = np.arange(first, end)
            score = self.scores[edges[begin[:, None] + starts, end - starts - 1]]
            score[:, -1] = np.where(score[:, -1] > -np.inf, score[:, -1], self.plain.worst - UNKNOWN_PENALTY)
            arrival = best[:, first:end] + score
            top = arrival.argmax(axis=1)
            best[:, end], back[:, end] = arrival[rows, top], first + top
        end = np.full(len(begin), n)
        while len(rows):
            end = back[rows, end]
            opens[begin[rows] + end] = True
            rows, end = rows[end > 0], end[end > 0]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        room = np.repeat(ends, sizes) - np.arange(len(chars))
        edges = self.edges(chars, room)
        opens = np.zeros(len(chars), dtype=bool)
        fold = self._merged if self.plain.bpe else self._viterbi
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(group) and sizes[group[0]]:
                fold(edges, (ends - sizes)[group], int(sizes[group[0]]), opens)
        first = np.flatnonzero(opens)
        size = np.diff(np.r_[first, len(chars)])
        ids = self.ids[edges[first, size - 1]]
        counts = np.ones(len(first), dtype=np.int64)
        lost = np.flatnonzero(ids < 0)
        spelled = [self.plain.unknown_ids(chr(c)) for c in chars[first[lost]]]
        counts[lost] = [len(x) for x in spelled]
        ids = np.repeat(ids, counts)
        place = np.cumsum(counts) - counts
        for at, own in zip(place[lost].tolist(), spelled):
            ids[at : at + len(own)] = own
        at = np.r_[0, np.cumsum(counts)][np.r_[0, np.searchsorted(first, ends)]]
        return ids, np.diff(at)


class WordEncoder(PartEncoder):
    """Ids of documents that come as lists of words; words seen before come from the lexicon or a cache of bounded size."""

    def __init__(self, plain: PlainVocabulary, words: list[str], ids: np.ndarray, lengths: np.ndarray):
        self.plain, self.lattice = plain, Lattice(plain)
        self.known, self.ids, self.starts = {}, np.zeros(1 << 20, dtype=np.int32), np.zeros(250_001, dtype=np.int64)
        self._keep(words, ids, lengths)
        # what each id stands for, end to end
        names = {i: p.encode() for p, (_, i) in plain.scores.items()} | {i: bytes([b]) for b, i in enumerate(plain.byte_ids)}
        raw = [names.get(i, b"") for i in range(max([*names, plain.unknown], default=0) + 1)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        lengths = np.zeros(len(parts), dtype=np.int64)
        short = np.flatnonzero(sizes <= FOLD_CHARS)
        block = np.cumsum(sizes[short] * self.plain.longest) // BLOCK_EDGES
        for some in np.split(short, np.flatnonzero(np.diff(block)) + 1):
            if len(some):
                own, lengths[some] = self.lattice.encoded([parts[i] for i in some])
                ids.append(own)
        # long words stand behind the short ones until all have their lengths
        long = np.flatnonzero(sizes > FOLD_CHARS)
        for i in long:
            own = np.array(self.plain.word_ids(parts[i]), dtype=np.int32)
            lengths[i] = len(own)
            ids.append(own)
        flat = np.concatenate(ids)
        if len(long):
            order = np.r_[short, long]
            first = np.zeros(len(parts), dtype=np.int64)
            first[order] = np.cumsum(lengths[order]) - lengths[order]
            flat = flat[np.arange(len(flat)) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)]
        return flat, lengths

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where the ids of each word end."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, distinct, [-1] * len(distinct)), dtype=np.int64, count=len(distinct))
        unknown = np.flatnonzero(number < 0)
        fresh = [distinct[i] for i in unknown]
        own, lengths = self._encoded(fresh)
        first, size = self.starts[number], self.starts[number + 1] - self.starts[number]
        first[unknown], size[unknown] = len(self.ids) + np.cumsum(lengths) - lengths, lengths
        source = np.concatenate([self.ids, own])
        at = coded.indices.to_numpy(zero_copy_only=False)
        first, size = first[at], size[at]
        ends = np.cumsum(size)
        flat = source[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]
        self._keep(fresh, own, lengths)
        return flat, ends

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for; an unknown id stands for nothing."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.cumsum(size)
        return self.raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_at[ids] - (ends - size), size)]


#: The encoder of the worker's present vocabulary; workers live for many tasks.
_ENCODER: dict[str, WordEncoder] = {}


def _rows(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), _words(F.coalesce(F.col(text_col), F.lit("")), vocab).alias("words"))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(doc ids, their words end to end, bounds of each document's words) of about ``SLICE_WORDS`` words at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        listed = batch.column("words")
        bounds = np.r_[0, np.cumsum(pc.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
        words = listed.flatten()
        group = bounds[1:] // SLICE_WORDS
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield batch.column("doc_id").slice(lo, hi - lo), words.slice(bounds[lo], bounds[hi] - bounds[lo]), bounds[lo : hi + 1] - bounds[lo]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tables() -> Iterator[pa.Table]:
        for _, words, _ in _sliced(batches):
            got = words.value_counts()
            yield pa.table({"word": got.field("values"), "n": got.field("counts")})

    for batch in combined(tables()):
        yield batch.filter(pc.greater_equal(batch.column("n"), OFTEN))


def lexicon(rows: DataFrame, vocab: Vocabulary, size: int = LEXICON) -> DataFrame:
    """(word, ids) of the most frequent words of (doc_id, words), at most ``size``; which they are never changes an id."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.mapInArrow(_frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size)
    return encoded_words(top.select("word").repartition(parts, "word"), vocab)


def _with_lexicon(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str, size: int) -> tuple[Callable[[], WordEncoder], DataFrame]:
    """What gives a worker its encoder, which knows the corpus-wide lexicon; (doc_id, words) of the rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, vocab, id_col, text_col)
    table = lexicon(rows, vocab, size).toPandas()  # at most ``size`` short rows
    lengths = table["ids"].map(len).to_numpy(dtype=np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *table["ids"]]).astype(np.int32)
    shared = spark.sparkContext.broadcast((_plain(vocab), table["word"].tolist(), ids, lengths))
    name = uuid.uuid4().hex

    def encoder() -> WordEncoder:
        if name not in _ENCODER:
            _ENCODER.clear()
            _ENCODER[name] = WordEncoder(*shared.value)
        return _ENCODER[name]

    return encoder, rows


def encoded(
    docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON
) -> DataFrame:
    """doc_id, ids: the ids of every whole text, one row per row of ``docs``.

    A null or empty text has no ids.  Rows without an id and rows that repeat
    one are encoded each by itself.  An empty table gives no rows; other columns
    are ignored.
    """
    encoder, rows = _with_lexicon(docs, vocab, id_col, text_col, lexicon_size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for doc_ids, words, bounds in _sliced(batches):
            ids, ends = coder.ids_of(words)
            made = pa.ListArray.from_arrays(pa.array(np.r_[0, ends][bounds], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids, made], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, vocab: Vocabulary, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, text): what the ids of each key stand for, marks as blanks.

    Byte pieces are put together as UTF-8.  The blank that encoding puts
    before a text is still there.  Ids that the vocabulary lacks give nothing.
    """
    spark = rows.sparkSession
    by_byte = spark.createDataFrame([(i, f"{b:02X}") for b, i in enumerate(vocab.byte_ids)] or [(-1, "")], "id int, raw string")
    names = vocab.pieces.select("id", F.hex(F.encode("piece", "UTF-8")).alias("raw")).unionByName(by_byte)
    placed = rows.select(F.col(key).alias("key"), F.posexplode_outer(ids_col).alias("pos", "id"))
    met = placed.join(F.broadcast(names), "id", "left")  # bounded by the model
    parts = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("parts"))
    raw = F.unhex(F.array_join(F.transform("parts", lambda p: F.coalesce(p["raw"], F.lit(""))), ""))
    return parts.select(F.col("key").alias(key), F.replace(F.decode(raw, "UTF-8"), F.lit(MARK), F.lit(" ")).alias("text"))


def round_trip(
    docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON
) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decodes: every whole text encoded and decoded.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers,
    ``decodes`` whether the text comes back from its ids.  Null texts, repeated
    ids and empty tables are as in ``encoded``.
    """
    encoder, rows = _with_lexicon(docs, vocab, id_col, text_col, lexicon_size)

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for doc_ids, words, bounds in _sliced(batches):
            ids, ends = coder.ids_of(words)
            at = np.r_[0, ends][bounds]
            raw = words.cast(pa.large_binary())
            sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False)
            text_at = np.r_[0, np.cumsum(sizes)][bounds]
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset :]
            text = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[0] + text_at[-1]]
            columns = [
                pa.array(np.diff(at), pa.int64()),
                pa.array([crc32_of(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
                pa.array([
                    np.array_equal(coder.spelled(ids[a:b]), text[c:d]) for a, b, c, d in zip(at[:-1], at[1:], text_at[:-1], text_at[1:])
                ], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([doc_ids, *columns], names=["doc_id", "n_pieces", "ids_crc32", "decodes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trip, f"doc_id {kind}, n_pieces long, ids_crc32 long, decodes boolean")
