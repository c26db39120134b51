"""Byte-level BPE by replaying the merges over a lexicon of distinct words.

The words of many documents are one lexicon.  An inverted index leads from each
pair of neighbouring tokens, named by the rank that the pair has, to its
positions in the lexicon.  Ranks are taken lowest first; all positions of a rank
are merged and only the pairs beside them enter the index anew.  Words that are
frequent in the corpus are replayed once, on the executors, and their ids go to
all tasks as a table of bounded size; the other words are replayed, by the same
index, with the documents that hold them, as sending a rare word elsewhere and
back costs more than its few merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.gather import combined
from pagequarry.llm.shared import ship
from pagequarry.llm.tokens import PartEncoder, sliced

#: Parts of text whose ids all tasks get; a part is a word with what belongs to it.
LEXICON = 100_000
#: How often a part must occur among those that a task gathers to be reported as frequent.
OFTEN = 8
SLICE = 2 << 20
#: Ids decoded at a time.
ID_SLICE = 1 << 18


class Ranks:
    """A vocabulary: the bytes of each id, and the id that each mergeable pair of ids makes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            entries = [line.split() for line in lines if line.strip()]
        self.id_of = {base64.b64decode(token): int(rank) for token, rank in entries}
        self.bytes_of = {rank: token for token, rank in self.id_of.items()}
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], dtype=np.int64)
        #: a pair is one number: left * width + right
        self.width = max(self.bytes_of) + 1
        pairs: dict[int, int] = {}
        for token, rank in self.id_of.items():
            for cut in range(1, len(token)):
                left, right = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self._pairs = np.array(sorted(pairs), dtype=np.int64)
        self._made = np.array([pairs[p] for p in self._pairs.tolist()], dtype=np.int64)
        #: ids that are part of a pair which ranks before them
        self.hasty = np.zeros(self.width, dtype=bool)
        for part in (self._pairs // self.width, self._pairs % self.width):
            self.hasty[part[self._made < part]] = True

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each pair of ids, and the id that it makes or -1."""
        pair = left * self.width + right
        if not len(self._pairs):
            return pair, np.full(len(pair), -1)
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return pair, np.where(self._pairs[at] == pair, self._made[at], -1)

    def pieces(self, decimal: bool) -> tuple[np.ndarray, np.ndarray]:
        """What each id stands for, end to end, and where it begins; decimal numbers have a blank before them."""
        parts = [(b" %d" % i if i in self.bytes_of else b"") if decimal else self.bytes_of.get(i, b"") for i in range(self.width)]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]


def _kept_of_chains(places: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Which places merge if they go from left to right: of places that overlap in a chain, every other one."""
    number = np.arange(len(places))
    opens = np.r_[True, nexts[:-1] != places[1:]]
    return (number - np.maximum.accumulate(np.where(opens, number, 0))) % 2 == 0


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and the number of ids of each word.

    As the words do not touch, taking the lowest rank of the whole lexicon takes
    the lowest rank of each word.  Equal ranks go from left to right.  Where a
    merge may make a pair that ranks before it, a word has one merge at a time.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    # each word is closed by a position without a token
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8) if len(words) else np.zeros(0, dtype=np.uint8)
    token = ranks.single[data]
    token[ends - 1] = -1
    after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
    index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    queue: list[int] = []

    def note(left: np.ndarray, right: np.ndarray) -> None:
        """Enter the pairs at these neighbours that the vocabulary can merge."""
        pair, rank = ranks.rank_of(token[left], token[right])
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        rank, place, pair = rank[at], left[at], pair[at]
        cuts = np.r_[0, np.flatnonzero(np.diff(rank)) + 1, len(rank)]
        for r, lo, hi in zip(rank[cuts[:-1]].tolist() if len(rank) else (), cuts[:-1].tolist(), cuts[1:].tolist()):
            if r in index:
                index[r].append((place[lo:hi], pair[lo:hi]))
            else:
                index[r] = [(place[lo:hi], pair[lo:hi])]
                heappush(queue, r)

    inner = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
    note(inner, inner + 1)
    while queue:
        rank = heappop(queue)
        noted = index.pop(rank)
        places, pair = noted[0] if len(noted) == 1 else map(np.concatenate, zip(*noted))
        nexts = after[places]
        # a neighbour may have been merged away since the place was noted
        live = (token[nexts] >= 0) & (token[places] * ranks.width + token[nexts] == pair)
        places = np.unique(places[live])
        if not len(places):
            continue
        nexts = after[places]
        if ranks.hasty[rank]:
            word = np.searchsorted(ends, places, side="right")
            first = np.r_[True, word[1:] != word[:-1]]
            wait, waiting = places[~first], nexts[~first]
            if len(wait):
                index[rank] = [(wait, token[wait] * ranks.width + token[waiting])]
                heappush(queue, rank)
        else:
            first = _kept_of_chains(places, nexts)
        places, nexts = places[first], nexts[first]
        token[places], token[nexts] = rank, -2
        follow = after[nexts]
        after[places], before[follow] = follow, places
        lead = before[places]
        left, right = np.r_[lead, places], np.r_[places, follow]
        whole = (left >= 0) & (token[left] >= 0) & (token[right] >= 0)
        note(left[whole], right[whole])
    alive = np.r_[0, np.cumsum(token >= 0)]
    return token[token >= 0].astype(np.int32), np.diff(np.r_[0, alive[ends]])


class ReplayEncoder(PartEncoder):
    """Ids of whole texts: each match of the pattern is a word of the lexicon.

    Texts are cut into parts where the pattern always cuts, and parts seen
    before come from the corpus-wide table or from a cache of bounded size.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find, self.drops_space = ranks, regex.compile(pattern).findall, False
        self.known, self.ids, self.starts = {}, np.zeros(1 << 20, dtype=np.int32), np.zeros(250_001, dtype=np.int64)

    def preload(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if not self.known:
            self._keep(parts, ids, lengths)

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        words, per_part = [], np.zeros(len(parts), dtype=np.int64)
        for i, part in enumerate(parts):
            found = self.find(part)
            per_part[i] = len(found)
            words += [number.setdefault(w, len(number)) for w in found]
        lexicon = [w.encode() for w in number]
        whole = np.array([self.ranks.id_of.get(w, -1) for w in lexicon], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        own, sizes = replay([lexicon[i] for i in rest], self.ranks)
        # a word that is a token by itself stays whole, the others follow behind these in one array
        source = np.r_[whole, own].astype(np.int32)
        first, size = np.arange(len(lexicon)), np.ones(len(lexicon), dtype=np.int64)
        first[rest], size[rest] = len(lexicon) + np.cumsum(sizes) - sizes, sizes
        at = np.array(words, dtype=np.int64)
        first, size = first[at], size[at]
        ends = np.r_[0, np.cumsum(size)]
        ids = source[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return ids, np.diff(ends[np.r_[0, np.cumsum(per_part)]])


_RANKS: dict[str, Ranks] = {}
_ENCODERS: dict[tuple[str, str], ReplayEncoder] = {}


def _ranks(path: str) -> Ranks:
    if path not in _RANKS:
        _RANKS[path] = Ranks(path)
    return _RANKS[path]


def _encoder(path: str, pattern: str) -> ReplayEncoder:
    """The worker's encoder; workers live for many tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ReplayEncoder(_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _frequent_parts(path: str, pattern: str, often: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, pattern)

        def tables() -> Iterator[pa.Table]:
            for batch in sliced(batches, "text", SLICE):
                texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
                if len(texts):
                    got = coder._parts(texts)[0].value_counts()
                    yield pa.table({"part": got.field("values").cast(pa.string()), "n": got.field("counts")})

        for batch in combined(tables()):
            yield batch.filter(pc.greater_equal(batch.column("n"), often))

    return count


def lexicon(docs: DataFrame, path: str, pattern: str, text_col: str = "text", size: int = LEXICON, often: int = OFTEN) -> DataFrame:
    """(part, ids): the most frequent parts of all texts, at most ``size``, replayed where they lie.

    Which parts are in it never changes an id, so tasks report only parts that
    are frequent among those they hold.
    """
    spark = docs.sparkSession
    ship(spark)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequent_parts(path, pattern, often), "part string, n long")
    top = counted.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(size)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, pattern)
        for batch in batches:
            ids, lengths = coder._encoded(batch.column("part").to_pylist())
            made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("part"), made], names=["part", "ids"])

    dealt = top.select("part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.mapInArrow(replayed, "part string, ids array<int>")


def encoded(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON
) -> DataFrame:
    """(doc_id, ids): one row per row of ``docs``, as encoding each text by itself gives.

    A null text is empty and has no ids.  Rows without an id and rows that
    repeat an id are encoded like others.  Strings of special tokens are
    ordinary text.  An empty table gives no rows; other columns are ignored.
    """
    encoder, rows = _with_lexicon(docs, path, pattern, id_col, text_col, lexicon_size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for batch in sliced(batches, "text", SLICE):
            found = coder.encode(batch.column("text"))
            made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _with_lexicon(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, size: int) -> tuple[Callable[[], ReplayEncoder], DataFrame]:
    """What gives a worker its encoder, which knows the corpus-wide lexicon; (doc_id, text) of the rows."""
    table = lexicon(docs, path, pattern, text_col, size).toPandas()  # at most ``size`` short rows
    lengths = table["ids"].map(len).to_numpy(dtype=np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *table["ids"]]).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((table["part"].tolist(), ids, lengths))

    def encoder() -> ReplayEncoder:
        coder = _encoder(path, pattern)
        coder.preload(*shared.value)
        return coder

    return encoder, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON
) -> DataFrame:
    """``digests`` of ``encoded``, slice by slice in one worker, so that the ids need not leave it."""
    encoder, rows = _with_lexicon(docs, path, pattern, id_col, text_col, lexicon_size)

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, digest = encoder(), _digester(path)
        for batch in sliced(batches, "text", SLICE):
            found = coder.encode(batch.column("text"))
            yield digest(batch.column("doc_id"), np.concatenate(found), np.cumsum([0, *map(len, found)]))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trip, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, token ids end to end, bounds) of about ``ID_SLICE`` token ids at a time."""
    coded = batch.column("ids")
    bounds = np.r_[0, np.cumsum(pc.list_value_length(coded).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
    flat = coded.flatten().to_numpy(zero_copy_only=False)
    group = bounds[:-1] // ID_SLICE
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.column("doc_id").slice(lo, hi - lo), flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]


def _spelled(ids: np.ndarray, bounds: np.ndarray, pieces: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the ids stand for, end to end, and where each document's part of it begins."""
    data, begin = pieces
    size = begin[ids + 1] - begin[ids]
    ends = np.r_[0, np.cumsum(size)]
    return data[np.arange(ends[-1]) + np.repeat(begin[ids] - ends[:-1], size)], ends[bounds]


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes of each row of ``coded`` (doc_id, ids); null ids are none, unknown ids stand for nothing."""
    ship(coded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _ranks(path).pieces(False)
        for batch in batches:
            for doc_ids, ids, bounds in _slices(batch):
                data, begin = _spelled(ids, bounds, pieces)
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc_ids), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([doc_ids, made.cast(pa.binary())], names=["doc_id", "data"])

    return coded.mapInArrow(decode, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, data binary")


def _digester(path: str) -> Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch]:
    ranks = _ranks(path)
    decimals, pieces = ranks.pieces(True), ranks.pieces(False)

    def digest(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        numbers, at = _spelled(ids, bounds, decimals)
        # the blank before a document's first number does not count
        of_ids = [hashlib.sha256(numbers[a + 1 : b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
        texts, at = _spelled(ids, bounds, pieces)
        of_text = [hashlib.sha256(texts[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
        columns = [doc_ids, pa.array(np.diff(bounds).astype(np.int64)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digests(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``coded`` (doc_id, ids)."""
    ship(coded.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digester(path)
        for batch in batches:
            for doc_ids, ids, bounds in _slices(batch):
                yield digest(doc_ids, ids, bounds)

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(each, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
