"""Document quality from a linear-chain conditional random field over lines.

Every line has byte-level measures of itself and of the lines beside it.  Two
states, good and bad, with learned transitions; forward and backward passes
give each line's marginal, and a document's score is a calibrated function of
the marginals weighted by line length.  Neither language nor source is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.labelled import fit_logistic, labelled_sample, logistic, runs, sigmoid, summed, text_bytes
from pagequarry.llm.shared import ship
from pagequarry.llm.tokens import sliced

#: Labelled rows the field is fitted on, at most.
MAX_ROWS = 3_000
#: Longer texts are fitted as several chains of so many lines.
CHAIN_LINES = 64
GOOD_FROM = 0.7
#: Rounds of labelling the lines of bad documents anew.
ROUNDS = 2
STEPS = 120


def _marks(chars: bytes) -> np.ndarray:
    marks = np.zeros(256, dtype=np.int64)
    marks[list(chars)] = 1
    return marks


_UPPER = _marks(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_KINDS = (
    _UPPER, _marks(b"0123456789"), _marks(b"#*$%&<>"), _marks(b"|"), _marks(b"!?"), _marks(b".,;:"), _marks(bytes(range(128, 256))),
)
_SPACE = _marks(b" \t\n\x0b\x0c\r").astype(bool)
_LOWERED = np.arange(256, dtype=np.uint64)
_LOWERED[65:91] += 32


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, first line of each text) of the lines that have a word."""
    data, offsets = text_bytes(texts)
    begins, ends = runs(data != 10, offsets)
    word_begins, word_ends = runs(~_SPACE[data], offsets)
    edges = np.searchsorted(word_begins, np.r_[begins, len(data)])
    filled = edges[1:] > edges[:-1]
    begins, ends, words = begins[filled], ends[filled], np.diff(edges)[filled]
    first = np.searchsorted(begins, offsets)
    if not len(begins):
        return np.zeros((0, 3 * (len(_KINDS) + 6))), np.zeros(0), first
    size = (ends - begins).astype(float)
    bounds = np.c_[begins, ends].ravel()

    def share(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark[data])])
        at = total[bounds].reshape(-1, 2)
        return (at[:, 1] - at[:, 0]) / size

    # words by content: a sum of bytes times powers of an odd constant
    length = word_ends - word_begins
    inside = np.arange(len(data)) - np.repeat(np.r_[0, word_begins], np.diff(np.r_[0, word_begins, len(data)]))
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(inside.max(initial=0)), 0x9E3779B97F4A7C15, dtype=np.uint64)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWERED[data] + np.uint64(7)) * power[inside], dtype=np.uint64)])
    content = total[word_ends] - total[word_begins]
    line_edges = np.r_[edges[:-1][filled], len(content)]
    again = np.zeros(len(content))
    same_line = np.ones(len(content), dtype=bool)
    same_line[line_edges[:-1]] = False
    again[1:] = (content[1:] == content[:-1]) & same_line[1:]
    of_text = np.searchsorted(first, np.arange(len(begins)), side="right") - 1
    long_words = (length > 20).astype(float)
    # words whose content came before in the same text
    text_of_word = np.repeat(of_text, np.diff(line_edges)).astype(np.uint64)
    key = content * np.uint64(0xD1342543DE82EF95) ^ (text_of_word * np.uint64(0x9E3779B97F4A7C15))
    pair = key.copy()
    pair[1:] ^= (key[:-1] << np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    seen = np.ones(len(pair))
    seen[np.unique(pair, return_index=True)[1]] = 0
    own = np.c_[
        np.sqrt(np.column_stack([share(k) for k in _KINDS])),
        np.log1p(words) / 4, np.minimum(size / words, 40) / 10,
        summed(again, line_edges) / words, summed(long_words, line_edges) / words, summed(seen, line_edges) / words,
        (size < 3).astype(float),
    ]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][of_text[1:] == of_text[:-1]] = own[:-1][of_text[1:] == of_text[:-1]]
    after[:-1][of_text[1:] == of_text[:-1]] = own[1:][of_text[1:] == of_text[:-1]]
    return np.c_[own, before, after], size, first


def _features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` a few texts at a time, so that byte-level arrays stay small."""
    parts = [line_features(pa.array(texts[lo : lo + 100], pa.large_string())) for lo in range(0, len(texts), 100)]
    counts = np.concatenate([np.diff(first) for _, _, first in parts])
    return np.concatenate([x for x, _, _ in parts]), np.concatenate([s for _, s, _ in parts]), np.r_[0, np.cumsum(counts)]


@dataclass
class LineField:
    """``emit``: weights of a line's log-odds of good; ``move``: log weights of the transitions."""

    emit: np.ndarray
    move: np.ndarray
    top: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and expected transitions of each neighbouring pair (n, 2, 2)."""
        return _forward_backward(x @ self.emit[:-1] + self.emit[-1], self.move, first)

    def document_inputs(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _ = self.marginals(x, first)
        length = np.maximum(summed(size, first), 1)
        weighted = summed(good * size, first) / length
        logit = np.clip(x @ self.emit[:-1] + self.emit[-1], -20, 20)
        return np.c_[weighted, summed(logit * size, first) / length, np.log1p(length) / 10, length <= 1]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return logistic(self.document_inputs(*line_features(texts)), self.top)


def _forward_backward(logit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chains step by step together; chains that have ended drop out."""
    n = np.diff(first)
    good = sigmoid(logit)
    emit = np.c_[1 - good, good] + 1e-12
    step = np.exp(move - move.max())
    forward, backward = np.ones((len(logit), 2)), np.ones((len(logit), 2))
    order = np.argsort(-n, kind="stable")
    start, lengths = first[:-1][order], n[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")
    for t in range(lengths.max(initial=0)):
        at = start[: alive[t]] + t
        a = emit[at] if t == 0 else (forward[at - 1] @ step) * emit[at]
        forward[at] = a / a.sum(1, keepdims=True)
    for t in range(1, lengths.max(initial=0)):
        at = (start + lengths)[: alive[t]] - 1 - t
        b = (backward[at + 1] * emit[at + 1]) @ step.T
        backward[at] = b / b.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(logit), dtype=bool)
    inner[first[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    pairs = forward[at - 1][:, :, None] * step[None] * (emit[at] * backward[at])[:, None, :]
    return both[:, 1], pairs / pairs.sum((1, 2), keepdims=True)


def _fit_field(x: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gradient steps: expected minus observed counts of the field."""
    given = np.c_[x, np.ones(len(x))]
    emit, move = np.zeros(given.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[at - 1].astype(int), state[at].astype(int)), 1)
    moments = [np.zeros(emit.size + 4), np.zeros(emit.size + 4)]
    for t in range(1, STEPS + 1):
        good, pairs = _forward_backward(given @ emit, move, first)
        slope = np.r_[(state - good) @ given, (seen - pairs.sum(0)).ravel()] / len(x) - 1e-4 * np.r_[emit, 10 * move.ravel()]
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        change = 0.2 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-9)
        emit, move = emit + change[:-4], move + change[-4:].reshape(2, 2)
    return emit, move


def fit_field(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", where: Column | None = None, max_rows: int = MAX_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> LineField:
    """The field from at most ``max_rows`` labelled documents.

    All lines of a good document are good.  Lines of a bad one start as bad;
    then those that the fitted field finds good become good, but never all.
    Without labelled rows every score is 0.5.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, max_rows, where, id_col, text_col)
    rows = sample.toLocalIterator()
    texts, y = [], []
    for row in sorted(rows, key=lambda r: str(r["doc_id"])):
        texts.append(row["text"])
        y.append(row["label"])
    width = 3 * (len(_KINDS) + 6)
    if len(set(y)) < 2:
        return LineField(np.zeros(width + 1), np.zeros((2, 2)), np.zeros(5))
    label = np.array(y)
    x, size, first = _features_of(texts)
    of_text = np.repeat(np.arange(len(label)), np.diff(first))
    state = label[of_text].astype(float)
    place = np.arange(len(x)) - first[:-1][of_text]
    chains = np.r_[np.flatnonzero(place % CHAIN_LINES == 0), len(x)]
    for turn in range(1 + ROUNDS):
        emit, move = _fit_field(x, chains, state)
        field = LineField(emit, move, np.zeros(5))
        if turn < ROUNDS:
            # the transitions of whole-document labels would never let a line differ
            good, _ = _forward_backward(np.c_[x, np.ones(len(x))] @ emit, np.clip(move, -1, 1), first)
            state = np.where(label[of_text] == 1, 1.0, (good > 0.5).astype(float))
            worst = np.full(len(label), np.inf)
            np.minimum.at(worst, of_text, good)
            state[(label[of_text] == 0) & (good <= worst[of_text])] = 0.0
    field.top = fit_logistic(field.document_inputs(x, size, first), label, penalty=0.1)
    return field


def scored(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``, over whole texts.

    A null or empty text has no lines; it is scored from the intercept and its
    length.  Null and repeated ids are scored like others; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)  # a few hundred numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            p = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= good_from).astype(np.int32)})

    return rows.mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def good_rows(docs: DataFrame, field: LineField, text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """The rows of ``docs`` that score as good, with all their columns; no row is moved."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for some in sliced(iter([named]), f"c{place}", 2 << 20):
                yield some.filter(pa.array(shared.value.scores(some.column(place)) >= good_from)).rename_columns(batch.schema.names)

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
