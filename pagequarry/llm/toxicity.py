"""Toxicity by a classifier chain over categories.

Words tied to toxic rows (whole words and word beginnings) get log-odds from a
bounded labelled sample.  A document's counts of such words feed a chain of
linear models, insult, toxic, severe: each later model also takes the earlier
categories' probabilities.  Both the log-odds and the probabilities that a
model is trained on come from other folds than its rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.labelled import fit_logistic, labelled_sample, logistic, runs, summed, text_bytes
from pagequarry.llm.shared import ship
from pagequarry.llm.tokens import sliced

CATEGORIES = ("insult", "toxic", "severe")
#: Labelled rows the chain is fitted on, and terms it keeps, at most.
MAX_ROWS = 20_000
MAX_TERMS = 50_000
FOLDS = 3
REJECT_FROM = 0.5
#: Word beginnings that count as terms, in characters.
PREFIXES = (4, 5, 6)
#: Log-odds from which a word counts as tied to toxic rows, by strength.
LEVELS = (3.0, 4.5, 6.0)
MARKED = 4.5

_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'")] = True
_WORD[128:] = True


def _terms(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, the first word of each text."""
    data, offsets = text_bytes(texts)
    begins, ends = runs(_WORD[data], offsets)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    compact = data[np.cumsum(inside[:-1]) > 0]
    edges = np.r_[0, np.cumsum(ends - begins)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges), pa.py_buffer(compact)).dictionary_encode()
    return [w.lower() for w in words.dictionary.to_pylist()], words.indices.to_numpy(zero_copy_only=False), np.searchsorted(begins, offsets)


def _weights(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-odds of the counts against the base rate, shrunk by one row of the base rate."""
    base = max(n_pos, 1) / max(n_pos + n_neg, 2)
    return np.log((pos + base) / (neg + 1 - base)) - np.log(base / (1 - base))


def _features(texts: pa.Array, tables: list[dict[str, float]], choice: np.ndarray) -> np.ndarray:
    """A row of numbers for each text; ``choice`` names its table of log-odds."""
    words, number, first = _words(texts)
    out = np.zeros((len(texts), len(LEVELS) * 2 + 2))
    n = np.diff(first)
    for c in np.unique(choice):
        table = tables[c]
        weight = np.array([max((table.get(t, 0.0) for t in _terms(w)), default=0.0) for w in words] + [0.0])[number]
        mine = choice == c
        for j, level in enumerate(LEVELS):
            hits = summed(weight >= level, first)
            out[mine, 2 * j], out[mine, 2 * j + 1] = np.log1p(hits)[mine], (10 * np.sqrt(hits / np.maximum(n, 1)))[mine]
        top = np.zeros(len(texts))
        some = n > 0
        if some.any():
            top[some] = np.maximum.reduceat(weight, first[:-1][some])
        out[mine, -2] = np.maximum(top, 0)[mine]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Chain:
    table: dict[str, float]
    models: list[np.ndarray]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A column for each category."""
        x = _features(texts, [self.table], np.zeros(len(texts), dtype=int))
        done = np.zeros((len(texts), 0))
        for w in self.models:
            done = np.c_[done, logistic(np.c_[x, done], w)]
        return done


def _folded(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(9)), F.lit(FOLDS)).cast("int")


def _term_counts(sample: DataFrame) -> pd.DataFrame:
    """Rows per term by fold and label, of the terms that may matter."""
    columns = [f"{kind}{f}" for kind in "np" for f in range(FOLDS)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slice of texts at a time, so that the terms of a task need not fit in memory
        for batch in sliced(batches, "text", 1 << 20):
            counts: dict[int, Counter] = {i: Counter() for i in range(2 * FOLDS)}
            words, number, first = _words(batch.column("text"))
            terms = [_terms(w) for w in words]
            for i, (label, fold) in enumerate(zip(batch.column("label").to_pylist(), batch.column("fold").to_pylist())):
                counts[label * FOLDS + fold].update({t for w in np.unique(number[first[i] : first[i + 1]]) for t in terms[w]})
            some = list(set().union(*counts.values()))
            yield pa.RecordBatch.from_pydict({"term": some} | {c: pa.array([counts[i][t] for t in some], pa.int64()) for i, c in enumerate(columns)})

    partial = sample.mapInArrow(counted, "term string, " + ", ".join(f"{c} long" for c in columns))
    total = partial.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])
    pos = sum(F.col(c) for c in columns if c[0] == "p")
    neg = sum(F.col(c) for c in columns if c[0] == "n")
    return total.where((pos >= 3) & (pos > neg)).orderBy((neg / pos), F.desc(pos), "term").limit(MAX_TERMS).toPandas()


def fit_chain(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", where: Column | None = None, max_rows: int = MAX_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> Chain:
    """The chain from at most ``max_rows`` labelled rows.

    ``toxic`` is the label; ``insult`` is a toxic row with a word tied to toxic
    rows of other folds; ``severe`` a toxic row with at least the median share
    of such words.  Without labelled rows nothing is toxic.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, max_rows, where, id_col, text_col).withColumn("fold", _folded(F.col("doc_id")))
    sizes = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", "fold").count().collect()}
    counts = _term_counts(sample)
    p, n = counts[[f"p{f}" for f in range(FOLDS)]].to_numpy(), counts[[f"n{f}" for f in range(FOLDS)]].to_numpy()

    def table(leave: int | None) -> dict[str, float]:
        keep = [f for f in range(FOLDS) if f != leave]
        rows = [sum(sizes.get((label, f), 0) for f in keep) for label in (1, 0)]
        weights = _weights(p[:, keep].sum(1), n[:, keep].sum(1), *rows)
        return {t: w for t, w in zip(counts["term"], weights.tolist()) if w >= LEVELS[0]}

    tables = [table(f) for f in range(FOLDS)]
    width = len(LEVELS) * 2 + 2

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            x = _features(batch.column("text"), tables, batch.column("fold").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").cast(pa.string()), "label": batch.column("label"), "fold": batch.column("fold")}
                | {f"x{i}": x[:, i] for i in range(width)}
            )

    rows = sample.mapInArrow(measured, "doc_id string, label int, fold int, " + ", ".join(f"x{i} double" for i in range(width)))
    got = rows.toPandas().sort_values("doc_id")
    if not len(got):
        return Chain({}, [np.r_[np.zeros(width + i), -10.0] for i in range(len(CATEGORIES))])
    x, y, fold = got[[f"x{i}" for i in range(width)]].to_numpy(), got["label"].to_numpy(), got["fold"].to_numpy()
    share = x[:, 2 * LEVELS.index(MARKED) + 1]
    middle = np.median(share[y == 1]) if (y == 1).any() else 0.0
    targets = {"insult": (y == 1) & (share > 0), "toxic": y == 1, "severe": (y == 1) & (share > 0) & (share >= middle)}
    models, done = [], np.zeros((len(x), 0))
    for name in CATEGORIES:
        given, target = np.c_[x, done], targets[name].astype(float)
        models.append(fit_logistic(given, target))
        unseen = np.zeros(len(x))
        for f in range(FOLDS):
            unseen[fold == f] = logistic(given[fold == f], fit_logistic(given[fold != f], target[fold != f]))
        done = np.c_[done, unseen]
    return Chain(table(None), models)


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """doc_id, p_insult, p_toxic, p_severe, toxic: one row per row of ``docs``, over whole texts.

    A null or empty text has no words and is not toxic.  Null and repeated ids
    are scored like others; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(chain)  # at most MAX_TERMS terms
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            p = shared.value.probabilities(batch.column("text"))
            columns = {f"p_{c}": p[:, i] for i, c in enumerate(CATEGORIES)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns | {"toxic": columns["p_toxic"] >= reject_from})

    return rows.mapInArrow(score, f"doc_id {kind}, p_insult double, p_toxic double, p_severe double, toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns; no row is moved."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(chain)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for some in sliced(iter([named]), f"c{place}", 2 << 20):
                p = shared.value.probabilities(some.column(place))[:, CATEGORIES.index("toxic")]
                yield some.filter(pa.array(p < reject_from)).rename_columns(batch.schema.names)

    return docs.mapInArrow(keep, docs.schema)
