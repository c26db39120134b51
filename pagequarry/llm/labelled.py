"""Bounded labelled samples and small linear models for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.shared import written


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, where: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents, chosen by hash.

    Null ids and null labels are left out; of several labels of a document the
    largest counts.  The chosen ids are the only broadcast, bounded by ``max_rows``.
    Copies would count a text's words many times: of documents whose smallest
    shingle is the same, the one with the smallest id is used.
    """
    kept = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if where is None else where))
    one = kept.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(_with_smallest, f"doc_id {kind}, text string, label int, near long")
    one_each = found.groupBy("near").agg(F.min(F.struct("doc_id", "label", "text")).alias("r")).select("r.*")
    return written(one_each.dropDuplicates(["doc_id"]), "labelled")


def _with_smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pagequarry.llm.jaccard_join import shingle_sets
    from pagequarry.llm.tokens import sliced

    for batch in sliced(batches, "text", 2 << 20):
        near = pa.array([int(s[0].view(np.int64)) if len(s) else 0 for s in shingle_sets(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "label")), near], names=["doc_id", "text", "label", "near"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        w -= step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and where each text begins (and the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values, none across a text's begin."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, ~inside[:-1]]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = np.flatnonzero(new & inside)
    stop = np.r_[~inside[1:], True]
    stop[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return begins, np.flatnonzero(stop & inside) + 1


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
