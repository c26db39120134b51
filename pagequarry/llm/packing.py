"""Harmonic packing of documents into sequences of a fixed capacity.

A length of class k lies in (capacity / (k + 1), capacity / k], so k pieces of
class k make one sequence whatever their order.  Documents are cut so that
every piece fills its share of a sequence almost wholly.  Workers number their
pieces per class; adding the pieces of earlier workers gives ranks, and rank
and class alone place a piece, so sequences are filled independently.  Only
what is left of the classes, fewer than k pieces of each, is packed in one
task; its size depends on the capacity and not on the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.shared import ship, written
from pagequarry.llm.tokens import crc32_of, encoder, sliced

CAPACITY = 4096
END_ID = 2
#: A piece of class k is left uncut when k of its size waste at most 1 / SLACK.
SLACK = 64

_PIECES = ("part", "cls", "local", "doc_id", "start", "length", "ids_crc32", "doc_tokens")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` tokens, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if (capacity - k * rest) * SLACK <= capacity:
            pieces.append((rest, k))
            break
        size = capacity // (k + 1)
        pieces.append((size, capacity // size))
        rest -= size
    return pieces


def _cut_documents(batches: Iterator[pa.RecordBatch], path: str, drops_space: bool, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    tokenizer = encoder(path, drops_space)
    part, counts, plans = TaskContext.get().partitionId(), Counter(), {}
    schema = pa.schema([(c, pa.int64()) for c in _PIECES])
    for batch in sliced(batches, "text"):
        out = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text"))):
            ids, start = np.append(ids, np.int32(end_id)), 0
            rest = len(ids) % capacity
            plan = plans.setdefault(rest, cuts(rest, capacity))
            for length, cls in [(capacity, 1)] * (len(ids) // capacity) + plan:
                out.append((part, cls, counts[cls], doc_id, start, length, crc32_of(ids[start : start + length]), len(ids)))
                counts[cls] += 1
                start += length
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)


def _first_fit(capacity: int):
    """Decreasing first fit of the classes' remainders; their number is bounded by the capacity."""

    def pack(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "cls", "rank"], ascending=[False, True, True], ignore_index=True)
        room = np.full(len(left), capacity)
        bins, offsets = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        for i, length in enumerate(left["length"]):
            b = int(np.argmax(room >= length))
            bins[i], offsets[i] = b, capacity - room[b]
            room[b] -= length
        return left.assign(bin=bins, offset=offsets)

    return pack


def packed(
    docs: DataFrame, tokenizer_path: str, drops_space: bool = True, end_id: int = END_ID, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone.  Repeated ids and null ids are
    packed like others.  An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(
        lambda batches: _cut_documents(batches, tokenizer_path, drops_space, end_id, capacity), ", ".join(f"{c} long" for c in _PIECES)
    )
    pieces = written(made, "pieces")
    counts = pieces.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "part", "cls", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
    )
    # one row per class: at most as many as the capacity
    full = counts.groupBy("cls").agg(F.floor(F.sum("n") / F.col("cls")).alias("full"))
    below = Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    firsts = full.select("cls", "full", F.coalesce(F.sum("full").over(below), F.lit(0)).alias("first"))
    places = bases.join(firsts, "cls")
    ranked = (
        pieces.join(places, ["part", "cls"])
        .withColumn("rank", F.col("base") + F.col("local"))
        .withColumn("bin", F.floor(F.col("rank") / F.col("cls")))
    )
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    inside = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.where(F.col("bin") < F.col("full")).withColumn("sequence_id", F.col("first") + F.col("bin"))
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = ranked.where(F.col("bin") >= F.col("full")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank")
    schema = ", ".join(f"{c} long" for c in (*rest.columns, "bin", "offset"))
    last = rest.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        lambda left: _first_fit(capacity)(left.drop(columns="one")), schema
    )
    total = full.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n")).first()["n"]
    tail = last.withColumn("sequence_id", F.col("bin") + F.lit(total))
    return filled.select(*result).unionByName(tail.select(*result))
