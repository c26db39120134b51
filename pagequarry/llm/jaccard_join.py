"""Similarity join on word shingles: a sparse product of documents by shingles.

Documents with the same set are one node.  Shingles are ordered rare first by
a sketch of counts over all documents, and only the part of a set that any
partner must meet (its prefix) enters the product.  Overlaps are accumulated
per pair in blocks of the product; pairs below the bound that the sizes set are
discarded, the others are compared as whole sets.

Shingles with the same list of documents are one row of the product, with their
number as its weight.  A row of many documents is never squared at once.  First
its documents are compared with one of them; what is linked forms components,
and only documents of different components meet again, until all such pairs
have been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.components import connected
from pagequarry.llm.labelled import runs, text_bytes
from pagequarry.llm.shared import fresh_name, ship, written
from pagequarry.llm.tokens import sliced

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bits of a shingle's hash that name its counter in the sketch that orders shingles, and counters of one row (16 MB, in 1,024 rows).
SKETCH_BITS, SKETCH_ROW = 22, 1 << 12
#: Orders in which rows choose the document that the others are compared with.
STAR_ORDERS = 3
#: Bits of the number of hash blocks for the bound of a pair's overlap: about one block a shingle, within these.
BLOCK_BITS = (8, 20)
#: Bits of the filter that spares texts without a possible partner; false hits only cost time.
FILTER_BITS = 1 << 23
SLICE = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    begins, ends = runs(~_SPACE[data], offsets)
    first = np.searchsorted(begins, offsets)
    inside = np.arange(len(data)) - np.repeat(np.r_[0, begins], np.diff(np.r_[0, begins, len(data)]))
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(inside.max(initial=0)), _ODD[0], dtype=np.uint64)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(7)) * power[inside], dtype=np.uint64)])
    words = _mixed(total[ends] - total[begins] + (ends - begins).astype(np.uint64) * _ODD[1])
    windows = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
    for i in range(WORDS):
        windows += words[i : i + len(windows)] * _ODD[i % len(_ODD)]
    windows = _mixed(windows)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(windows[a : b - WORDS + 1]))
        elif b > a:
            short = (words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mixed(np.array([short ^ _ODD[4]], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, as many as leave too few for a link outside."""
    n = len(shingles)
    order = np.argsort(counts[_counter(shingles)], kind="stable")
    return shingles[order][: n - (PERCENT * n + 99) // 100 + 1]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; then the task's counters of the sketch, with a null set."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    for batch in sliced(batches, "text", SLICE):
        sets = shingle_sets(batch.column("text"))
        np.add.at(counts, _counter(np.concatenate(sets)) if sets else [], 1)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            "counters": pa.nulls(len(sets), pa.binary()),
        })
    rows = counts.reshape(-1, SKETCH_ROW)
    used = np.flatnonzero(rows.any(axis=1))
    for some in np.array_split(used, max(1, len(used) // 64)):
        if len(some):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(some, pa.int64()), "n": pa.nulls(len(some), pa.int64()), "set_key": pa.nulls(len(some), pa.binary()),
                "counters": pa.array([rows[i].tobytes() for i in some], pa.binary()),
            })


def _summed_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of each sketch row, added up over the rows of a task, which come sorted."""
    at, total = None, None
    for batch in batches:
        for i, counters in zip(batch.column("doc_id").to_pylist(), batch.column("counters")):
            own = np.frombuffer(counters.as_buffer(), dtype=np.int32)
            if i == at:
                total = total + own
                continue
            if at is not None:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([at], pa.int64()), "counters": pa.array([total.tobytes()], pa.binary())})
            at, total = i, own
    if at is not None:
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([at], pa.int64()), "counters": pa.array([total.tobytes()], pa.binary())})


def _sketch(signatures: DataFrame) -> np.ndarray:
    rows = signatures.where("counters IS NOT NULL").select("doc_id", "counters").repartition(64, "doc_id").sortWithinPartitions("doc_id")
    counts = np.zeros((1 << SKETCH_BITS) // SKETCH_ROW * SKETCH_ROW, dtype=np.int32).reshape(-1, SKETCH_ROW)
    for r in rows.mapInArrow(_summed_counters, "doc_id long, counters binary").toLocalIterator():  # 16 MB in all
        counts[r["doc_id"]] = np.frombuffer(r["counters"], dtype=np.int32)
    return counts.ravel()


def _nodes(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, n, prefix): one row per distinct set, named by its smallest doc_id."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text"))
            keep = [i for i, s in enumerate(sets) if len(s)]
            cut = [_prefix(sets[i], shared.value).view(np.int64) for i in keep]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(keep, pa.int64())), "n": pa.array([len(sets[i]) for i in keep], pa.int64()),
                "set_key": pa.array([hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in keep], pa.binary()),
                "prefix": pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, cut)]), pa.int32()), pa.array(np.concatenate(cut) if cut else np.zeros(0, np.int64))
                ),
            })

    made = rows.where("doc_id IS NOT NULL").mapInArrow(prefixes, "doc_id long, n long, set_key binary, prefix array<long>")
    one = made.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return written(one.drop("set_key"), "nodes")


def _postings(nodes: DataFrame) -> DataFrame:
    """(shingle, node, n, pos) of the prefix shingles that meet another node."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    # counted by 32 bits of the shingle: a collision only lets a row through
    short = F.shiftright("shingle", 32).cast("int")
    met = rows.select(short.alias("short")).groupBy("short").count().where("count > 1").select("short")
    some = written(rows.join(met, short == F.col("short"), "left_semi"), "some-postings")
    exact = some.groupBy("shingle").count().where("count > 1").select("shingle")
    return written(some.join(exact, "shingle", "left_semi"), "postings")


def _possible(n_a: Column, n_b: Column) -> Column:
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size over the ids' hashes."""
    at = ids.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("at"))
    words = at.selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS mask")
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[got["word"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits


def _block_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles each block of hashes has; a power of two of blocks, at least one a shingle up to the limit."""
    bits = min(max((len(shingles) - 1).bit_length(), BLOCK_BITS[0]), BLOCK_BITS[1])
    return np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)


def _coarser(blocks: Column, other: Column) -> Column:
    """``blocks`` at the number of the other side; sizes that can link differ by one halving at most."""
    pairs = F.sequence(F.lit(0), F.size(blocks) - 2, F.lit(2))
    return F.when(F.size(blocks) > F.size(other), F.transform(pairs, lambda i: F.get(blocks, i) + F.get(blocks, i + 1))).otherwise(blocks)


def _from_texts(rows: DataFrame, wanted: DataFrame, counted: bool) -> DataFrame:
    """(node, shingles), or (node, blocks): the sets of the wanted nodes, or their sizes by block of hashes.

    A filter of fixed size over the wanted ids lets few other texts through;
    those find no partner later.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_id_filter(wanted))
    hashed = rows.where("doc_id IS NOT NULL").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    name, kind = ("blocks", pa.int32()) if counted else ("shingles", pa.int64())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.uint64)
            hit = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            for some in sliced(iter([batch.filter(pa.array(hit))]), "text", SLICE):
                found = [_block_counts(s) if counted else s.view(np.int64) for s in shingle_sets(some.column("text"))]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), kind))], names=["node", name]
                )

    return written(hashed.mapInArrow(sets, f"node long, {name} array<{'int' if counted else 'bigint'}>"), name)


def _ids_of(pairs: DataFrame) -> DataFrame:
    # each column's few distinct ids first: pairs are many more
    return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct()


def _with_both(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col(name).alias("va"))
    right = sets.select(F.col("node").alias("b"), F.col(name).alias("vb"))
    return pairs.join(left, "a").join(right, "b")


def _enough(both: Column, total: Column) -> Column:
    return 100 * both >= PERCENT * (total - both)


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link.

    First the product is bounded block by block: sets cannot share more of a
    block of hashes than the smaller one has there.  Only pairs that the sum of
    these bounds leaves are compared as sets.
    """
    size = lambda v: F.aggregate(v, F.lit(0), lambda t, x: t + x)
    most = size(F.zip_with(_coarser(F.col("va"), F.col("vb")), _coarser(F.col("vb"), F.col("va")), lambda x, y: F.least(x, y)))
    total = size(F.col("va")) + size(F.col("vb"))
    left = _with_both(pairs, _from_texts(rows, _ids_of(pairs), True), "blocks").where(_enough(most, total))
    left = written(left.select("a", "b").distinct(), "bounded")
    both, total = F.size(F.array_intersect("va", "vb")), F.size("va") + F.size("vb")
    return _with_both(left, _from_texts(rows, _ids_of(left), False), "shingles").where(_enough(both, total)).select("a", "b")


def _merged(postings: DataFrame) -> DataFrame:
    """(row, node, n, pos): shingles with the same list of documents as one row of the product.

    ``pos`` is the first of their places in the document's prefix.  Lists that
    collide share a row, which only costs time.
    """
    lists = postings.groupBy("shingle").agg(
        F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))).alias("row")
    )
    rows = postings.join(lists, "shingle").groupBy("row", "node", "n").agg(F.min("pos").alias("pos"))
    return written(rows, "rows")


def _placed(merged: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows with documents of several components, and the component of each document."""
    placed = merged.withColumn("comp", F.col("node"))
    if comps is not None:
        known = comps.select("node", F.col("component").alias("known"))
        placed = merged.join(known, "node", "left").withColumn("comp", F.coalesce("known", "node")).drop("known")
    split = placed.groupBy("row").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("row")
    return written(placed.join(split, "row", "left_semi"), "placed")


def _can_link(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Whether sets that meet first at these places can share enough: all before them differs, as both are in one order."""
    most = F.least(n_a - pos_a, n_b - pos_b)
    return most * (100 + PERCENT) >= PERCENT * (n_a + n_b)


def _star_pairs(placed: DataFrame, orders: list[Column]) -> DataFrame:
    """Each row's documents with one of another component, chosen by the smallest hash of each order.

    A place bound here would spare pairs, but the components it leaves apart
    cost the product more of them.
    """
    leaders = placed.groupBy("row").agg(
        F.array(
            *[F.min(F.struct(o.alias("o"), F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("comp").alias("lead_comp"))) for o in orders]
        ).alias("leaders")
    )
    met = placed.join(leaders, "row").select("node", "n", "comp", F.explode("leaders").alias("l")).select("node", "n", "comp", "l.*")
    met = met.where((F.col("comp") != F.col("lead_comp")) & _possible(F.col("n"), F.col("lead_n")))
    return met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _cross_pairs(placed: DataFrame) -> DataFrame:
    """All pairs of different components that meet early enough in both prefixes.

    A pair that links meets first in a row that passes this bound, so later
    rows of the pair need not.  The bound is part of the join: of the rows that
    a group of near copies shares, hardly any but the first ones pass it.
    """
    names = ["node", "n", "pos", "comp"]
    a, b = placed.select("row", *[F.col(c).alias(f"{c}_a") for c in names]), placed.select("row", *[F.col(c).alias(f"{c}_b") for c in names])
    met = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & _possible(F.col("n_a"), F.col("n_b"))
    met = a.join(b, (a["row"] == b["row"]) & met & _can_link(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _components(nodes: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(node, component) of the linked nodes, or None without links.

    A star of one order over all documents links most of a group with few
    pairs; stars of other orders and the product itself then see only rows whose
    documents are still in different components.
    """
    merged = _merged(_postings(nodes))
    more = [F.xxhash64("node", "row", F.lit(i)) for i in range(1, STAR_ORDERS)]
    tried = links = comps = None
    for pairs_of in (lambda p: _star_pairs(p, [F.xxhash64("node")]), lambda p: _star_pairs(p, more), _cross_pairs):
        pairs = pairs_of(_placed(merged, comps))
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = written(_linked(pairs, rows), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comps = written(connected(links), "components")
    return comps


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    A null text, or one without words, has an empty set and links with nothing.
    Equal sets link.  Rows that repeat an id are one document: a link of one of
    them counts for all.  Rows without an id get a null component and link with
    nothing.  An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signatures = written(rows.mapInArrow(_signatures, "doc_id long, n long, set_key binary, counters binary"), "signatures")
    nodes = _nodes(rows, _sketch(signatures))
    comps = _components(nodes, rows)
    members = signatures.where("set_key IS NOT NULL").drop("counters")
    same = members.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    named = members.join(same, "set_key", "left")
    if comps is not None:
        named = named.join(comps, "node", "left")
    else:
        named = named.withColumn("component", F.lit(None).cast("long"))
    own = F.coalesce("component", "node", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group, with all their columns; rows without an id stay."""
    groups = similar_groups(docs, id_col, text_col)
    name = fresh_name("gone")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")
