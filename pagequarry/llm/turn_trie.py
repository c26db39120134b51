"""Prefix trie of conversations: double arrays over shards of common prefixes.

Equal conversations become one sequence of turns with its number.  Sequences are
dealt out by a prefix: the first turn or, where too many turns lie behind one
prefix, twice as many turns, until each prefix has few enough.  A shard packs
its sequences into the arrays BASE and CHECK over dense ids of its turns: the
child of node s by turn c is at BASE[s] + c, and CHECK there names s.  Walking
the arrays gives the nodes.  A node at or below its sequences' dealing depth
lies in one shard, which knows its whole subtree; the few nodes above are merged
from all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.shared import SPACE_CLASS, ship, written

#: Conversations of one block share the first turns of its first conversation; so many at most.
BLOCK, MOST_SHARED = 20, 3
#: Turns behind one prefix from which on it is dealt out by more turns, and turns of a shard.
PREFIX_TURNS, SHARD_TURNS = 400_000, 200_000
#: Characters of a turn's digest; a path is the digests of its turns.
DIGEST = 32
#: Bytes of a piece of the list of conversations that end at a node.
PIECE = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sequences(convs: DataFrame, shared_turns: Column | None = None) -> DataFrame:
    """(conv_id, path, words): each conversation rebuilt, as digests and word counts of its turns.

    Turns go by ``turn`` (null first), equal ones by their digest.  The first h
    turns are those of the block's first conversation; h is crc32 of the
    decimal id modulo 4, or ``shared_turns``.  Rows without a conversation are
    left out.  A conversation's turns are one row of 36 bytes a turn.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = convs.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(f"[^{SPACE_CLASS[1:]}+")).alias("words"),
    ).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange: conversations are put together and meet their block's first one where the block lies
    own = rows.repartition(parts, "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    heads = own.where("conv_id = base").select("base", F.slice("own", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int") if shared_turns is None else shared_turns
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    turns = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h), rest)
    full = own.join(heads, "base", "left").select("conv_id", turns.alias("turns"))
    return full.select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.words").alias("words"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path_key, first_id, ids): decimal ids of a path's conversations, comma-joined, about ``PIECE`` bytes a row."""
    key, first, held, size, rows = None, None, [], 0, []
    for batch in batches:
        for k, i in zip(batch.column("path_key").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (k != key or size > PIECE):
                rows.append((key, first, ",".join(held)))
                held, size = [], 0
            if not held:
                key, first = k, i
            held.append(str(i))
            size += len(held[-1]) + 1
        if len(rows) > 1000 or sum(len(r[2]) for r in rows) > PIECE:
            yield pa.RecordBatch.from_pydict(dict(zip(("path_key", "first_id", "ids"), map(list, zip(*rows)))))
            rows = []
    if held:
        rows.append((key, first, ",".join(held)))
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(("path_key", "first_id", "ids"), map(list, zip(*rows)))))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path_key, ends): pieces in order become one digest each; only a piece is held."""
    key, state, rows = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("path_key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                rows.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        if rows:
            yield pa.RecordBatch.from_pydict({"path_key": [r[0] for r in rows], "ends": [r[1] for r in rows]})
            rows = []
    if key is not None:
        yield pa.RecordBatch.from_pydict({"path_key": [key], "ends": [state.hexdigest()]})


def _ends(seqs: DataFrame, parts: int) -> DataFrame:
    """(path_key, ends): digest of the ids of all conversations of a path.

    Ids are dealt out by ranges of (path, id), so that a path of any number of
    conversations is spelled by many tasks; what one task takes in is hashed as
    it comes.
    """
    ids = seqs.select(F.md5("path").alias("path_key"), "conv_id")
    spelled = ids.repartitionByRange(parts, "path_key", "conv_id").sortWithinPartitions("path_key", "conv_id")
    spelled = spelled.mapInArrow(_pieces, "path_key string, first_id long, ids string")
    return spelled.repartition(parts, "path_key").sortWithinPartitions("path_key", "first_id").mapInArrow(_hashed, "path_key string, ends string")


def _prefix(k: int) -> Column:
    return F.md5(F.substring("path", 1, DIGEST * k))


def _dealt(distinct: DataFrame, prefix_turns: int) -> DataFrame:
    """Adds ``prefix`` and ``cut``: nodes from depth ``cut`` on lie in the shard of ``prefix`` alone."""
    done, rest, k = None, distinct, 1
    while True:
        keyed = rest.withColumn("prefix", _prefix(k)).withColumn("cut", F.lit(k))
        hot = written(keyed.groupBy("prefix").agg(F.sum("n_turns").alias("t")).where(F.col("t") > prefix_turns).select("prefix"), "hot-prefixes")
        if hot.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        # a sequence that ends here shares all its nodes with those that go on
        inside = keyed.join(hot, "prefix", "left_semi")
        some = keyed.join(hot, "prefix", "left_anti").unionByName(inside.where(F.col("n_turns") <= k).withColumn("cut", F.lit(k + 1)))
        done = some if done is None else done.unionByName(some)
        rest, k = inside.where(F.col("n_turns") > k).drop("prefix", "cut"), 2 * k


class DoubleArray:
    """The arrays BASE and CHECK, grown level by level; node 0 is the root."""

    def __init__(self, n_codes: int):
        self.n_codes = n_codes
        self.base = np.zeros(n_codes + 64, dtype=np.int64)
        self.check = np.full(n_codes + 64, -1, dtype=np.int64)
        self.check[0] = 0
        self.low = 1  # all places below are taken
        self.used = 1

    def _room(self, places: int) -> None:
        if places > len(self.check):
            more = max(places, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, dtype=np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, dtype=np.int64)]

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free places."""
        while True:
            free = np.flatnonzero(self.check[self.low :] < 0)[:n] + self.low
            if len(free) == n:
                self.low = int(free[0]) if n else self.low
                return free
            self._room(len(self.check) + n)

    def insert(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children of nodes that have none yet: distinct pairs, sorted by parent and code."""
        if not len(parents):
            return
        begins = np.r_[0, np.flatnonzero(np.diff(parents)) + 1]
        sizes = np.diff(np.r_[begins, len(parents)])
        # families of several children look for a base at which all their places are free
        for b, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            family = codes[b : b + n] - codes[b]
            tried = 64
            while True:
                at = self._free(tried)
                self._room(int(at[-1] + family[-1] + 1))
                fits = np.ones(len(at), dtype=bool)
                for step in family[1:].tolist():
                    fits &= self.check[at + step] < 0
                    if not fits.any():
                        break
                if fits.any():
                    break
                tried *= 4
            place = int(at[np.argmax(fits)])
            self.base[parents[b]] = place - codes[b]
            self.check[place + family] = parents[b]
        one = begins[sizes == 1]
        at = self._free(len(one))
        self.base[parents[one]] = at - codes[one]
        self.check[at] = parents[one]
        self.used += len(parents)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by these codes; -1 where there is none."""
        at = self.base[nodes] + codes
        inside = (at > 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == nodes), at, -1)


def pack(codes: np.ndarray, bounds: np.ndarray, n_codes: int) -> DoubleArray:
    """The double array of the sequences ``codes[bounds[i] : bounds[i + 1]]``."""
    trie = DoubleArray(n_codes)
    node = np.zeros(len(bounds) - 1, dtype=np.int64)
    active, depth = np.flatnonzero(np.diff(bounds) > 0), 0
    while len(active):
        turn = codes[bounds[active] + depth]
        pairs = np.unique(node[active] * n_codes + turn)
        trie.insert(pairs // n_codes, pairs % n_codes)
        node[active] = trie.step(node[active], turn)
        depth += 1
        active = active[np.diff(bounds)[active] > depth]
    return trie


_OUT = [
    ("line", pa.list_(pa.string())), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.string()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
]
_OUT_SQL = (
    "line array<string>, conv_id long, depth long, parent_conv_id long, parent_key string, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, ends string"
)


def _path_key(path: str, depth: int) -> str:
    return hashlib.md5(path[: depth * DIGEST].encode()).hexdigest()


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of a shard.  Nodes above the dealing depth come with ``line``, the keys from the root to them,
    and with what their subtrees hold below that depth only."""
    paths = table.column("path").to_pylist()
    turns = np.array([len(p) // DIGEST for p in paths], dtype=np.int64)
    bounds = np.r_[0, np.cumsum(turns)]
    names, codes = np.unique(np.frombuffer("".join(paths).encode(), dtype=f"S{DIGEST}"), return_inverse=True)
    words = pc.list_flatten(table.column("words")).to_numpy().astype(np.int64)
    n, ids, cut = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "conv_id", "cut"))
    trie = pack(codes, bounds, max(len(names), 1))

    places = len(trie.check)
    count, least = np.zeros(places, dtype=np.int64), np.full(places, np.iinfo(np.int64).max)
    depth_of, last_words, private = np.full(places, -1, dtype=np.int64), np.zeros(places, dtype=np.int64), np.zeros(places, dtype=bool)
    sample, ends_at = np.zeros(places, dtype=np.int64), np.zeros(len(paths), dtype=np.int64)
    node, rows, depth = np.zeros(len(paths), dtype=np.int64), np.arange(len(paths)), 0
    levels = []
    while len(rows):
        at = node[rows]
        np.add.at(count, at, n[rows])
        np.minimum.at(least, at, ids[rows])
        depth_of[at], sample[at], private[at] = depth, rows, cut[rows] <= depth
        if depth:
            last_words[at] = words[bounds[rows] + depth - 1]
        levels.append(np.unique(at))
        ends_at[rows] = at
        rows = rows[turns[rows] > depth]
        node[rows] = trie.step(node[rows], codes[bounds[rows] + depth])
        depth += 1

    children, leaves, saved = (np.zeros(places, dtype=np.int64) for _ in range(3))
    for level in reversed(levels):
        own = level[private[level]]
        leaves[own] += children[own] == 0
        saved[own] += (count[own] - 1) * last_words[own]
        if depth_of[level[0]] > 0:
            up = trie.check[own]
            np.add.at(children, up, 1)
            np.add.at(leaves, up, leaves[own])
            np.add.at(saved, up, saved[own])
    nodes = np.concatenate(levels)
    ends = np.full(places, None, dtype=object)
    ends[ends_at] = table.column("ends").to_pylist()
    upper = ~private[nodes]
    parent = trie.check[nodes]
    above = (depth_of[nodes] > 0) & ~private[parent]
    lines = [[_path_key(paths[sample[x]], d) for d in range(depth_of[x] + 1)] if u else None for x, u in zip(nodes, upper)]
    keys = [_path_key(paths[sample[x]], depth_of[x] - 1) if a else None for x, a in zip(nodes, above)]
    known = [int(least[p]) if private[p] and d else None for p, d in zip(parent, depth_of[nodes])]
    columns = [lines, least[nodes], depth_of[nodes], known, keys, count[nodes], children[nodes], leaves[nodes], saved[nodes], last_words[nodes], list(ends[nodes])]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _OUT)], names=[c for c, _ in _OUT])


def _merged(upper: DataFrame) -> DataFrame:
    """The nodes above the dealing depth: parts of all shards added up, then what lies below them.

    A node tells all its ancestors what it adds, so depth costs no rounds.
    """
    one = upper.groupBy(F.element_at("line", -1).alias("key")).agg(
        F.first("line").alias("line"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.first("words").alias("words"), F.max("ends").alias("ends"),
    )
    one = written(one, "upper-nodes")
    beside = one.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("upper_children"))
    full = one.join(beside, "key", "left").withColumn("n_children", F.col("below") + F.coalesce("upper_children", F.lit(0)))
    adds = full.select(
        F.explode("line").alias("key"), (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("l"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("s"),
    ).groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    parents = one.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return written(full.join(adds, "key").join(parents, "parent_key", "left").select("key", *_COLUMNS), "merged-nodes")


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def nodes(seqs: DataFrame, prefix_turns: int = PREFIX_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, path, words), from the root on.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (of the subtree), ends_sha256 (of the members
    that end there).  No conversations give no nodes.
    """
    spark = seqs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seqs = written(seqs, "sequences")
    distinct = seqs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"))
    distinct = distinct.withColumn("path_key", F.md5("path")).join(_ends(seqs, parts), "path_key")
    distinct = written(distinct.withColumn("n_turns", F.size("words")), "paths")
    total = distinct.agg(F.sum("n_turns")).first()[0] or 0
    n_shards = total // shard_turns + 1
    dealt = _dealt(distinct, prefix_turns).withColumn("shard", F.pmod(F.xxhash64("prefix"), F.lit(n_shards)))
    made = written(dealt.select("shard", "path", "words", "n", "conv_id", "cut", "ends").groupBy("shard").applyInArrow(shard_nodes, _OUT_SQL), "nodes")
    upper = _merged(made.where("line IS NOT NULL"))
    below = made.where("line IS NULL")
    tops = below.where("parent_key IS NOT NULL").drop("parent_conv_id")
    tops = tops.join(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    every = upper.select(*_COLUMNS).unionByName(below.where("parent_key IS NULL").select(*_COLUMNS)).unionByName(tops.select(*_COLUMNS))
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA))).drop("ends")


def conversation_trie(convs: DataFrame, **sizes: int) -> DataFrame:
    """The nodes of the rebuilt conversations of ``convs`` (conv_id, turn, role, text).

    Null roles and texts are empty, null turns come first, rows without a
    conversation are left out, equal rows are turns of their own; other columns
    are ignored and an empty table has no nodes.
    """
    return nodes(sequences(convs), **sizes)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS ts FROM turns GROUP BY conv_id),
shared AS (
  SELECT conv_id, ts, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) for z in range(8)]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))),
    CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM own),
full_ones AS (
  SELECT s.conv_id, list_concat(coalesce(b.ts, [])[1:s.h], s.ts[s.h + 1:]) AS ts
  FROM shared s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 20),
spots AS (
  SELECT conv_id, d, len(ts) AS n, ts[d].w AS words,
         array_to_string(list_transform(ts[1:d], lambda t: t.d), '') AS path
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM full_ones)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words), 0) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM spots GROUP BY path, d),
kids AS (SELECT path[:-33] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
own_parts AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.words AS saved
  FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (
  SELECT path[1:32 * up] AS path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT path, leaf, saved, unnest(range(0, depth + 1)) AS up FROM own_parts) GROUP BY ALL)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own_parts o JOIN sums s USING (path) LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[1:32 * (o.depth - 1)]
"""
