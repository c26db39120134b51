"""The conversation trie against plain dictionaries and the arrays against sets of paths."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import oracle
from pagequarry.llm import turn_trie

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string, path string, n long, ends string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h]) + tuple(turns[h:])
    return out


def brute(rows):
    full = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ms in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ms) - 1) * words
    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(full[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ms), len(p), parent, len(ms), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    dice = random.Random(3)
    rows = [(7, None, None, None), (7, None, "user", "a"), (7, 1, "user", "b c"), (None, 1, "user", "lost"), (40, 0, "u", ""), (-5, 0, "u", "neg ative")]
    rows += [(41, t, "u", f"same {t}") for t in range(5)] * 2  # repeated rows are turns of their own
    for c in range(100, 400):
        for t in range(dice.randrange(1, 7)):
            # a hot first turn, few different ones behind it
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "hello there" if t == 0 and c % 3 else f"w{dice.randrange(3)} x\ty"))
    rows += [(500 + c, t, "user", f"long {t}") for c in range(4) for t in range(60 + c)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"prefix_turns": 20, "shard_turns": 30}, {"prefix_turns": 1, "shard_turns": 1}])
def test_nodes_of_odd_conversations(spark, sizes):
    rows = odd_rows()
    convs = spark.createDataFrame([(*r, "p", 1, "e") for r in rows], COLUMNS)
    got = turn_trie.conversation_trie(convs, **sizes).select(*OUT)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_small_table_equals_sql(spark):
    got = turn_trie.conversation_trie(spark.read.parquet(f"{SF}/conversations.parquet"), prefix_turns=40, shard_turns=64)
    ok, message = oracle.compare(got, oracle.connect(SF), turn_trie.SQL)
    assert ok, message


def test_no_rows(spark):
    assert turn_trie.conversation_trie(spark.createDataFrame([], COLUMNS)).count() == 0


def test_ids_of_one_path_are_hashed_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE", 50)
    import pyarrow as pa

    ids = list(range(7, 7 + 400))
    rows = pa.table({"path_key": ["a"] * 300 + ["b"] * 100, "conv_id": ids}).to_batches(max_chunksize=33)
    pieces = list(turn_trie._pieces(iter(rows)))
    got = {r["path_key"]: r["ends"] for b in turn_trie._hashed(iter(pieces)) for r in b.to_pylist()}
    assert sum(b.num_rows for b in pieces) > 20
    assert got == {k: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for k, x in (("a", ids[:300]), ("b", ids[300:]))}


def test_double_array_holds_just_its_paths():
    dice = random.Random(9)
    paths = {tuple(dice.randrange(40) for _ in range(dice.randrange(0, 6))) for _ in range(3000)}
    ordered = sorted(paths)
    codes = np.array([c for p in ordered for c in p], dtype=np.int64)
    trie = turn_trie.pack(codes, np.r_[0, np.cumsum([len(p) for p in ordered])], 40)
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert trie.used == len(prefixes) and (trie.check[1:] >= 0).sum() == len(prefixes) - 1
    for _ in range(3000):
        probe, node = tuple(dice.randrange(40) for _ in range(dice.randrange(1, 6))), np.zeros(1, dtype=np.int64)
        for d, c in enumerate(probe):
            node = trie.step(node, np.array([c]))
            assert (node[0] >= 0) == (probe[: d + 1] in prefixes)
            if node[0] < 0:
                break
