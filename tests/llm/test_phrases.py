"""Collocations against plain counting, and their stream passes."""

import re
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pagequarry.llm import phrases

COLUMNS = "doc_id long, text string, lang string, key string, n long, hash string"
ROWS = [
    (1, "New York, new york! New  York city hall. the city hall", "en"), (2, "new york city hall\nnew york city hall", "en"),
    (2, "new york city hall\nnew york city hall", "en"), (3, None, "en"), (4, "", None), (5, "a b a b a b a b", None), (6, "a b a b c", "und"),
    (7, "x\x01y z\x0bx\x01y z x\x01y z", "l\tg"), (8, "\ue000a b \ue000a b \x00 b \ue000a b", "l\tg"), (None, "état d'âme, état d'âme 中文 字 中文 字", "fr"),
    (9, "one", "fr"), (10, " \t ; ", "fr"), (11, " ".join(["tick tock"] * 3000), "de"), (12, "up down left right far up down left right far", "de"),
]


def brute(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(p, q) for q in kept for i in range(len(q)) for p in (q[i:j] for j in range(i + 2, len(q) + 1)) if len(p) < len(q)}
        gone = {p for p, q in inside if kept[q] >= kept.get(p, 0)}
        best = []
        for p, a in kept.items():
            if p not in gone:
                cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 2000), (3, 4), (1, 50)])
def test_collocations_of_odd_rows(spark, least, top):
    docs = spark.createDataFrame([(i, t, lang, "k", 1, "h") for i, t, lang in ROWS], COLUMNS)
    got = phrases.collocations(docs, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, least, top)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).count() == 0


def test_hot_first_pairs_are_merged(spark):
    """Every pair is hot: windows of one pair lie in many partitions and still give one count."""
    rows = [(i, f"of the w{i % 7} x{i % 3} of the", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, 5).collect()) == brute(rows, 5, 2000)


def test_runs_go_on_over_batches():
    keys = ["en\ta\tb", "en\ta\tb", "en\ta\tb\tc", "en\ta\tb\tc", "en\ta\tb\td", "en\ta\tc"]
    rows = pa.table({"key": keys, "n": [1, 2, 3, 4, 5, 6], "hot": [False] * 6})
    for size in (1, 2, 3, 6):
        out = [r for b in phrases._run_counts(5)(iter(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {r["key"]: r["n"] for r in out} == {"en\ta\tb": 15, "en\ta\tb\tc": 7, "en\ta\tb\td": 5, "en\ta\tc": 6}
        assert len(out) == 4


def test_scores_beyond_64_bits(spark):
    """a * n * 1000 passes 64 bits: counts as the join hands them on, divided exactly."""
    a, n, left, right = 9_000_000_000, 3_000_000_000_001, 9_000_000_007, 10_000_000_019
    got = phrases.scored(
        spark.createDataFrame([("en", "x\ty", a, [left], [right], n)], "lang string, words string, a long, lefts array<long>, rights array<long>, total long"), 5
    ).first()
    assert got["score"] == 1000 * a * n // (left * right)


def test_equal_hashes_are_counted_in_any_room():
    arrays = [np.array(a, dtype=np.int64) for a in ([5, -1, 5], [], [5, 7, -1, -1], [2**62, -(2**62)], [7])]
    want = Counter(int(x) for a in arrays for x in a)
    for room in (1, 2, 3, 4, 10, 100):
        got, rows = Counter(), 0
        for batch in phrases._counted_hashes(iter(arrays), room):
            for r in batch.to_pylist():
                got[r["hash"]] += r["n"]
                rows += 1
        assert got == want and rows <= sum(want.values())
    assert rows == len(want)
    assert list(phrases._counted_hashes(iter(arrays[1:2]))) == []
    n = 200_000
    many = list(phrases._counted_hashes(iter([np.repeat(np.arange(n), 3)])))
    assert len(many) > 1 and sum(b.num_rows for b in many) == n and all((np.asarray(b.column("n")) == 3).all() for b in many)


class Rows:
    """Stands for a table and keeps the functions of its tasks, so that a task runs in this process."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def __init__(self):
        self.tasks = []

    def mapInArrow(self, task, schema):
        self.tasks.append(task)
        return self

    def groupBy(self, *keys):
        return self

    agg = repartition = sortWithinPartitions = groupBy


def test_hashes_are_summed_over_batches():
    rows = pa.table({"hash": [-3, -3, 0, 4, 4, 4, 9], "n": [1, 2, 2, 1, 1, 1, 3]})
    for size in (1, 2, 3, 7):
        for least, want in ((1, {-3: 3, 0: 2, 4: 3, 9: 3}), (3, {-3: 3, 4: 3, 9: 3}), (4, {})):
            batches = [b for b in rows.to_batches(max_chunksize=size) for b in (b, b.slice(0, 0))]
            out = [(r["hash"], r["n"]) for b in phrases._summed_hashes(least)(iter(batches)) for r in b.to_pylist()]
            assert len(out) == len(want) and dict(out) == want
    assert sum(b.num_rows for b in phrases._summed_hashes(1)(iter([]))) == 0


def test_a_task_counts_pairs_in_bounded_memory(spark):
    """25 MB of text with two million different pairs: it took 520 MB more on such texts before."""

    def mb(name):
        return next(int(x.split()[1]) / 1024 for x in Path("/proc/self/status").read_text().splitlines() if x.startswith(name))

    rng, rows = np.random.default_rng(1), Rows()
    names = np.array([f"w{i}" for i in range(2000)])
    batches = [pa.record_batch({"lang": ["en"] * 200, "text": [" ".join(names[rng.integers(0, 2000, 2000)]) for _ in range(200)]}) for _ in range(11)]
    phrases._pair_counts(rows, phrases.HashFilter(np.full(64, 2**64 - 1, dtype=np.uint64)))
    pa.default_memory_pool().release_unused()
    Path("/proc/self/clear_refs").write_text("5")  # the peak begins anew
    before = mb("VmRSS")
    n = sum(b.num_rows for b in rows.tasks[0](iter(batches)))
    assert n > 2_000_000
    assert mb("VmHWM") - before < 200
