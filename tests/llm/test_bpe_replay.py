"""Merge replay against the tiktoken library and against one merge at a time."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pagequarry.llm import bpe_replay

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  \n\n x", "a", "a" * 5000, "-" * 70_000, " " * 3001 + "end", "don't we'll I'M 'ss", "état 中文字 😀😀 naïve ñ", "<|endoftext|> <|END|>",
    "x\x00y\x0bz\x1f", "tab\tand\r\nlines\n\n\n", "1234567 3.14 1,000", " nbsp em", "abcabcabcab aaa aaaa aaaaa", "word " * 20_000,
    "é" * 999, "!?!?!?...,,,;;;", "the the  the   the", "".join(chr(c) for c in range(1, 700)),
]


@pytest.fixture(scope="module")
def ranks():
    return bpe_replay.Ranks(PATH)


@pytest.fixture(scope="module")
def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out.append((i, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.mark.parametrize("size", [0, 40, 100_000])
def test_odd_texts(spark, library, size):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)] + [(4, "a"), (4, "other text")]
    docs = spark.createDataFrame([(*r, "p", 1, [1]) for r in rows], "doc_id long, text string, part string, n long, ids array<int>")
    coded = bpe_replay.encoded(docs, PATH, PATTERN, lexicon_size=size)
    got = sorted((tuple(r) for r in bpe_replay.digests(coded, PATH).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert got == expected(library, rows)
    trip = bpe_replay.round_trip(docs, PATH, PATTERN, lexicon_size=size).collect()
    assert sorted((tuple(r) for r in trip), key=lambda r: (r[0] is None, r[0] or 0, r[2])) == got
    back = sorted((r["doc_id"], bytes(r["data"])) for r in bpe_replay.decoded(coded, PATH).where("doc_id IS NOT NULL").collect())
    assert back == sorted((i, (t or "").encode()) for i, t in rows if i is not None)


def test_small_table_and_no_rows(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in bpe_replay.digests(bpe_replay.encoded(docs, PATH, PATTERN), PATH).collect())
    assert got == expected(library, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bpe_replay.round_trip(docs.limit(0), PATH, PATTERN).count() == 0 and bpe_replay.encoded(docs.limit(0), PATH, PATTERN).count() == 0


def one_merge_at_a_time(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, i = min((ranks.id_of.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks.id_of[p] for p in parts]


def test_replay_equals_one_merge_at_a_time(ranks):
    dice = random.Random(5)
    words = [bytes(dice.choices(b"aeinrst ", k=dice.randrange(0, 30))) for _ in range(500)] + [bytes(dice.randbytes(12)) for _ in range(100)]
    ids, sizes = bpe_replay.replay(words, ranks)
    assert sizes.sum() == len(ids)
    at = 0
    for word, n in zip(words, sizes):
        assert ids[at : at + n].tolist() == one_merge_at_a_time(word, ranks)
        at += n


def test_pairs_of_lower_rank_come_first(tmp_path):
    """A vocabulary in which a merge makes a pair that ranks before it."""
    tokens = [bytes([b]) for b in range(256)] + [b"bab", b"ab", b"abab", b"babab"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    odd = bpe_replay.Ranks(str(path))
    words = [b"ababab", b"babab", b"bababababa", b"abb", b"", b"aabab"]
    ids, sizes = bpe_replay.replay(words, odd)
    want = [one_merge_at_a_time(w, odd) for w in words]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
