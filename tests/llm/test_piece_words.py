"""Lattices of many words at once against the fold, and documents that stay where they are."""

import random

import public_tokenizers
import pytest

from pagequarry.llm import piece_lattice

ROWS = [(1, "the cat and the other cat"), (1, "the dog"), (None, "état 中文 😀 naïve"), (2, None), (3, ""), (4, "-" * 100 + " the " + "x" * 70), (5, "  a\n\n b ▁ c")]


@pytest.mark.parametrize("bpe", [True, False])
@pytest.mark.parametrize("byte_ids", [(), tuple(range(1000, 1256))])
def test_words_at_once_equal_the_fold(spark, bpe, byte_ids):
    rng = random.Random(5)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)} | {"é", "éa"})
    rows = [(p, i, float(rng.randint(-6, -1))) for i, p in enumerate(pieces)]
    vocab = piece_lattice.vocabulary(spark, rows, bpe, byte_ids, unknown=99)
    words = sorted({"".join(rng.choice("abcéx😀") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    folded = {r["word"]: list(r["ids"]) for r in piece_lattice.encoded_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()}
    ids, lengths = piece_lattice.Lattice(piece_lattice._plain(vocab)).encoded(words)
    at = [0, *lengths.cumsum().tolist()]
    assert {w: ids[a:b].tolist() for w, a, b in zip(words, at, at[1:])} == folded


@pytest.mark.parametrize("size", [0, 2, 50_000])
def test_documents_are_not_shuffled(spark, monkeypatch, size):
    import sentencepiece

    monkeypatch.setattr(piece_lattice, "OFTEN", 1)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, vocab = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.load_vocabulary(spark, path)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    coded = piece_lattice.encoded(docs, vocab, lexicon_size=size)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in coded.collect()) == sorted((str(i), model.encode(t or "")) for i, t in ROWS)
    trip = piece_lattice.round_trip(docs, vocab, lexicon_size=size)
    for plan in (coded, trip):
        # words that move with their documents' names take several times the input
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text
    assert sorted((str(r["doc_id"]), r["n_pieces"]) for r in trip.collect()) == sorted((str(i), len(model.encode(t or ""))) for i, t in ROWS)
    assert all(r["decodes"] for r in trip.collect())


def test_a_lost_character_does_not_decode(spark):
    vocab = piece_lattice.vocabulary(spark, [("▁", 1, -1.0), ("a", 2, -2.0), ("▁a", 3, -1.5)], bpe=True, unknown=0)
    docs = spark.createDataFrame([(1, "a a"), (2, "a b"), (3, "b"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_pieces"], r["decodes"]) for r in piece_lattice.round_trip(docs, vocab).collect()}
    assert got == {1: (2, True), 2: (3, False), 3: (2, False), 4: (0, True)}
