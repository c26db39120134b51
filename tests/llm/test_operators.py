"""The operators against brute force, on odd rows and on the small tables."""

import hashlib
import html
import itertools
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagequarry.llm import (
    components,
    exact_dedup,
    host_rules,
    html_tree,
    jaccard_join,
    line_crf,
    packing,
    page_samples,
    piece_lattice,
    queries,
    token_store,
    toxicity,
    url_cascade,
)
from pagequarry.llm.shared import new_folder

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash string, node long, word string, body string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "one two  three four five six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten eleven"),
    (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, ""), (5, " \n\t "), (None, "alone here"), (None, None),
    (6, LONG), (7, LONG + " tail"), (8, "é ß 中文 😀 naïve"), (9, "ONE TWO three four five six seven eight nine ten eleven"),
    (10, "a a a a a a a a a a a a"), (11, "x"), (12, "x"), (13, "l\nl\nl\n\nl"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i == 5 else f"s{(i or 0) % 3}", None, "h", 7, "w", "b") for i, t in ROWS]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_exact_duplicates(docs, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in ROWS]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        least = min((j for j in ids if j is not None), default=None)
        want.append((i, least, len(ids), i == least, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_hash_collisions_are_kept_apart(docs):
    weak = exact_dedup.exact_duplicates(docs, content_hash=lambda t: F.substring(F.md5(t), 1, 1))
    right = exact_dedup.exact_duplicates(docs)
    assert sorted(map(tuple, weak.collect()), key=key) == sorted(map(tuple, right.collect()), key=key)


def test_without_duplicates_keeps_columns(docs):
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"\s+", " ", r["text"] or "") for r in left.collect()]
    assert set(texts) == {re.sub(r"\s+", " ", t or "") for _, t in ROWS}


def brute_components(rows):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.append((i, grams))
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations([s for s in sets if s[1] and s[0] is not None], 2):
            if label[i] != label[j] and 100 * len(a & b) >= 75 * len(a | b):
                low = min(label[i], label[j])
                old = max(label[i], label[j])
                label = {k: low if v == old else v for k, v in label.items()}
                changed = True
    return sorted([(i, len(g), None if i is None else label[i]) for i, g in sets], key=key)


def test_similar_groups_on_odd_rows(docs, empty):
    got = sorted([tuple(r) for r in jaccard_join.similar_groups(docs).collect()], key=key)
    assert got == brute_components(ROWS)
    assert jaccard_join.similar_groups(empty).count() == 0
    assert jaccard_join.one_of_each_group(docs).columns == docs.columns


def test_similar_groups_of_chained_near_copies(spark):
    words = [f"t{i}" for i in range(60)]
    rows = []
    for d in range(40):  # each copy differs from the one before in one more word
        copy = list(words)
        for e in range(d // 4):
            copy[59 - e] = f"e{d}-{e}"
        rows.append((d + 100, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in jaccard_join.similar_groups(docs).collect()], key=key) == brute_components(rows)


def test_near_copies_whose_block_counts_differ(spark):
    """500 and 540 shingles: 512 and 1,024 blocks; 500 of 540 shared links, 500 of 700 does not."""
    long = [f"w{i}" for i in range(704)]
    docs = spark.createDataFrame([(1, " ".join(long[:504])), (2, " ".join(long[:544])), (3, " ".join(long)), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    assert got == {1: (500, 1), 2: (540, 1), 3: (700, 1), 4: (0, 4)}
    apart = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs.where("doc_id <> 2")).collect()}
    assert apart == {1: 1, 3: 3, 4: 4}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 130))


def encoded_by_library(name, rows):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_store(spark, docs, empty):
    folder = new_folder(spark, "test")
    token_store.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(encoded_by_library("byte_bpe_50k.json", ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, ids in order:
        want.append((i, len(ids), crc(ids)))
    got = token_store.store_digest(spark, folder).orderBy("start").collect()
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in order], key=lambda i: (i is not None, i or 0))
    one = token_store.read_store(spark, folder, 8).collect()
    assert [list(r["ids"]) for r in one] == [ids for i, ids in order if i == 8]
    folder = new_folder(spark, "test")
    token_store.write_store(empty, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.store_digest(spark, folder).count() == 0


def test_token_store_uses_its_dictionary(spark, small):
    folder = new_folder(spark, "test")
    token_store.write_store(small, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert len(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"]) > 1000
    want = {(i, crc(ids)) for i, ids in encoded_by_library("byte_bpe_50k.json", [(r["doc_id"], r["text"]) for r in small.collect()])}
    assert {(r["doc_id"], r["ids_crc32"]) for r in token_store.store_digest(spark, folder).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 100, 1000, 1365, 1366, 2047, 2048, 2049, 4000, 4032, 4095, 4096, 4097, 12288, 20001])
def test_cuts_fill_their_class(n):
    pieces = packing.cuts(n)
    assert sum(length for length, _ in pieces) == n
    for length, k in pieces:
        assert k * length <= packing.CAPACITY and (packing.CAPACITY - k * length) * packing.SLACK <= packing.CAPACITY


def test_packing(docs, empty):
    rows = [(i, t) for i, t in ROWS if i is not None and i != 2]
    ids = dict(encoded_by_library("word_bpe_49k.json", rows))
    got = packing.packed(docs.where("doc_id IS NOT NULL AND doc_id <> 2"), public_tokenizers.path("word_bpe_49k.json")).collect()
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and crc(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    by_sequence = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert by_sequence.get(r["sequence_id"], 0) == r["offset"]
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= packing.CAPACITY
    assert packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy().sum("length").first()[0] > 0
    assert packing.packed(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, empty):
    got = host_rules.measures(docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")).collect()
    want = [(i, *brute_measures(t)) for i, t in ROWS if i not in (6, 7)]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted([tuple(r[c] for c in names) for r in got], key=key) == sorted(want, key=key)
    assert host_rules.host_quality(docs).count() == len(ROWS) and host_rules.host_quality(empty).count() == 0


def test_bad_host_loses_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good + f" {i}", "good") for i in range(60)] + [(100 + i, "bad", "bad") for i in range(58)] + [(200 + i, good + f" {i}", "bad") for i in range(2)]
    got = {r["doc_id"]: r["kept"] for r in host_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(60)) and not any(v for i, v in got.items() if i >= 100)


def test_line_field_matches_enumeration():
    rng = np.random.default_rng(1)
    logit, move = rng.normal(size=5), rng.normal(size=(2, 2))
    good, _ = line_crf._forward_backward(logit, move, np.array([0, 5]))
    weight = {}
    for states in itertools.product((0, 1), repeat=5):
        z = sum(logit[t] for t in range(5) if states[t]) + sum(move[a, b] for a, b in itertools.pairwise(states))
        weight[states] = np.exp(z)
    total = sum(weight.values())
    want = [sum(w for s, w in weight.items() if s[t]) / total for t in range(5)]
    assert np.allclose(good, want)


def test_quality_of_held_out_rows(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = line_crf.held_out(F.col("doc_id"))
    field = line_crf.fit_field(table, labels, where=~held)
    got = line_crf.scored(table, field).join(labels, "doc_id").where(held).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
    odd = line_crf.scored(docs, field).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert line_crf.scored(empty, field).count() == 0
    assert line_crf.good_rows(docs, field).columns == docs.columns


def test_toxicity_of_held_out_rows(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = line_crf.held_out(F.col("doc_id"))
    chain = toxicity.fit_chain(table, labels, where=~held)
    got = toxicity.scored(table, chain).withColumnRenamed("toxic", "found").join(labels, "doc_id").where(held).collect()
    assert np.mean([r["found"] for r in got if r["toxic"]]) >= 0.9
    assert np.mean([r["found"] for r in got if not r["toxic"]]) <= 0.005
    odd = toxicity.scored(docs, chain).collect()
    assert len(odd) == len(ROWS) and not any(r["toxic"] for r in odd)
    assert toxicity.scored(empty, chain).count() == 0
    assert toxicity.without_toxic(docs, chain).count() == len(ROWS)
    none = toxicity.fit_chain(table, labels.where("false"))
    assert toxicity.scored(docs, none).where("toxic").count() == 0


def test_pieces_equal_the_library(spark, docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, vocab = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.load_vocabulary(spark, path)
    some = docs.where("doc_id NOT IN (2, 7)")
    got = {r["doc_id"]: list(r["ids"]) for r in piece_lattice.encoded(some, vocab).collect()}
    assert got == {i: model.encode(t or "") for i, t in ROWS if i not in (None, 2, 7)}
    assert all(r["decodes"] for r in piece_lattice.round_trip(some, vocab).collect())
    rows = [(1, "one two"), (1, "three four five"), (None, "x y"), (None, "z"), (1, "one two")]
    twice = piece_lattice.encoded(spark.createDataFrame(rows, "doc_id long, text string"), vocab).collect()
    assert sorted((r["doc_id"] is None, list(r["ids"])) for r in twice) == sorted((i is None, model.encode(t)) for i, t in rows)
    back = piece_lattice.decoded(piece_lattice.encoded(some.where("doc_id = 8"), vocab), vocab, "doc_id").first()
    assert back["text"] == " " + dict(ROWS)[8]
    assert piece_lattice.encoded(empty, vocab).count() == 0


def test_pieces_of_long_words_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, vocab = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.load_vocabulary(spark, path)
    letters = "".join("etaoinshrdlu"[i * i * 7 % 97 % 12] for i in range(5_000))
    texts = [letters, "-" * 5_000, " " * 5_000, "a" + " " * 5_000 + "é😀" * 2_600, letters[:64], letters[:65], letters[:63], "=" * 63, "=" * 64, "=" * 65]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in piece_lattice.encoded(some, vocab).collect()}
    for i, text in enumerate(texts):
        assert got[i] == model.encode(text), i
    assert all(r["decodes"] for r in piece_lattice.round_trip(some, vocab).collect())


@pytest.mark.parametrize("bpe", [True, False])
def test_long_words_have_the_pieces_of_the_fold(spark, monkeypatch, bpe):
    rows = [(p, i, s) for i, (p, s) in enumerate([("a", -3.0), ("b", -3.5), ("ab", -2.0), ("ba", -2.0), ("aba", -2.5), ("bb", -1.0), ("abab", -4.0)])]
    vocab = piece_lattice.vocabulary(spark, rows, bpe=bpe, unknown=99)
    words = spark.createDataFrame([("".join("abx"[n // 3**k % 3] for k in range(6)),) for n in range(729)], "word string")
    folded = {r["word"]: list(r["ids"]) for r in piece_lattice.encoded_words(words, vocab).collect()}
    monkeypatch.setattr(piece_lattice, "FOLD_CHARS", 0)
    assert {r["word"]: list(r["ids"]) for r in piece_lattice.encoded_words(words, vocab).collect()} == folded


def test_viterbi_finds_the_best_path(spark):
    rows = [("▁", 1, -3.0), ("a", 2, -2.5), ("b", 3, -2.0), ("ab", 4, -4.0), ("▁a", 5, -3.5), ("ba", 6, -2.2), ("bab", 7, -5.5), ("aa", 8, -4.1)]
    vocab = piece_lattice.vocabulary(spark, rows, bpe=False)
    score = {p: (i, s) for p, i, s in rows}

    def best(word):
        paths = []
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            if all(p in score or len(p) == 1 for p in parts):
                paths.append((sum(score.get(p, (0, -15.5))[1] for p in parts), [score.get(p, (0, 0))[0] for p in parts]))
        top = max(p[0] for p in paths)
        return [ids for s, ids in paths if abs(s - top) < 1e-9]

    words = ["▁abab", "▁babab", "▁aabba", "▁cab", "▁b"]
    got = {r["word"]: list(r["ids"]) for r in piece_lattice.encoded_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()}
    assert all(got[w] in best(w) for w in words)


def test_tree_marginals_match_enumeration():
    pages = [html_tree.parse("<div>a<p>b</p><ul><li>c<li>d</ul></div>")]
    trees, rng = html_tree.forest(pages), np.random.default_rng(2)
    n = len(trees.parent)
    logit, pair = rng.normal(size=n), rng.normal(size=(2, 2, 2))
    got, _ = html_tree.marginals(logit, pair, trees)
    weight = {}
    for s in itertools.product((0, 1), repeat=n):
        z = sum(logit[i] for i in range(n) if s[i]) + sum(pair[trees.kind[i], s[p], s[i]] for i, p in enumerate(trees.parent) if p >= 0)
        weight[s] = np.exp(z)
    total = sum(weight.values())
    assert np.allclose(got, [sum(w for s, w in weight.items() if s[i]) / total for i in range(n)])


def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_tree.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))
        assert r["text"] == " ".join(html.unescape(blocks).split()) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a<", "x"), (3, "u", "<article><p>one&amp;two <b>th</b>ree<p>x</article><script>if(a<b){}</script>", "x")],
        "page_id long, url string, html string, text string",
    )
    got = {(r["page_id"], r["url"]): r["text"] for r in html_tree.main_text(odd).collect()}
    assert got[(1, "u")] == "" and got[(2, None)] == "" and got[(3, "u")] == "one&two three x"
    assert html_tree.main_text(odd.where("false")).count() == 0


def test_extraction_of_unseen_layouts():
    model = html_tree.default_model()
    pages = page_samples.labelled_pages(200, seed=31)
    got = model.texts([re.sub("</?keep-text>", "", p) for p in pages])
    right = 0
    for page, text in zip(pages, got):
        kept = " ".join(re.findall(r"<keep-text>(.*?)</keep-text>", page, re.S))
        right += sorted(re.sub(r"<[^>]*>", " ", kept).split()) == sorted(text.split())
    assert right >= 0.9 * len(pages)


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_cascade.build_cascade(universe, error=0.25)
    assert len(cascade.bits) > 2
    got = url_cascade.is_listed(universe.withColumnRenamed("listed", "want"), "key", cascade)
    assert got.where("listed <> want").count() == 0
    assert url_cascade.build_cascade(universe, max_bytes=10) is None


def test_urls(spark):
    rows = [
        (1, "http://A.Example.net/en/x?q"), (2, "https://b.net/"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/"), (5, "nothing"), (6, None),
        (7, "http://n.net"), (8, "http://o.org/en/?utm_source=1"), (None, "http://o.org/en/?utm_source=1"), (9, "http://notexample.com/de/"),
    ]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_cascade.judged_urls(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == got[5]
    assert got[7] == ("n.net", "", None, "allow") and got[8] == ("o.org", "/en/", None, "block") == got[None] and got[9][2:] == (None, "allow")
    beyond = {r["page_id"]: tuple(r)[1:] for r in url_cascade.judged_urls(pages, max_bytes=0).collect()}
    assert beyond == got and url_cascade.judged_urls(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    right = [tuple(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
    assert sorted([tuple(r) for r in got.select(*columns).collect()], key=key) == sorted(right, key=key)
