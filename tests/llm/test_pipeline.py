"""Each stage of the pipeline against what its operator says of its input."""

import corpus_pipeline
from test_operators import brute_components

from pagequarry.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    source = docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, SF), name)
        assert kept.columns == source.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after.items() <= before.items()
        if name in ("toxicity", "quality"):
            clean = [i for i in before if i in labels and not labels[i]["toxic"] and labels[i]["quality"]]
            assert sum(i in after for i in clean) >= 0.95 * len(clean)
        if name == "exact_dedup":
            assert len(set(after.values())) == len(after) and set(after.values()) == set(before.values())
        if name == "jaccard_join":
            assert set(after) == {c for _, _, c in brute_components(list(before.items()))}
        sizes.append(len(after))
        docs = kept
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(tokens) == {r["doc_id"] for r in docs.collect()} and sum(r["length"] for r in pieces) == sum(tokens.values())
    assert corpus_pipeline.ORACLE_SQL is None and len(sizes) == 4


def test_stages_take_odd_rows_and_clashing_columns(spark):
    """Nulls, empty texts, repeated rows and columns with the names that joins use."""
    rows = [(i, t, (i or 0) % 3, "g", b"s", "n") for i, t in [(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "same words here"), (4, "same words here"), (5, "same words here")]]
    rows += [(i, "a plain text about the weather of the day and the week that follows it", 0, "g", b"s", "n") for i in (8, 9)]
    columns = "doc_id long, text string, _gone long, _sha string, node binary, component_id string"
    docs = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert kept.count() <= docs.count()
    after = written(corpus_pipeline.drop_copies(spark, docs, SF), "odd")
    assert sorted(r["doc_id"] for r in after.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 4, 8]
    assert corpus_pipeline.pack(spark, docs.where("doc_id IS NOT NULL"), SF).count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.isEmpty(), name
    assert corpus_pipeline.pack(spark, docs, SF).isEmpty()
