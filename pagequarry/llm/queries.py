"""The operators bound to the benchmark tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import (
    bpe_replay,
    exact_dedup,
    host_rules,
    html_tree,
    jaccard_join,
    line_crf,
    packing,
    phrases,
    piece_lattice,
    token_store,
    toxicity,
    turn_trie,
    url_cascade,
)
from pagequarry.llm.shared import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query()
def op1_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))


@query(exact_dedup.SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


@query()
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.store_digest(spark, folder)


@query(host_rules.SQL)
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(table(spark, sf_dir, "documents")).drop("host_rate")


@query()
def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), line_crf.held_out(F.col("doc_id"))
    field = line_crf.fit_field(docs, table(spark, sf_dir, "labels"), where=~held)
    return line_crf.scored(docs, field).select("doc_id", held.alias("held_out"), "score", "predicted")


@query()
def op7_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = piece_lattice.load_vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return piece_lattice.round_trip(table(spark, sf_dir, "documents"), vocab)


@query()
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


@query(url_cascade.SQL)
def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judged_urls(table(spark, sf_dir, "pages"))


@query(phrases.SQL)
def op11_collocation_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_replay.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query(turn_trie.SQL)
def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))
