"""Token ids on disk: documents compressed one by one with a shared dictionary.

A store is a folder with two tables:

* ``dictionary``: one row with the zstandard dictionary, its sha256 hash, the
  id width in bytes and the end id;
* ``blocks``: rows of up to ``BLOCK_DOCS`` documents in ascending doc_id order.
  ``payload`` is the documents' zstandard frames end to end; ``doc_ids``,
  ``frame_ends`` and ``token_ends`` are the offset index into it; ``part``,
  ``block`` and ``part_start`` place the block; ``dict_hash`` names the dictionary.

A short document is read from one frame without touching its neighbours.
Spark's writer commits whole tasks, so a lost executor leaves no half store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm.shared import ship
from pagequarry.llm.tokens import crc32_of, encoder, sliced

END_ID = 2
BLOCK_DOCS = 256
BLOCK_BYTES = 4 << 20
#: The dictionary is trained on at most so many documents, so many ids of each.
SAMPLE_DOCS = 2_000
SAMPLE_IDS = 2_048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

BLOCKS = (
    "part int, block int, part_start long, n_tokens long, min_id long, max_id long, doc_ids array<long>, "
    "frame_ends array<long>, token_ends array<long>, dict_hash string, payload binary"
)


def _encoded(batches, path: str, drops_space: bool, end_id: int):
    """(ids of the rows, id arrays with the end id) slice by slice."""
    tokenizer = encoder(path, drops_space)
    for batch in sliced(batches, "text"):
        rows = tokenizer.encode(batch.column("text"))
        yield batch.column("doc_id").to_pylist(), [np.append(x, np.int32(end_id)) for x in rows]


def trained_dictionary(docs: DataFrame, path: str, drops_space: bool, width: int, end_id: int = END_ID) -> bytes:
    """A dictionary from a bounded sample, chosen by hash; empty for too few documents."""
    import zstandard

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _encoded(batches, path, drops_space, end_id):
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in rows], pa.binary())})

    total = docs.count()
    share = max(1, total // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(share)) == 0).limit(2 * SAMPLE_DOCS)
    samples = [bytes(r[0]) for r in some.mapInArrow(serialized, "ids binary").limit(SAMPLE_DOCS).toLocalIterator()]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, sorted(samples)).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # the trainer refuses samples it finds too few or too much alike
        return b""


def write_store(
    docs: DataFrame, folder: str, tokenizer_path: str, drops_space: bool = False, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text and write the store to ``folder``.

    A null or empty text is the end id alone.  Rows without an id come first;
    rows that repeat an id follow each other in text order.  An empty table
    makes an empty store; other columns are ignored.
    """
    import zstandard
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = trained_dictionary(rows, tokenizer_path, drops_space, width, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(bytearray(dictionary), name, width, end_id)], "dictionary binary, dict_hash string, width int, end_id int"
    ).coalesce(1).write.parquet(f"{folder}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True).compress
        part, number, start, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        frames: list[bytes] = []
        lengths: list[int] = []

        def block() -> pa.RecordBatch:
            real = [i for i in ids if i is not None]
            out = {
                "part": [part], "block": [number], "part_start": [start], "n_tokens": [sum(lengths)],
                "min_id": [min(real, default=None)], "max_id": [max(real, default=None)], "doc_ids": [ids],
                "frame_ends": [np.cumsum([len(f) for f in frames])], "token_ends": [np.cumsum(lengths)],
                "dict_hash": [name], "payload": [b"".join(frames)],
            }
            return pa.RecordBatch.from_pydict(out, schema=_BLOCK_SCHEMA)

        for keys, arrays in _encoded(batches, tokenizer_path, drops_space, end_id):
            for key, array in zip(keys, arrays):
                ids.append(key)
                frames.append(compress(array.astype(f"<u{width}").tobytes()))
                lengths.append(len(array))
                held += len(frames[-1])
                if len(ids) == BLOCK_DOCS or held > BLOCK_BYTES:
                    yield block()
                    number, start, held, ids, frames, lengths = number + 1, start + sum(lengths), 0, [], [], []
        if ids:
            yield block()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


_BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("min_id", pa.int64()), ("max_id", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "frame_ends", "token_ends")]
    + [("dict_hash", pa.string()), ("payload", pa.binary())]
)


def _codec(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary in {folder} does not have the hash it is stored under")
    return dictionary, row["dict_hash"], row["width"]


def _frames(batches, dictionary: bytes, name: str, width: int, wanted: int | None = None):
    """(block row, place in the block, ids) of the documents, or of one document."""
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    expand = zstandard.ZstdDecompressor(dict_data=shared).decompress
    for batch in batches:
        for row in batch.to_pylist():
            if row["dict_hash"] != name:
                raise ValueError(f"a block needs dictionary {row['dict_hash']}, the store has {name}")
            begin = 0
            for i, end in enumerate(row["frame_ends"]):
                if wanted is None or row["doc_ids"][i] == wanted:
                    yield row, i, np.frombuffer(expand(row["payload"][begin:end]), dtype=f"<u{width}")
                begin = end


def read_store(spark: SparkSession, folder: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, ids of every document, or of one without unpacking the others."""
    codec = _codec(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    if doc_id is not None:
        blocks = blocks.where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, i, ids in _frames(batches, *codec, doc_id):
            out = {"doc_id": [row["doc_ids"][i]], "ids": [ids.astype(np.int64)]}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return blocks.mapInArrow(unpacked, "doc_id long, ids array<long>")


def store_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before: those of earlier parts
    (one row per part is summed up), of the part's earlier blocks, of the block.
    """
    codec = _codec(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    schema = pa.schema([(c, pa.int64()) for c in ("part", "doc_id", "local", "n_tokens", "ids_crc32")])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, i, ids in _frames(batches, *codec):
            if len(ids) != row["token_ends"][i] - (row["token_ends"][i - 1] if i else 0):
                raise ValueError(f"document {row['doc_ids'][i]} does not have the ids that its index says")
            out.append((row["part"], row["doc_ids"][i], row["part_start"] + row["token_ends"][i] - len(ids), len(ids), crc32_of(ids)))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").cast("long").alias("part"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    found = blocks.mapInArrow(digests, "part long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
