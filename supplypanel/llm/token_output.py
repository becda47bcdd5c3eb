"""Token-id output: each document's ids as one zstandard frame under a shared dictionary.

File format, a folder of Parquet parts that Spark commits as a whole:

* ``dictionary``: one row with the dictionary's bytes and their sha256;
* ``blocks``: block, payload (frames of neighbouring documents end to end, about
  ``BLOCK_BYTES``), dictionary_hash, and the frames' table as arrays;
* ``index``: a row for each document with doc_id, block, place in the block,
  frame_at and frame_bytes (place in the payload), start (ids of all documents
  before it), n_tokens and dictionary_hash.

Documents are in ascending doc_id order. A reader of one document reads one
index row and one block and unpacks one frame. Ids are little-endian, two bytes wide where the tokenizer's ids fit,
else four, as the first byte of the frame's content tells.

Defined cases: a null or empty text holds the end id alone; repeated ids stand
next to each other, ordered by the hash of their texts; null ids come first; an
empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplypanel.llm.common import kept, sampled, ship_package, small_batches
from supplypanel.llm.word_tokens import encoder, release, tokenizer_path

END_ID = 2
#: Documents from which the dictionary is trained, about, and the ids taken from each.
SAMPLE_ROWS, SAMPLE_IDS = 2000, 4096
DICTIONARY_BYTES = 65536
BLOCK_BYTES = 1 << 18
LEVEL = 3
FRAME_TABLE = ("doc_ids", "n_tokens", "earlier", "frame_at", "frame_bytes")
#: Bytes of frames that one output part should hold.
PART_BYTES = 32 << 20


def serialized(ids: np.ndarray) -> bytes:
    if len(ids) == 0 or ids.max() < 1 << 16:
        return b"\2" + ids.astype("<u2").tobytes()
    return b"\4" + ids.astype("<u4").tobytes()


def deserialized(content: bytes) -> np.ndarray:
    return np.frombuffer(content, f"<u{content[0]}", offset=1).astype("<u4")


def _ids(path: str, end_id: int, text: str | None) -> np.ndarray:
    return np.append(encoder(path).encode(text), np.uint32(end_id))


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID, rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary from about ``rows`` documents chosen by the hash of their ids, or b"" where there are too few.

    The sample is bounded: at most ``SAMPLE_IDS`` ids of each of its documents
    come to the driver. It only shapes the compression; every document is written whole.
    """
    ship_package(docs.sparkSession)
    share = min(1.0, rows / max(1, docs.count()))
    chosen = docs.where(sampled(F.col("doc_id"), share)).select("text")

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"content": [serialized(_ids(path, end_id, t)[:SAMPLE_IDS]) for t in batch["text"]]})

    contents = sorted(bytes(r.content) for r in chosen.mapInPandas(samples, "content binary").limit(2 * rows).collect())
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, contents)) // 8), contents).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def _framed(docs: DataFrame, dictionary: bytes, path: str, end_id: int) -> DataFrame:
    """doc_id, tie, n_tokens and frame of each document."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for batch in batches:
            counts, frames = [], []
            for own in encoder(path).encode_all(batch.column(2)):
                ids = np.append(own, np.uint32(end_id))
                counts.append(len(ids)), frames.append(compressor.compress(serialized(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())],
                names=["doc_id", "tie", "n_tokens", "frame"])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(
        framed, "doc_id long, tie long, n_tokens long, frame binary")


def _blocks(frames: DataFrame, dictionary_hash: str) -> DataFrame:
    """Payloads of about ``BLOCK_BYTES`` with their frame tables, from frames in order."""
    names = ["payload", "dictionary_hash", *FRAME_TABLE]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, frames, held = [], [], [], 0
        release()  # the worker may have encoded before

        def block() -> pa.RecordBatch:
            sizes = [len(f) for f in frames]
            tables = (ids, counts, np.cumsum([0, *counts[:-1]]).tolist(), np.cumsum([0, *sizes[:-1]]).tolist(), sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([b"".join(frames)], pa.binary()), pa.array([dictionary_hash]),
                 *[pa.array([t], pa.list_(pa.int64())) for t in tables]], names=names)

        for batch in batches:
            for doc_id, n, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(doc_id), counts.append(n), frames.append(frame.as_py())
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield block()
                    ids, counts, frames, held = [], [], [], 0
        if frames:
            yield block()

    schema = "payload binary, dictionary_hash string, " + ", ".join(f"{x} array<long>" for x in FRAME_TABLE)
    return frames.mapInArrow(gathered, schema)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in the format above; whatever the folder held is replaced."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    dictionary = train_dictionary(docs, path, end_id)
    name = sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary)], "dictionary_hash string, content binary").write.mode(
        "overwrite").parquet(f"{folder}/dictionary")

    # Frames are made where the texts are read; only frames are shuffled. The kept frames
    # serve both passes of the range partitioning.
    with small_batches(spark):
        frames = kept(_framed(docs, dictionary, path, end_id)).withColumn("row", F.monotonically_increasing_id())
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    # The row splits an id that very many documents share.
    keys = ("doc_id", "tie", "row")
    ordered = frames.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    blocks = _blocks(ordered.drop("tie", "row"), name).withColumn("block", F.monotonically_increasing_id())
    with small_batches(spark):
        blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks")
    # Blocks are numbered in doc_id order: part above, place in the part below. Token sums
    # are added up over parts, of which there are few, and over the blocks inside each.
    sums = kept(written.select(
        "block", F.shiftright("block", 33).alias("part"),
        F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")))
    parts_before = sums.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    firsts = sums.withColumn("inside", inside).join(parts_before, "part").select(
        "block", (F.col("before") + F.col("inside")).alias("first"))
    entry = F.col("entry")
    written.drop("payload").join(firsts, "block").select(
        "block", "dictionary_hash", "first", F.posexplode(F.arrays_zip(*FRAME_TABLE)).alias("place", "entry"),
    ).select(
        entry.doc_ids.alias("doc_id"), "block", "place", entry.frame_at.alias("frame_at"),
        entry.frame_bytes.alias("frame_bytes"), (F.col("first") + entry.earlier).alias("start"),
        entry.n_tokens.alias("n_tokens"), "dictionary_hash",
    ).write.mode("overwrite").parquet(f"{folder}/index")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return row.dictionary_hash, bytes(row.content)


def _decoded(blocks: DataFrame, dictionary: tuple[str, bytes]) -> DataFrame:
    """doc_id, block, place and ids (little-endian unsigned 32-bit) of frames.

    ``blocks`` has payload, dictionary_hash, block, and arrays doc_ids, places, frame_at and frame_bytes.
    """
    ship_package(blocks.sparkSession)
    name, content = dictionary

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(content) if content else None
        reader = zstandard.ZstdDecompressor(dict_data=shared)
        release()  # the worker may have encoded before
        for batch in batches:
            for r in range(batch.num_rows):
                b = {n: batch.column(n)[r].as_py() for n in names}
                if b["dictionary_hash"] != name:
                    raise ValueError(f"block {b['block']} needs dictionary {b['dictionary_hash']}")
                payload, size = memoryview(b["payload"]), len(b["frame_at"] or ())
                for k in range(0, size, 256):
                    part = slice(k, min(k + 256, size))
                    ids = [deserialized(reader.decompress(payload[at : at + n])).tobytes()
                           for at, n in zip(b["frame_at"][part], b["frame_bytes"][part])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b["doc_ids"][part], pa.int64()), pa.array([b["block"]] * len(ids), pa.int64()),
                         pa.array(b["places"][part], pa.int32()), pa.array(ids, pa.binary())],
                        names=["doc_id", "block", "place", "ids"])

    names = ["payload", "dictionary_hash", "block", "doc_ids", "places", "frame_at", "frame_bytes"]
    return blocks.select(*names).mapInArrow(unpacked, "doc_id long, block long, place int, ids binary")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from the files: doc_id, block, place, ids; no shuffle."""
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn(
        "places", F.when(F.size("doc_ids") > 0, F.sequence(F.lit(0), F.size("doc_ids") - 1)))
    return _decoded(blocks, _dictionary(spark, folder))


def fetch_tokens(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``wanted``, by the index: only their blocks are read and only their frames unpacked."""
    index = spark.read.parquet(f"{folder}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    entry = F.struct("place", "doc_id", "frame_at", "frame_bytes")
    # A block's frames make one group; a block holds about a quarter of a megabyte.
    frames = index.groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("e")).select(
        "block", F.col("e.place").alias("places"), F.col("e.doc_id").alias("doc_ids"),
        F.col("e.frame_at").alias("frame_at"), F.col("e.frame_bytes").alias("frame_bytes"))
    blocks = spark.read.parquet(f"{folder}/blocks").select("block", "payload", "dictionary_hash")
    return _decoded(blocks.join(frames, "block"), _dictionary(spark, folder))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    with small_batches(spark, 16):  # rows are blocks
        sums = kept(read_tokens(spark, folder).select(
            "block", "place", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    index = spark.read.parquet(f"{folder}/index").select("doc_id", "block", "place", "start")
    return index.join(sums, ["block", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")
