"""Token ids in compressed binary blocks.

A block holds consecutive documents: a header with the dictionary's hash, the
document ids, an offset index, and one zstandard frame for each document, all
compressed with one dictionary trained on serialized id arrays. One document is
read by its offsets alone, without its neighbours.

Layout (little-endian): "NLTB", version u8, bytes for an id u8, dictionary SHA-256
(32 bytes), documents u32, null flags u8 each, doc_ids i64 each, offsets u32
(documents + 1) into the frames, frames. The last id of each document is 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import common, wordids

END = 0
LEVEL = 3
#: The dictionary: its bytes, and the documents (whole texts, chosen by a hash of the id, at most so many) that train it.
DICTIONARY_BYTES, SAMPLE_DOCS = 64 * 1024, 800
#: A block closes at so many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 4 * 2**20, 8192
_HEAD = struct.Struct("<4sBB32sI")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder_of(path: str) -> wordids.TextIds:
    """This Python worker's encoder."""
    return wordids.text_ids(path, True)


def train_dictionary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row (sha256, dictionary), trained in one task on a bounded sample of documents; empty when there is too little to train on.

    Ids alone choose the sample; only then are its texts fetched. Of repeated ids one text counts.
    """
    count = docs.count()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    h = F.xxhash64("doc_id")
    if count > 2 * SAMPLE_DOCS:
        # About twice as many as are taken, by a threshold; repeated ids add up within their tasks first.
        ids = ids.filter(h < int(2**64 * min(1.0, 2 * SAMPLE_DOCS / count)) - 2**63)
    picked = ids.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(h).alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS)
    picked = common.materialize(picked, "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull())
    texts = texts.groupBy("h", "doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        samples = [x.tobytes() for x in encoder_of(tokenizer).encode(pa.array([r[2] for r in rows], pa.string())) if len(x)]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            dictionary = b""
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(dictionary).hexdigest()]), pa.array([dictionary], pa.binary())], ["sha256", "dictionary"])

    return texts.select("h", "doc_id", "text").repartition(1).mapInArrow(run, "sha256 string, dictionary binary")


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def pack(ids: list[int | None], frames: list[bytes], width: int, digest: bytes) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)], dtype="<u4")
    nulls = bytes(x is None for x in ids)
    return b"".join([_HEAD.pack(b"NLTB", 1, width, digest, len(ids)), nulls, np.array([x or 0 for x in ids], "<i8").tobytes(), offsets.tobytes(), *frames])


class Block:
    """Access to one block's documents."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, digest, n = _HEAD.unpack_from(data)
        if magic != b"NLTB" or version != 1:
            raise ValueError("not a token block")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        nulls, ids = data[at : at + n], np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [None if null else int(x) for null, x in zip(nulls, ids, strict=True)]
        self.offsets = np.frombuffer(data, "<u4", n + 1, at + 9 * n)
        self.base, self.data = at + 9 * n + 4 * (n + 1), data
        self.reader = zstandard.ZstdDecompressor(**_codec(dictionary))

    def ids(self, i: int) -> np.ndarray:
        a, b = self.base + int(self.offsets[i]), self.base + int(self.offsets[i + 1])
        return np.frombuffer(self.reader.decompress(self.data[a:b]), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write the documents' ids under ``path`` in ascending doc_id order (null ids first, equal ids by their texts' hashes).

    ``path/blocks`` holds rows (part, seq, first_id, last_id, n_docs, n_tokens,
    block); their order by (part, seq) is the order of documents. ``path/dictionary``
    holds the dictionary. A null text is empty: its ids are the end id alone.
    Only doc_id and text are read. Range partitions hold any part of a hot id's rows.
    """
    tokenizer = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    train_dictionary(docs, tokenizer).write.parquet(f"{path}/dictionary")
    dictionary = _dictionary(spark, path)
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([END], encoder.dtype).tobytes()
        writer = zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary))
        part, seq = TaskContext.get().partitionId(), 0
        ids, frames, size, tokens = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            block = pack(ids, frames, encoder.dtype.itemsize, digest)
            row = {"part": part, "seq": seq, "first_id": ids[0], "last_id": ids[-1], "n_docs": len(ids), "n_tokens": tokens, "block": block}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                own = found.tobytes() + end
                ids.append(doc_id)
                frames.append(writer.compress(own))
                tokens += len(own) // encoder.dtype.itemsize
                size += len(frames[-1])
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    seq, ids, frames, size, tokens = seq + 1, [], [], 0, 0
        if ids:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("block", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # By the hash too, or all rows without an id, or with one id, would be one task; by the row number for one text's copies under one id.
    order = ["doc_id", "h", "row"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(run, "part int, seq int, first_id long, last_id long, n_docs int, n_tokens long, block binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary) if row else b""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part, of which there are as many as tasks wrote; blocks add up within their part.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    starts = common.materialize(starts.select("part", "seq", (F.col("base") + F.col("inner")).alias("start")), "starts")
    placed = blocks.join(common.maybe_broadcast(starts), ["part", "seq"]).select("start", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_buffer().to_pybytes(), dictionary)
                rows = [block.ids(i) for i in range(len(block.doc_ids))]
                n = np.array([len(x) for x in rows], np.int64)
                crc = [zlib.crc32(x.tobytes()) for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with that id): only blocks whose id range holds it are opened, one at a time."""
    dictionary = _dictionary(spark, path)
    rows = spark.read.parquet(f"{path}/blocks").filter((F.coalesce("first_id", F.lit(doc_id)) <= doc_id) & (F.col("last_id") >= doc_id)).select("block")
    blocks = (Block(bytes(r.block), dictionary) for r in rows.toLocalIterator())
    return [b.ids(i) for b in blocks for i, x in enumerate(b.doc_ids) if x == doc_id]


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents to the shared folder, and the report that ``read`` makes of those files."""
    path = common.scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
