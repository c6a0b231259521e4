"""Token-id files: every document compressed by itself with a dictionary that all share.

A dataset is two Parquet folders. ``dictionary`` holds one row: the dictionary, its SHA-256,
and how ids are laid out. ``blocks`` holds rows of about ``BLOCK`` bytes in ascending doc_id
order: a payload of zstandard frames, one a document, and the index of it (ids, ends of the
frames, token counts). A block names the hash of its dictionary and its place in the token
stream of its file, so one short document is read from one block by one frame, and a reader
with another dictionary fails at once. Spark's commit makes the files whole or absent.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, place_of, slices
from descry.llm.encoding import encoder, end_mark, tokenizer_path
from descry.session import checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
END = 1
BLOCK = 1 << 20  # bytes of frames in a block
SAMPLE = 1000  # documents the dictionary is trained on
SAMPLE_BYTES = 1 << 14  # longest text of the sample
DICTIONARY = 1 << 16
LEVEL = 3
BLOCKS = ("part int, block int, dictionary string, first_token long, doc_ids array<bigint>, "
          "ends array<bigint>, n_tokens array<bigint>, payload binary")


@dataclass(frozen=True)
class Codec:
    """The shared dictionary, and the width of an id in bytes."""

    dictionary: bytes
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()

    def _shared(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def compressor(self):
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._shared(), write_content_size=True)

    def decompressor(self):
        return zstandard.ZstdDecompressor(dict_data=self._shared())

    def narrow(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes()

    def wide(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def trained(docs: DataFrame, path: str, byte_level: bool, end: int) -> Codec:
    """A dictionary from about ``SAMPLE`` of the texts up to ``SAMPLE_BYTES``, taken by hash.

    The sample is bounded and used whole; without enough of it there is no dictionary, and
    frames stand alone.
    """
    texts = exactly(docs, TEXT).filter(F.octet_length(TEXT).between(1, SAMPLE_BYTES))
    share = SAMPLE / max(texts.count(), 1)
    rows = texts.withColumn("place", place_of(TEXT)).filter(F.col("place") < share).select(TEXT).collect()
    known, mark = encoder(path, byte_level), end_mark(end)
    width = 2 if max(known.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
    codec = Codec(b"", width)
    samples = [codec.narrow(known.ids(r[TEXT]) + mark) for r in rows]
    if len(samples) < 16:
        return codec
    try:
        return Codec(zstandard.train_dictionary(
            min(DICTIONARY, sum(map(len, samples)) // 8), samples).as_bytes(), width)
    except zstandard.ZstdError:  # too little or too uniform to learn from
        return codec


def _blocks(codec: Codec, path: str, byte_level: bool, end: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mark, pack = encoder(path, byte_level), end_mark(end), codec.compressor()
        part, sha, block, first = TaskContext.get().partitionId(), codec.sha256, 0, 0
        ids, ends, counts, frames, held = [], [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([sha]),
                 pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([b"".join(frames)], pa.binary())],
                names=["part", "block", "dictionary", "first_token", "doc_ids", "ends", "n_tokens",
                       "payload"])

        for batch in batches:
            for piece in slices(batch, TEXT):
                for doc, text in zip(piece.column(DOC).to_pylist(), piece.column(TEXT).to_pylist(),
                                     strict=True):
                    tokens = known.ids(text) + mark
                    frame = pack.compress(codec.narrow(tokens))
                    ids.append(doc)
                    frames.append(frame)
                    held += len(frame)
                    ends.append(held)
                    counts.append(len(tokens) // 4)
                    if held >= block_bytes:
                        yield flush()
                        block, first = block + 1, first + sum(counts)
                        ids, ends, counts, frames, held = [], [], [], [], 0
        if ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None,
                      byte_level: bool = False, end: int = END, block_bytes: int = BLOCK) -> None:
    """Encodes every whole text of ``docs`` (doc_id, text) into ``folder``.

    Documents are dealt to tasks by ranges of (doc_id, hash, row), so that not even a doc_id
    of a third of all rows meets in one task, and sorted there. A null text is empty and holds
    the end id alone; null doc_ids come first; repeated rows are all kept, next to each other.
    An empty table gives empty folders.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path(TOKENIZER)
    codec = trained(docs, path, byte_level, end)
    spark.createDataFrame([(codec.sha256, codec.width, bytearray(codec.dictionary))],
                          "sha256 string, width int, dictionary binary").coalesce(1).write.parquet(
        f"{folder}/dictionary")
    keys = [DOC, "h", "row"]
    dealt = (exactly(docs, DOC, TEXT).selectExpr(f"cast({DOC} as long) {DOC}", TEXT)
             .withColumn("h", F.xxhash64(TEXT)).withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
             .sortWithinPartitions(*keys).select(DOC, TEXT))
    dealt.mapInArrow(_blocks(codec, path, byte_level, end, block_bytes), BLOCKS).write.parquet(
        f"{folder}/blocks")


def codec_of(spark: SparkSession, folder: str) -> Codec:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return Codec(bytes(row["dictionary"]), row["width"])


def _frames(batch: pa.RecordBatch, sha: str) -> Iterator[tuple[int, int, list, list, list, bytes]]:
    for row in batch.to_pylist():
        if row["dictionary"] != sha:
            raise ValueError("a block was written with another dictionary")
        yield row["part"], row["first_token"], row["doc_ids"], row["ends"], row["n_tokens"], row["payload"]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decompressed ids.

    ``start`` adds up token counts of files (one number a file is gathered), blocks and
    documents.
    """
    codec = codec_of(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate(
        "n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("n")).collect()
    base, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        base[row["part"]], total = total, total + row["n"]
    shared = spark.sparkContext.broadcast((codec, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, base = shared.value
        unpack, sha = codec.decompressor(), codec.sha256
        for batch in batches:
            rows = []
            for part, first, ids, ends, counts, payload in _frames(batch, sha):
                start, at = base[part] + first, 0
                for doc, stop, n in zip(ids, ends, counts, strict=True):
                    raw = codec.wide(unpack.decompress(payload[at:stop]))
                    if len(raw) != n:
                        raise ValueError(f"document {doc} has {len(raw)} ids, its index says {n}")
                    rows.append((doc, start, n, zlib.crc32(raw)))
                    start, at = start + n, stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)],
                names=[DOC, "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, f"{DOC} long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with this id), by the index of its block alone."""
    codec = codec_of(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    found = blocks.filter(F.array_contains("doc_ids", doc_id)).orderBy("part", "block")
    out, unpack = [], codec.decompressor()
    for row in found.collect():
        for i, doc in enumerate(row["doc_ids"]):
            if doc == doc_id:
                at = row["ends"][i - 1] if i else 0
                out.append(codec.wide(unpack.decompress(bytes(row["payload"][at:row["ends"][i]]))))
    return out


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared place and reads the files back."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/llm/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder)
    return read_token_files(docs.sparkSession, folder)
