"""Token ids as binary shards: one zstandard frame per document under a shared dictionary, with an offset index.

A shard is   MAGIC, frames..., index, footer.   The index is a zstandard frame of rows (id, ids before this document in
the shard, number of ids, offset of its frame); the footer holds the index's offset and length, the number of
documents and of ids, and the SHA-256 of the dictionary. A document is read by seeking to its frame alone.
Ids are little-endian unsigned 32-bit integers before compression. Beside the shards lie dictionary (its bytes) and manifest (the
shards in order, with the number of ids before each), both Parquet, so a folder can be read without anything else.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, shared_path, shuffle_partitions, text_of
from .encode import encoder, slices

MAGIC = b"PLTOK001"
FOOTER = struct.Struct("<QQQQ32s8s")
INDEX = np.dtype([("has_id", "u1"), ("id", "<i8"), ("before", "<u8"), ("n", "<u8"), ("at", "<u8")])
#: The dictionary is trained on at most this many documents of at most so many bytes, chosen by a hash of their text, as it serves short documents.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 2000, 16 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: A shard is closed when it has so many bytes or documents; a reader holds the index of one shard and some of its frames.
SHARD_BYTES, SHARD_DOCUMENTS, READ_BYTES = 128 << 20, 1 << 20, 8 << 20

SHARDS = "path string, part long, nth long, n_documents long, n_tokens long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def train_dictionary(docs: DataFrame, tokenizer_path: str, text_col: str, end_id: int, documents: int = SAMPLE_DOCUMENTS) -> bytes:
    """A zstandard dictionary of serialized ids, the same at each run; empty where the sample is too small to train one."""
    every = max(1, docs.count() // max(1, documents))
    drawn = docs.select(text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t")).filter(F.pmod("h", F.lit(every)) == 0)
    # The share drawn of a table is about `documents` rows, so the order is over few rows; copies of one text count once.
    rows = drawn.filter(F.octet_length("t") <= SAMPLE_BYTES).dropDuplicates(["h"]).orderBy("h", "t").limit(documents).select("t").collect()
    encoded = encoder(tokenizer_path).encode_batch([r[0] for r in rows])
    samples = [np.append(ids, end_id).astype("<u4").tobytes() for ids in encoded]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    """Writes one shard to an open file; documents come in the order that they keep."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.dictionary = out, dictionary
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        self.rows: list[tuple] = []
        self.at, self.tokens = len(MAGIC), 0
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        frame = self.compress(ids.astype("<u4").tobytes())
        self.rows.append((key is not None, key or 0, self.tokens, len(ids), self.at))
        self.out.write(frame)
        self.at += len(frame)
        self.tokens += len(ids)

    def close(self) -> None:
        index = zstandard.ZstdCompressor(level=LEVEL).compress(np.array(self.rows, INDEX).tobytes())
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(index), len(self.rows), self.tokens, hashlib.sha256(self.dictionary).digest(), MAGIC))


class ShardReader:
    """Random access to a shard; refuses another dictionary than the one it was written with."""

    def __init__(self, path: str, dictionary: bytes):
        fs, own = _open(path)
        self.file = fs.open_input_file(own)
        size = self.file.size()
        at, length, self.n_documents, self.n_tokens, digest, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a shard of this dictionary")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at)), INDEX)
        self.ends = np.append(self.index["at"][1:], at).astype(np.int64)
        self.expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, row: int) -> np.ndarray:
        """Of one document, by a read of its frame alone."""
        return self.run(row, row + 1)[0]

    def run(self, low: int, high: int) -> list[np.ndarray]:
        """Of documents that follow each other, by one read."""
        first, ends = int(self.index["at"][low]), self.ends[low:high]
        raw = memoryview(self.file.read_at(int(ends[-1]) - first, first))
        return [np.frombuffer(self.expand(raw[a - first : b - first]), "<u4") for a, b in zip(self.index["at"][low:high].tolist(), ends.tolist(), strict=True)]


def write(
    docs: DataFrame, tokenizer_path: str, root: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    dictionary: bytes | None = None, partitions: int | None = None, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Writes all documents in ascending order of id below root: shards, dictionary and manifest.

    Null ids come first, null texts are empty documents, repeated rows are each written; rows of one id are ordered by
    the first bytes and a hash of their text, and may be spread over several tasks. A task writes shards under names of its own
    attempt, and the manifest lists only what finished tasks report, so lost executors leave nothing that is read.
    An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, text_col, end_id) if dictionary is None else dictionary
    n = partitions or shuffle_partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, nth = encoder(tokenizer_path).encode_flat, TaskContext.get().partitionId(), 0
        fs, folder = _open(root)
        own, writer, out, done = "", None, None, []

        def close():
            nonlocal writer
            writer.close()
            out.close()
            done.append((f"{root}/{own}", part, nth, len(writer.rows), writer.tokens))
            writer = None

        for batch in batches:
            low = 0
            for texts in slices(batch.column(1)):
                keys = batch.column(0).slice(low, len(texts)).to_pylist()
                low += len(texts)
                flat, ends = encode(texts)
                flat = np.insert(flat, ends[1:], np.uint32(end_id))
                for i, key in enumerate(keys):
                    if writer is None:
                        fs.create_dir(folder, recursive=True)
                        own = f"shard-{part:07d}-{nth:05d}-{uuid.uuid4().hex}.tok"
                        out = fs.open_output_stream(f"{folder}/{own}")
                        writer = ShardWriter(out, dictionary)
                    writer.add(key, flat[ends[i] + i : ends[i + 1] + i + 1])
                    if writer.at >= shard_bytes or len(writer.rows) >= SHARD_DOCUMENTS:
                        close()
                        nth += 1
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["path", "part", "nth", "n_documents", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("t"))
    # Beyond the id, keys that let rows of one id, null among them, and copies of one text be dealt to several tasks.
    keys = [F.col("k").asc_nulls_first(), *(F.col(f"{P}{c}").asc() for c in ("head", "hash", "nth"))]
    rows = rows.withColumn(f"{P}head", F.substring("t", 1, 16)).withColumn(f"{P}hash", F.xxhash64("t")).withColumn(f"{P}nth", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("k", "t")
    # One row per shard of SHARD_BYTES comes to the driver.
    shards = sorted(tuple(r) for r in ordered.mapInArrow(run, SHARDS).select("part", "nth", "path", "n_documents", "n_tokens").collect())
    starts = np.cumsum([0, *(s[4] for s in shards)]).tolist()
    listed = [(i, s[2], s[3], s[4], starts[i]) for i, s in enumerate(shards)]
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "bytes binary, sha256 string").coalesce(1).write.mode("overwrite").parquet(f"{root}/dictionary")
    spark.createDataFrame(listed, "number long, path string, n_documents long, n_tokens long, start long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """number, path, n_documents, n_tokens, start (ids of all documents before): one row per shard."""
    return spark.read.parquet(f"{root}/manifest")


def dictionary_of(spark: SparkSession, root: str) -> bytes:
    return bytes(spark.read.parquet(f"{root}/dictionary").first()["bytes"])


def read(spark: SparkSession, root: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of a folder that write has made: id, start, n_tokens, ids_crc32 (and ids); a task for each shard."""
    dictionary, listed = dictionary_of(spark, root), manifest(spark, root)
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                shard = ShardReader(path, dictionary)
                low = 0
                while low < len(shard.index):
                    high = max(low + 1, int(np.searchsorted(shard.ends, int(shard.index["at"][low]) + READ_BYTES, side="right")))
                    part = shard.index[low:high]
                    ids = shard.run(low, high)
                    out = pd.DataFrame({
                        id_col: pd.array(part["id"], "Int64"),
                        "start": start + part["before"].astype(np.int64),
                        "n_tokens": [len(i) for i in ids],
                        "ids_crc32": [zlib.crc32(i) for i in ids],
                    })
                    out.loc[part["has_id"] == 0, id_col] = pd.NA
                    if with_ids:
                        out["ids"] = [i.astype(np.int32) for i in ids]
                    yield out
                    low = high

    n = max(1, listed.count())
    return listed.select("path", "start", "number").repartitionByRange(n, "number").mapInPandas(run, schema)


def encode_and_read(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    root = shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, root, id_col, text_col, end_id)
    return read(docs.sparkSession, root, id_col)


__all__ = ["ShardReader", "ShardWriter", "dictionary_of", "encode_and_read", "manifest", "read", "train_dictionary", "write"]
