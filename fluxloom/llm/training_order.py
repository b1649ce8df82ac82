"""Token sequences written in training order to fixed-stride binary shards.

The first pass counts the sequences of every input partition, so each sequence has an index in
[0, n). A keyed Feistel permutation, walked along its cycle until it falls below n, turns the
index into the sequence's slot in the training order. The second pass tokenises again rather
than store all ids twice, sends every sequence to the shard that covers its slot, and
writes the shards sorted. Record k of shard s stands at byte k * stride and has slot s * SHARD + k, so a
reader can start at any slot. Only one number per input partition reaches the driver.

``docs`` must give the same rows in the same partitions each time it is read, as a table of files
does; the second pass compares its counts and checksums with the first and fails if they differ.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.tokens import byte_bpe, default_path

LENGTH = 512  # ids of a sequence; the last one of a document may hold fewer
SHARD = 32_768  # sequences of a shard
HEAD = "<qIHH"  # document, piece, ids, 1 if the document's identifier is null
HEAD_SIZE = struct.calcsize(HEAD)
ROUNDS = 4
KEY = 0x5EED


def _round(half: np.ndarray, key: int, number: int) -> np.ndarray:
    x = half ^ np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each index: a permutation of [0, n) that depends on the key alone."""
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << bits) - 1)
    value, walking = index.astype(np.uint64), np.arange(len(index))
    while len(walking):
        left, right = value[walking] >> np.uint64(bits), value[walking] & low
        for number in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, number) & low)
        value[walking] = (left << np.uint64(bits)) | right
        walking = walking[value[walking] >= n]
    return value.astype(np.int64)


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY, end_id: int = 50256, tokens: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the sequences of all documents below ``path``; returns their number.

    A document is the ids of its whole text and the end id, cut into sequences of ``length``. A null
    text is empty and gives the end id alone. Repeated rows are written each. Identifiers are integers or null.
    Other columns are ignored; no rows write no shard. ``path/manifest`` holds what a reader must know.
    """
    tokens, spark = tokens or default_path(), docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def coded(batch: pa.RecordBatch) -> Iterator[bytes]:
        bpe, end = byte_bpe(tokens, 2), struct.pack("<H", end_id)
        for text in batch.column(1):
            yield bpe.ids(text.as_py()) + end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = check = 0
        for batch in batches:
            for ids in coded(batch):
                n += -(-len(ids) // (2 * length))
                check = zlib.crc32(ids, check)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), n, check)], names=["part", "n", "check"])

    counted = sorted(tuple(r) for r in rows.mapInArrow(count, "part bigint, n bigint, check bigint").collect())
    bases, total = {}, 0
    for part, n, check in counted:
        bases[part] = (total, n, check)
        total += n
    spark.createDataFrame([(total, length, SHARD, HEAD_SIZE + 2 * length + 1, key)], "n bigint, length int, shard int, stride int, key bigint").coalesce(1).write.json(f"{path}/manifest")
    if not total:
        return 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, expected, seen = bases[TaskContext.get().partitionId()]
        n = check = 0
        for batch in batches:
            records = []
            for k, ids in enumerate(coded(batch)):
                check = zlib.crc32(ids, check)
                identifier = batch.column(0)[k].as_py()
                for piece, at in enumerate(range(0, len(ids), 2 * length)):
                    own = ids[at : at + 2 * length]
                    records.append(struct.pack(HEAD, identifier or 0, piece, len(own) // 2, identifier is None) + own)
            if records:
                own = slots(np.arange(base + n, base + n + len(records)), total, key)
                n += len(records)
                yield pa.RecordBatch.from_arrays([pa.array((own // SHARD).astype(np.int32)), pa.array((own % SHARD).astype(np.int32)), pa.array(records, pa.binary())], names=["shard", "place", "record"])
        if (n, check) != (expected, seen):
            raise RuntimeError("the documents came in other partitions than before; write them to a table first")

    dealt = rows.mapInArrow(deal, "shard int, place int, record binary")
    ordered = dealt.repartitionById(-(-total // SHARD), "shard").sortWithinPartitions("shard", "place")
    # padded only now, so that the shuffle carries ids alone; the sink's line end completes the stride
    padded = F.rpad("record", F.lit(HEAD_SIZE + 2 * length), F.lit(b"\0"))
    ordered.select("shard", padded.cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(f"{path}/shards")
    return total


class ShardError(ValueError):
    """A shard that does not have the manifest's layout."""


def read_shards(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """``slot, doc_id, piece, length, ids`` from slot ``first`` on; shards before it are not opened."""
    note = spark.read.schema("n bigint, length int, shard int, stride int, key bigint").json(f"{path}/manifest").first()
    fields = "slot bigint, doc_id bigint, piece bigint, length int, ids binary"
    if not note["n"]:
        return spark.createDataFrame([], fields)
    n, size, stride = note["n"], note["shard"], note["stride"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                count = min(size, n - shard * size)
                if len(raw) != count * stride:
                    raise ShardError(f"shard {shard} has {len(raw)} bytes, not {count} records of {stride}")
                start = max(0, first - shard * size)
                for low in range(start, count, 4096):
                    rows = []
                    for k in range(low, min(low + 4096, count)):
                        identifier, piece, ids, none = struct.unpack_from(HEAD, raw, k * stride)
                        at = k * stride + HEAD_SIZE
                        rows.append((shard * size + k, None if none else identifier, piece, ids, raw[at : at + 2 * ids]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["slot", "doc_id", "piece", "length", "ids"])

    files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("shard") >= first // size)
    return files.select(F.col("shard").cast("int"), "content").mapInArrow(read, fields)
