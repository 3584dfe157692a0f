"""Directly addressable codes for token ids.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id, level 1 the next chunk of
those ids that have one, and so on; each level but the last has a bitmap that tells which ids go on, and
a rank directory with the count of set bits before each 512-bit block. So any id is found by one rank a
level, without decoding what stands before it.

A segment (little-endian):

    "LWDAC1\\0\\0"  crc32 of the rest u32  levels u32  documents u64  ids u64
    documents x i64 doc_id, documents x u64 end (ids of the segment up to the document's end)
    for each level: n u64, n x u8 chunks, and unless it is the last: ceil(n/8) bytes of bitmap (lowest
    bit first), ceil(n/512) x u32 rank directory

A file set is a Parquet table with one segment a row (bucket, place, before, n_docs, n_ids, data), documents
in ascending doc_id order within a segment, segments by (bucket, place); before: the ids of the bucket that
stand before the segment. A bucket is a range of doc_ids and one task. Spark's committers write the table
whole or not at all on any store, and a lost task is redone.

Edge cases: a null or empty text is the end id alone; documents without doc_id come first; rows that
repeat a doc_id are kept each, in the order of a hash of their texts, by which they too are dealt to
buckets; other columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lets_go, shuffle_width, small, small_batches, takes_over
from .tokens import encoder

MAGIC = b"LWDAC1\0\0"
RANK = 512
NO_ID = -(2**63)


def encode_segment(ids: np.ndarray, doc_ids: list[int], ends: list[int]) -> bytes:
    rest = np.ascontiguousarray(ids, "<u4")
    levels: list[bytes] = []
    while True:
        chunk = (rest & np.uint32(255)).astype(np.uint8)
        more = rest > 255
        part = [struct.pack("<Q", len(rest)), chunk.tobytes()]
        if more.any():
            part.append(np.packbits(more, bitorder="little").tobytes())
            starts = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK), dtype=np.int64))[:-1]])
            part.append(starts.astype("<u4").tobytes())
            levels.append(b"".join(part))
            rest = rest[more] >> np.uint32(8)
        else:
            levels.append(b"".join(part))
            break
    body = struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)) + np.array(doc_ids, "<i8").tobytes() + np.array(ends, "<u8").tobytes() + b"".join(levels)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Segment:
    """A segment opened over its bytes; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes, check: bool = True):
        if data[:8] != MAGIC:
            raise ValueError("not a segment")
        if check and zlib.crc32(memoryview(data)[12:]) != struct.unpack_from("<I", data, 8)[0]:
            raise ValueError("damaged segment")
        count, docs, self.size = struct.unpack_from("<IQQ", data, 12)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        self.levels = []
        for k in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k < count - 1:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", -(-n // RANK), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """The id at a place, by one rank a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK * (RANK // 8)
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[i // RANK]) + before
        return value

    def all(self) -> np.ndarray:
        out = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype("<u4")
            if bits is not None:
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= out << np.uint32(8)
            out = here
        return out


_ROWS = "bucket int, place int, before long, n_docs long, n_ids long, data binary"


def _encode(path: str, end_id: int, per: int):
    def run(batches):
        takes_over("tokens")
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        bucket, place, before, docs, parts, total, ends = None, 0, 0, [], [], 0, []

        def flush():
            nonlocal place, before, docs, parts, total, ends
            data = encode_segment(np.frombuffer(b"".join(parts), "<u4"), docs, ends)
            values = [pa.array([bucket], pa.int32()), pa.array([place], pa.int32()), *(pa.array([n], pa.int64()) for n in (before, len(docs), total)), pa.array([data], pa.binary())]
            place, before, docs, parts, total, ends = place + 1, before + total, [], [], 0, []
            return pa.RecordBatch.from_arrays(values, names=["bucket", "place", "before", "n_docs", "n_ids", "data"])

        for batch in batches:
            buckets, ids, coded = batch.column(0).to_pylist(), batch.column(1).to_pylist(), enc.encode(batch.column(2).to_pylist())
            for b, i, x in zip(buckets, ids, coded, strict=True):
                if docs and (b != bucket or total >= per):
                    yield flush()
                if b != bucket:
                    bucket, place, before = b, 0, 0
                docs.append(NO_ID if i is None else i)
                parts += (x, end)
                total += len(x) // 4 + 1
                ends.append(total)
        if docs:
            yield flush()
        del enc
        lets_go("tokens")

    return run


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, per: int = 1 << 19, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts in ascending doc_id order into the file set ``path``."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(buckets or shuffle_width(spark), "id", "tie").sortWithinPartitions("id", "tie", "text")
    rows.select(F.spark_partition_id().alias("bucket"), "id", "text").mapInArrow(_encode(tokenizer, end_id, per), _ROWS).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            segment = Segment(batch.column(3)[row].as_buffer().to_pybytes())
            raw = segment.all().tobytes()
            ends = segment.ends.astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            base = batch.column(2)[row].as_py()
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids = pa.array([None if i == NO_ID else i for i in segment.doc_ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, place, start, n_ids, data) of a file set; start: ids of all segments before."""
    table = spark.read.schema(_ROWS).parquet(path)
    # one row a bucket, whose number the writer fixed
    at, first = 0, []
    for r in sorted(table.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["bucket"]):
        first.append((r["bucket"], at))
        at += r["n"]
    offsets = small(spark.createDataFrame(first, "bucket int, at long"))
    return table.join(offsets, "bucket").select("bucket", "place", (F.col("at") + F.col("before")).alias("start"), "n_ids", "data")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from a file set."""
    small_batches(spark)
    return segments(spark, path).select("bucket", "place", "start", "data").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, place: int) -> int | None:
    """The id at a place of the whole file set; only its segment is opened."""
    row = segments(spark, path).where((F.col("start") <= place) & (F.col("start") + F.col("n_ids") > place)).select("start", "data").first()
    return None if row is None else Segment(bytes(row["data"]))[place - row["start"]]
