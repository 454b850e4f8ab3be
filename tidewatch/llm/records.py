"""Token-id records: length-delimited binary frames with masked checksums, and a separate offset index.

One frame per document, in ascending order of id over the files ``part-00000`` on::

    u64 payload length | u32 masked crc32 of these 8 bytes | payload | u32 masked crc32 of the payload | newline
    payload: u8 width of an id (2 or 4; 128 more: the document has no id) | i64 doc_id | ids

All numbers are little-endian. The checksum is zlib's crc32, rotated and offset, as a checksum of bytes that hold
checksums is weak. Files are written by Spark's own text writer (a frame is its line), so retried and speculative
tasks leave no double records and any Hadoop path will do.

Defined results: a null text is empty (its frame holds the end id alone); a null id comes first; rows with one id
follow each other in the order of their texts' hashes; an empty table gives no file; other columns are not kept.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, new_folder, slices, text_bytes, texts_of
from tidewatch.llm.tokens import encoder

#: Fixed value: the offset added to a rotated checksum.
MASK = 0xA282EAD8
HEAD, BODY, TAIL = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<I")
NO_ID = 128
INDEX = "file string, record bigint, offset bigint, length bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, start_in_file bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its newline, which the writer adds; ``ids`` as little-endian 32-bit integers."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = BODY.pack(width | (NO_ID if doc_id is None else 0), doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(data: memoryview, offset: int) -> tuple[int | None, bytes, int]:
    """Id, ids (32-bit) and end of the frame at an offset; raises if a checksum differs."""
    length, check = HEAD.unpack_from(data, offset)
    begin = offset + HEAD.size
    if masked(bytes(data[offset : offset + 8])) != check:
        raise ValueError(f"the length at offset {offset} is damaged")
    payload = data[begin : begin + length]
    if TAIL.unpack_from(data, begin + length)[0] != masked(payload):
        raise ValueError(f"the record at offset {offset} is damaged")
    kind, doc_id = BODY.unpack_from(payload, 0)
    ids = bytes(payload[BODY.size :])
    if kind & ~NO_ID == 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return (None if kind & NO_ID else doc_id), ids, begin + length + TAIL.size + 1


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, kind: str | None = None, file_bytes: int = 32 << 20) -> None:
    """Encode whole texts, append ``end_id`` and write frames in ascending order of id.

    ``vocabulary``: number of ids; up to 65,536 they take two bytes each. ``file_bytes``: text per file, about.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    parts = slices(text_bytes(rows), file_bytes, spark)
    order = [F.col("doc_id"), F.xxhash64("text")]
    width = 2 if vocabulary <= 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()

    def frames(batches: Batches) -> Batches:
        encode = encoder(tokenizer, kind).many
        for batch in batches:
            out = [frame(i, ids + end, width) for i, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    framed = placed.mapInArrow(frames, "value binary")
    framed.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(folder)


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read every file back, check every frame, and say where each record is."""

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data, offset, start, found = memoryview(content.as_buffer()), 0, 0, []
                while offset < len(data):
                    doc_id, ids, end = unframe(data, offset)
                    found.append((len(found), offset, end - offset, doc_id, len(ids) // 4, zlib.crc32(ids), start))
                    start, offset = start + len(ids) // 4, end
                if found:
                    name = path.as_py().rsplit("/", 1)[-1]
                    columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                    names = [c.split()[0] for c in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), *columns], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(scan, INDEX)


def write_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index as a table of its own, one row per record, with ``start``: ids in all records before it."""
    index = cut(scan_records(spark, folder), "record-index")
    # One row per file goes through the ordered window, never one per record.
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = F.coalesce(F.sum("in_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("file"), before.alias("before_file"))
    return index.join(starts, "file").withColumn("start", F.col("before_file") + F.col("start_in_file")).drop("before_file")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Records at the (file, offset) rows of ``wanted``, in any order: ``doc_id, ids array<int>``. For shuffled reads."""

    def cut_out(batches: Batches) -> Batches:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                got = [unframe(data, o)[:2] for o in offsets.as_py()]
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for _, x in got]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    places = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.join(places, "file").select("content", "offsets").mapInArrow(cut_out, "doc_id bigint, ids array<int>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, kind: str | None = None) -> DataFrame:
    """Write records and index to the shared folder and return the index."""
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    write_records(docs, folder, tokenizer, end_id, vocabulary, kind)
    return write_index(spark, folder)
