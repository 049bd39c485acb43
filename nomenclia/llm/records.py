"""Token ids as length-delimited binary records with a separate offset index.

File format (little-endian). A file is a run of records::

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload | 0x0A

A payload is ``u8 has_id | i64 doc_id | u8 width | ids`` with ids of ``width``
bytes. The mask is that of the common record formats: the CRC-32 rotated right
by 15 bits plus 0xA282EAD8. Records ascend by doc_id (equal ones by a digest of
the text) within a file and over files in the order of their part numbers. The
writer is Spark's own, so any store that Spark can write will do; every file is
bounded in records, and in bytes by the longest text.

The index is a Parquet table with one row a record: doc_id, file, byte offset
and length, tokens before it and in it. ``fetch`` reads chosen records by it.

Cases: a null doc_id is kept as null and sorts first; rows of one doc_id are in
the order of their texts' digests, so that reruns agree, and may be dealt to
several tasks; null and empty texts are a record of the end id alone; repeated
rows are records of their own; very long texts make files of fewer records; an
empty table gives an empty index; extra columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import python_ready, slices, stage
from nomenclia.llm.tokens import encoder

END_ID = 2
RECORDS_PER_FILE = 8192
#: Bytes of a file at most, unless one record is larger; readers take files whole.
FILE_BYTES = 1 << 28
TAIL = b"\n"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without the tail byte, which the writer adds."""
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record; raises ValueError on a broken one."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        (size,), (check,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, at + 8)
        if masked_crc(head) != check:
            raise ValueError(f"broken length at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        if len(payload) != size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(payload) or data[at + 16 + size : at + 17 + size] != TAIL:
            raise ValueError(f"broken record at byte {at}")
        yield at, payload
        at += size + 17


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width = struct.unpack_from("<BqB", payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path`` in ascending doc_id order."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = end_id.to_bytes(encode.width, "little")
        for batch in slices(batches):
            ids = encode.encode([t or "" for t in batch.column("text").to_pylist()])
            rows = [frame(struct.pack("<BqB", i is not None, i or 0, encode.width) + x + end) for i, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    python_ready(docs.sparkSession)
    # A text has at most one id a byte, of four bytes at most.
    longest = docs.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()[0]
    records_per_file = max(1, min(records_per_file, FILE_BYTES // (4 * longest + 64)))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest"))
    ordered = keyed.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    framed = ordered.mapInArrow(encoded, "record binary").select(F.col("record").cast("string").alias("value"))
    framed.write.option("lineSep", TAIL.decode()).option("maxRecordsPerFile", records_per_file).text(path)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read every record under ``path``, verify it and index it; the index is staged.

    Columns: doc_id, file, offset, length, start (tokens of all records
    before), n_tokens, ids_crc32 (of the ids as unsigned 32-bit).
    """
    schema = "doc_id long, file string, offset long, length long, before long, n_tokens long, ids_crc32 long"

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for at, payload in frames(data.as_py()):
                    doc_id, ids = parse(payload)
                    rows.append((doc_id, file, at, len(payload) + 17, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                names = ["doc_id", "file", "offset", "length", "before", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    python_ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    index = stage(files.mapInArrow(indexed, schema), "index")
    number = lambda p: F.regexp_extract("file", p, 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"part": number(r"part-(\d+)"), "c": number(r"-c(\d+)[.]txt")})
    # Sums of whole parts first, so that the one window over all has a row a part.
    above = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(above.orderBy("part")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(above.partitionBy("part").orderBy("c", "file")), F.lit(0))
    ends = files.join(parts, "part").select("file", (F.col("first") + inside).alias("base"))
    return index.join(ends, "file").select("doc_id", "file", "offset", "length", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(chosen: DataFrame) -> DataFrame:
    """The rows of an index (any subset, any order) with ``ids``, each file of theirs read once and cut at the offsets."""
    spark = chosen.sparkSession
    python_ready(spark)
    folders = {f.rsplit("/", 1)[0] for (f,) in chosen.select(F.regexp_replace("file", "[^/]*$", "x")).distinct().collect()}
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(sorted(folders)).select(F.col("path").alias("file"), "content")
    wanted = chosen.groupBy("file").agg(F.collect_list(F.struct(*chosen.columns)).alias("rows"))
    schema = T.StructType([*chosen.schema.fields, T.StructField("ids", T.ArrayType(T.LongType()))])
    arrow, names = to_arrow_schema(schema), chosen.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, rows = memoryview(batch.column("content")[0].as_buffer()), batch.column("rows").flatten()
            at = zip(rows.field("offset").to_pylist(), rows.field("length").to_pylist(), strict=True)
            ids = [parse(next(frames(bytes(data[start : start + length])))[1])[1] for start, length in at]
            yield pa.RecordBatch.from_arrays([*(rows.field(c).cast(arrow.field(c).type) for c in names), pa.array(ids, arrow.field("ids").type)], schema=arrow)

    return content.join(wanted, "file").select("content", "rows").mapInArrow(cut, schema)
