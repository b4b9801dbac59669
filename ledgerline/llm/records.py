"""Token ids as length-delimited binary records with a separate offset index.

A file holds records in ascending document order, or in the order asked for, file after file. One record:

    8 bytes   length of the payload, little endian
    4 bytes   masked checksum of those 8 bytes
    payload   1 byte flags (1: an id follows, 2: ids are 4 bytes wide, else 2),
              8 bytes document id, then the token ids, little endian
    4 bytes   masked checksum of the payload
    1 byte    line feed

A masked checksum is the CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that
checksums stored inside checked bytes stay harmless. Files are written by Spark's own
committed text writer, one binary value per line, so lost or repeated tasks leave no
second copy and any file system that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.llm.common import require, text_of
from ledgerline.llm.tokens import WordEncoder, loaded
from ledgerline.session import fresh_path

#: Text that goes to one file; a reader holds one file at a time.
TEXT_PER_FILE = 24 << 20
HAS_ID, WIDE = 1, 2
_HEAD, _CRC, _PAYLOAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
FILES_PER_CHUNK = 10_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """One record without its line feed, which the writer adds."""
    payload = _PAYLOAD.pack((doc_id is not None) * HAS_ID | wide * WIDE, doc_id or 0) + ids
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Id, token ids and the next offset of the record at an offset; raises if a checksum is wrong."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or _CRC.unpack(data[at + 8 : at + 12])[0] != masked(head):
        raise ValueError(f"damaged record length at offset {at}")
    size = _HEAD.unpack(head)[0]
    payload = bytes(data[at + 12 : at + 12 + size])
    end = at + 12 + size
    if len(payload) < size or _CRC.unpack(data[end : end + 4])[0] != masked(payload) or data[end + 4 : end + 5] != b"\n":
        raise ValueError(f"damaged record at offset {at}")
    flags, doc_id = _PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=_PAYLOAD.size)
    return (doc_id if flags & HAS_ID else None), ids, end + 5


def write_records(docs: DataFrame, path: str, spec: str, end_id: int, doc_id: str = "doc_id", text: str = "text", text_per_file: int = TEXT_PER_FILE,
                  order: Sequence[str] = ()) -> None:
    """Writes the record files: ids of each whole text with ``end_id`` after them, in ascending order of the columns ``order``, by default of the id.

    Null text counts as empty and gives the end id alone. Null ids come first. Rows with
    equal ids are separate records, next to each other in no fixed order; rows of one id
    may be spread over files. An empty table gives no records. Other columns are not read.
    """
    require(docs, doc_id, text)
    spark = docs.sparkSession
    by = [f"__by{i}" for i in range(len(order))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), *[F.col(f"`{c}`").alias(b) for c, b in zip(order, by, strict=True)])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast(spec)
    digest = str(zlib.crc32(spec.encode()))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(WordEncoder, digest, lambda: shared.value)
        end, wide = np.array([end_id], dtype=encoder.dtype).tobytes(), encoder.dtype.itemsize == 4
        for batch in batches:
            for a, z in blocks_of(batch.column(1), 2 << 20):
                ids, ends = encoder.encode(batch.column(1).slice(a, z - a))
                starts = [0, *ends[:-1].tolist()]
                out = [frame(i, ids[s:e].tobytes() + end, wide) for i, s, e in zip(batch.column(0).slice(a, z - a).to_pylist(), starts, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    tie = F.monotonically_increasing_id()  # a frequent id must not fill one file
    spread = rows.withColumn("__tie", tie).repartitionByRange(max(1, -(-int(size) // text_per_file)), *(by or ["doc_id"]), "__tie").sortWithinPartitions(*(by or ["doc_id"]), "__tie").select("doc_id", "text")
    spread.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def blocks_of(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of an Arrow column of at most ``limit`` bytes of text, or of one text."""
    held = at = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (n or 0) > limit:
            yield at, i
            at, held = i, 0
        held += n or 0
    if at < len(texts):
        yield at, len(texts)


_INDEX = pa.schema([("file", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids_crc32", pa.int64())])
_INDEX_DDL = "file long, path string, at long, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(content.as_buffer())
            file = int(path.rpartition("/")[2].split("-")[1])
            rows, at, before = [], 0, 0
            while at < len(data):
                doc_id, ids, end = unframe(data, at)
                rows.append((file, path, len(rows), at, end - at, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                at, before = end, before + len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX.types, strict=True)], schema=_INDEX)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Reads the record files back, checks every record, and writes one index row per record.

    ``file, path, at`` (place in the file), ``offset, length`` (bytes), ``doc_id,
    n_tokens, start`` (tokens of all records before it), ``ids_crc32``.
    """
    found = files_of(spark, path).mapInArrow(_scan, _INDEX_DDL)
    found.write.parquet(f"{index_path}-parts")
    found = spark.read.parquet(f"{index_path}-parts")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("__tokens"))
    upto = skew.running(totals, [], ["file"], F.floor(F.col("file") / FILES_PER_CHUNK), {"__upto": ("sum", "__tokens")})
    before = upto.select("file", (F.col("__upto") - F.col("__tokens")).alias("__before"))
    found.join(before, "file").withColumn("start", F.col("__before") + F.col("before")).drop("before", "__before").write.parquet(index_path)
    return spark.read.parquet(index_path)


def shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """Records in a random order fixed by the seed: ``place, doc_id, ids``.

    Each file is read once and only the indexed records are cut out of it; a file's index
    rows are bounded by the file.
    """
    wanted = index.groupBy("path").agg(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "file", "at").alias("place"), "offset")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                got = [(w["place"], *unframe(data, w["offset"])[:2]) for w in want]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                                                  pa.array([g[2].astype("<i8") for g in got], pa.list_(pa.int64()))], ["place", "doc_id", "ids"])

    rows = files_of(spark, path).join(wanted, "path").select("content", "wanted")
    return rows.mapInArrow(cut, "place long, doc_id long, ids array<long>").orderBy("place")


def encode_to_records(docs: DataFrame, spec: str, end_id: int, path: str | None = None, **columns) -> DataFrame:
    """Writes records and index under ``path`` (by default in the shared folder) and returns the index."""
    path = path or fresh_path(docs.sparkSession, "records")
    write_records(docs, f"{path}/data", spec, end_id, **columns)
    return write_index(docs.sparkSession, f"{path}/data", f"{path}/index")
