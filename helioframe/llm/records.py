"""Token ids as length-delimited binary records with a separate offset index.

File ``*.rec``: records in a row, each ``length u64 | masked crc32 of the length u32 | payload | masked
crc32 of the payload u32``, little-endian. Payload: ``doc_id i64 | known u8 (0: null id) | width u8 | ids``
with ids of ``width`` bytes. File ``*.idx``: the u64 offset of each record, so a reader can take records in
any order. Masking keeps a checksum over data that holds checksums from being trivial:
``((crc >> 15 | crc << 17) + 0xa282ead8) mod 2**32``. The plain crc32 of zlib is used.

Texts are ranged on the key, so files and records ascend by it; the hash of the text, second in the range
key, splits a key that has many rows. The index is a table too: file, part, position, offset.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.storage import open_folder, task_file, task_part
from helioframe.llm.text import ready
from helioframe.llm.tokens import END_ID, encoder
from helioframe.session import persist_table, scratch_path

INDEX = ("part bigint, position bigint, file string, offset bigint, bytes bigint, doc_id bigint, n_tokens bigint, start_in_part bigint")
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one framed record; raises if a length or checksum is wrong."""
    length, check = struct.unpack_from("<QI", data)
    if masked(data[:8]) != check or len(data) != length + 16:
        raise ValueError("damaged record length")
    payload = data[12:12 + length]
    if masked(payload) != struct.unpack_from("<I", data, 12 + length)[0]:
        raise ValueError("damaged record")
    return payload


def to_payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids


def from_payload(payload: bytes) -> tuple[int | None, bytes]:
    """Key and ids as unsigned 32-bit numbers."""
    key, known, width = struct.unpack_from("<qBB", payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize("<qBB"))
    return key if known else None, ids.astype("<u4").tobytes()


def write_records(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and return the index, stored.

    Null or empty text gives the end id alone; a null key sorts first; rows with equal keys follow each other
    in the order of their texts' hashes; an empty table writes no records. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    folder = scratch_path(spark, "records")
    body = F.col(f"`{text}`").cast("binary")
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "_text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], dtype=code.dtype).tobytes()
        width, files, where = code.dtype.itemsize, *open_folder(folder)
        part, name, at, total, position, offsets, out = task_part(), task_file("part", ".rec"), 0, 0, 0, [], None
        for batch in batches:
            if out is None:
                files.create_dir(where, recursive=True)
                out = files.open_output_stream(f"{where}/{name}")
            index = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                ids = code.encode(content.as_py() or b"") + end
                record = frame(to_payload(doc_id, ids, width))
                out.write(record)
                index.append((part, position, name, at, len(record), doc_id, len(ids) // width, total))
                offsets.append(at)
                at, total, position = at + len(record), total + len(ids) // width, position + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _TYPES, strict=True)], names=_NAMES)
        if out is not None:
            out.close()
            with files.open_output_stream(f"{where}/{name.removesuffix('.rec')}.idx") as side:
                side.write(np.array(offsets, dtype="<u8").tobytes())

    index = persist_table(rows.mapInArrow(step, INDEX), "record-index")
    return index.withColumn("folder", F.lit(folder))


_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]


def read_records(index: DataFrame) -> DataFrame:
    """The records an index names, checked: doc_id, ids as unsigned 32-bit little-endian, and the index columns."""
    ready(index.sparkSession)
    names = index.columns
    file, folder, offset, size = (names.index(c) for c in ("file", "folder", "offset", "bytes"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields], "record_id bigint", "ids binary"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            for piece in _by_bytes(batch, size):
                ids, keys = [], []
                for f, d, o, n in zip(*(piece.column(i).to_pylist() for i in (file, folder, offset, size)), strict=True):
                    if opened != (d, f):
                        files, where = open_folder(d)
                        opened, stream = (d, f), files.open_input_file(f"{where}/{f}")
                    key, found = from_payload(unframe(stream.read_at(n, o)))
                    keys.append(key)
                    ids.append(found)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=[*names, "record_id", "ids"])

    return index.mapInArrow(step, schema)


def _by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices whose records take about ``READ_BYTES``."""
    total = np.cumsum(batch.column(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + READ_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all records before this one over all files."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    # one line per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return index.join(parts, "part").withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_before")
