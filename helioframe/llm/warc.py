"""WARC archives written and read in splits.

Writing: each task writes one archive. Equal payloads of at least ``MIN_BYTES`` bytes are stored once, in the
record of the largest page_id; the others become revisit records that refer to it. Which digests occur more
than once is a small table made first, so payloads are neither shuffled nor compared.

Reading: a split of an archive may begin anywhere, and a payload may hold the very bytes that begin a record.
Each task takes every place in its split that looks like a record head, and where a record that began there
would end (its successor). True records are those on the chain from byte 0 of the file. Inside a split the
task follows successors itself and gives, per candidate, the first offset behind the split that the chain
reaches; over splits the chain is found by pointer jumping: in round r every candidate knows the place
2**r splits on, and reachable places pass that on, so a file of n splits takes log2(n) rounds of joins. A last
pass reads the records of each split from its reached entry on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm.storage import open_folder, task_file
from helioframe.llm.text import ready
from helioframe.session import persist_table, scratch_path

MIN_BYTES = 1000
SPLIT_BYTES = 8 << 20
MOST_TASKS = 20_000
HEAD_BYTES = 1 << 16          # read behind a split at once; longer heads are read on
MAGIC = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
_LENGTH = rb"\r\nContent-Length: (\d{1,18})\r\n"      # longer numbers are no lengths

FILES = "folder string, file string, bytes bigint, records bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, file string, offset bigint"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def repeated_payloads(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """digest and largest page_id of payloads of at least ``MIN_BYTES`` that occur more than once; stored."""
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    big = pages.select(F.col(f"`{key}`").alias("_key"), body.alias("_body")).filter(F.octet_length("_body") >= MIN_BYTES)
    groups = big.select("_key", F.sha1("_body").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("_key").alias("first_id"))
    return persist_table(groups.filter("n > 1").select("digest", "first_id"), "repeated")


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; returns the stored list of files."""
    spark = ready(pages.sparkSession)
    folder = scratch_path(spark, "warc")
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # a stored table of known size: Spark broadcasts it only if it is small
    rows = rows.join(repeated_payloads(pages, key, html).withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, count, out = task_file("pages", ".warc"), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files, where = open_folder(folder)
                files.create_dir(where, recursive=True)
                out = files.open_output_stream(f"{where}/{name}")
            for page_id, target, payload, digest, first_id in zip(*(batch.column(i) for i in range(5)), strict=True):
                mine, first = page_id.as_py(), first_id.as_py()
                record = build_record(mine, target.as_py(), payload.as_py(), digest.as_py(), first, first is not None and first != mine)
                out.write(record)
                size, count = size + len(record), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["folder", "file", "bytes", "records"])

    return persist_table(rows.mapInArrow(step, FILES), "warc-files")


def _split_table(files: DataFrame, split_bytes: int) -> DataFrame:
    start = F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)"))
    splits = files.filter("bytes > 0").select("folder", "file", "bytes", start.alias("start"))
    return splits.repartition(_tasks(files, split_bytes), F.col("file"), F.col("start"))


def _tasks(files: DataFrame, split_bytes: int) -> int:
    """A task per split: the rows that name splits are a few bytes, so without a number Spark would merge them all."""
    splits = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return max(1, min(int(splits), MOST_TASKS))


class Split:
    """The bytes of one split and enough behind it to complete a head that begins inside."""

    def __init__(self, stream, start: int, size: int, end_of_file: int):
        self.start, self.stop, self.stream, self.end_of_file = start, min(start + size, end_of_file), stream, end_of_file
        self.data = stream.read_at(min(self.stop + HEAD_BYTES, end_of_file) - start, start)

    def successor(self, offset: int) -> int | None:
        """Where a record that begins at ``offset`` ends, or None if there is no head."""
        at = offset - self.start
        while not self.data.startswith(MAGIC, at) or (end := self.data.find(b"\r\n\r\n", at)) < 0:
            known = self.start + len(self.data)
            short = len(self.data) < at + len(MAGIC) or self.data.startswith(MAGIC, at)
            if not short or known >= self.end_of_file:
                return None
            self.data += self.stream.read_at(min(len(self.data), self.end_of_file - known), known)
        found = re.search(_LENGTH, self.data[at:end + 2])
        after = None if found is None else self.start + end + 4 + int(found[1]) + 4
        return after if after is not None and after <= self.end_of_file else None

    def candidates(self) -> dict[int, int]:
        out, at = {}, self.data.find(MAGIC)      # a magic cut by the end of the split lies within HEAD_BYTES
        while 0 <= at < self.stop - self.start:
            after = self.successor(self.start + at)
            if after is not None:
                out[self.start + at] = after
            at = self.data.find(MAGIC, at + 1)
        return out


def boundary_candidates(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """folder, file, offset, after: all that look like record heads, and where their chain leaves the split."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file, size, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                files, where = open_folder(folder)
                with files.open_input_file(f"{where}/{file}") as stream:
                    after = Split(stream, start, split_bytes, size).candidates()
                for offset in sorted(after, reverse=True):
                    after[offset] = after.get(after[offset], after[offset])
                yield pa.RecordBatch.from_arrays([
                    pa.array([folder] * len(after), pa.string()), pa.array([file] * len(after), pa.string()),
                    pa.array(list(after), pa.int64()), pa.array(list(after.values()), pa.int64())], names=["folder", "file", "offset", "after"])

    return _split_table(files, split_bytes).mapInArrow(step, "folder string, file string, offset bigint, after bigint")


def reachable_entries(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """folder, file, offset at which the true chain enters each split; stored."""
    jumps = persist_table(boundary_candidates(files, split_bytes), "candidates")
    reached = files.filter("bytes > 0").select("folder", "file", F.lit(0).cast("bigint").alias("offset"))
    hops = files.agg(F.max(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    step = 1
    while step < hops:
        onward = reached.join(jumps, ["folder", "file", "offset"]).select("folder", "file", F.col("after").alias("offset"))
        reached = persist_table(reached.union(onward).distinct(), "reached")
        ahead = jumps.select("folder", "file", F.col("offset").alias("after"), F.col("after").alias("next"))
        jumps = persist_table(jumps.join(ahead, ["folder", "file", "after"], "left").select(
            "folder", "file", "offset", F.coalesce("next", "after").alias("after")), "jumps")
        step *= 2
    return reached


def parse_record(record: bytes) -> dict:
    head, _, body = record[:-4].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(_LENGTH, http + b"\r\n")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def key(name: str) -> int | None:
        text = fields.get(name, "")[len("<urn:page:"):-1]
        return int(text) if text else None

    return {"page_id": key("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": key("WARC-Refers-To"), "payload": None if revisit else payload}


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All true records of the archives, checked against their digests.

    Null html is an empty payload; a null page_id or url is left out of the head and read back as null; of
    rows with the largest page_id and equal payloads all are responses; other columns are not written; an
    empty table gives no archive and no record. A damaged record or a broken chain raises.
    """
    entries = reachable_entries(files, split_bytes)
    rows = entries.join(files.select("folder", "file", "bytes"), ["folder", "file"]).filter("offset < bytes")
    rows = rows.select("folder", "file", "bytes", "offset").repartition(_tasks(files, split_bytes), F.col("file"), F.col("offset"))
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file, size, entry in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                files, where = open_folder(folder)
                with files.open_input_file(f"{where}/{file}") as stream:
                    stop, at, held, waiting = (entry // split_bytes + 1) * split_bytes, entry, [], 0
                    split = Split(stream, entry, stop - entry, size)
                    while at < min(stop, size):
                        after = split.successor(at)
                        if after is None:
                            raise ValueError(f"{file}: no record at {at}")
                        record = split.data[at - entry:after - entry] if after - entry <= len(split.data) else stream.read_at(after - at, at)
                        held.append({**parse_record(record), "file": file, "offset": at})
                        at, waiting = after, waiting + len(record)
                        if waiting > 1 << 22:
                            yield _records(held, names, types)
                            held, waiting = [], 0
                    if held:
                        yield _records(held, names, types)

    return rows.mapInArrow(step, RECORDS)


def _records(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def archive_files(spark: SparkSession, folder: str, names: list[tuple[str, int]]) -> DataFrame:
    """A file list, as ``write_warc`` returns it, for archives that exist already: names and sizes in bytes."""
    return spark.createDataFrame([(folder, n, b, None) for n, b in names], FILES)
