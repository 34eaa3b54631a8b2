"""SentencePiece ids of whole texts by a table of distinct chunks.

A chunk is a run of whitespace marks and what follows up to the next mark. If no piece of the model holds a mark
behind another character and texts are not normalised otherwise, no merge crosses a chunk border, so the ids of a
text are the ids of its chunks in a row. Steps:

1. Texts are gathered into blocks of about ``BLOCK_BYTES``. A block lists its distinct chunks; a text becomes the
   numbers of its chunks in that list, frequent ones small. Blocks are written once, bucketed by block.
2. The lists, dealt into parts by the hash of the chunk, are shuffled by part. A part holds all places of its
   chunks, sends each distinct one to the library once, and answers every block with the ids.
3. The answers go to the bucket of their block, where ids are placed by position.

Only lists of distinct chunks and their ids are moved, sorted and packed: no text, no number and no row per word is
shuffled. Blocks have a bounded size, but for a single text that is longer, and the number of parts follows the bytes
of all texts, so no group grows with the corpus. A model whose pieces may cross a mark has whole texts as its
chunks: slower, and as exact.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.storage import task_part
from helioframe.llm.text import ready
from helioframe.session import scratch_path

BLOCK_BYTES = 16 << 20
PART_BYTES = 8 << 20
MOST_BUCKETS = 50_000
OUT_ROWS = 500
MARK = "▁"

_CHUNK = re.compile(" +[^ ]*")
END = b"\xff"            # in no UTF-8 text
BLOCKS = "block bigint, part int, chunks binary, keys array<bigint>, sizes binary, numbers binary, places binary"
ANSWERS = "block bigint, part int, lengths binary, ids binary"


class Model:
    """A loaded model, and what is true of its pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        rules = spec.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces)
        own = any(p.type == p.USER_DEFINED for p in spec.pieces)
        self.by_chunk = plain and not crossing and not own and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix
        self.dtype = np.dtype("<u2" if self.library.get_piece_size() <= 1 << 16 else "<u4")
        self.ends = [i for i in (self.library.bos_id(),) if i >= 0], [i for i in (self.library.eos_id(),) if i >= 0]

    def cut(self, text: str) -> list[str]:
        """Chunks with marks as blanks; the first one has the blank that the model puts before a text."""
        if not self.by_chunk:
            return [f" {text}"]
        return _CHUNK.findall(f" {text}".replace(MARK, " ")) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. The library adds the first blank itself; alone it stands only behind another chunk."""
        ids = self.library.encode([c[1:] for c in chunks], num_threads=1)
        if self.by_chunk and " " in chunks:
            before = self.library.encode("a")
            ids[chunks.index(" ")] = self.library.encode("a ")[len(before):]
        return ids


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One per worker."""
    return Model(path)


def pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, byte plane by byte plane: the upper planes of small numbers shrink to nothing."""
    return pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class Places(dict):
    """The number of each chunk, by first sight."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


def number_block(texts: list[str], path: str, parts: int) -> tuple[list[np.ndarray], np.ndarray, dict[int, list[bytes]]]:
    """Chunk numbers of each text, frequent ones small; the place of each number; the distinct chunks.

    Chunks are dealt into parts and sorted in each. Places count along the parts, in ascending order.
    """
    cut, seen = model(path).cut, Places()
    numbers = [np.fromiter(map(seen.__getitem__, cut(t)), dtype=np.uint32) for t in texts]
    counts = np.zeros(len(seen), dtype=np.int64)
    for x in numbers:
        np.add.at(counts, x, 1)
    rank = np.empty(len(seen), dtype=np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(seen), dtype=np.uint32)
    words = [c.encode() for c in seen]
    seen.clear()
    part = np.fromiter((zlib.crc32(w) % parts for w in words), dtype=np.int32, count=len(words))
    order = np.fromiter(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64, count=len(words))
    order = order[np.argsort(part[order], kind="stable")]
    places = np.empty(len(words), dtype=np.uint32)
    places[rank[order]] = np.arange(len(words), dtype=np.uint32)
    borders = np.flatnonzero(np.diff(part[order])) + 1
    lists = {int(part[at[0]]): [words[i] for i in at.tolist()] for at in np.split(order, borders) if len(at)}
    return [rank[x] for x in numbers], places, lists


def in_buckets(df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
    """``df`` stored in the shared folder, bucketed by a column, so that joins on it do not move these rows."""
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", scratch_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ends: bool = True, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """key, n_tokens, ids of every row: ids as little-endian unsigned 32-bit numbers, with begin and end id if ``ends``.

    The ids are those of the library for the whole text. Null and empty texts have the begin and end ids alone; rows
    with equal or null keys are rows of their own; texts of any length are taken whole; an empty table gives no rows;
    other columns are not read.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))

    def block_rows(at: int, keys: list[int | None], texts: list[str]) -> pa.RecordBatch:
        numbers, places, words = number_block(texts, path, parts)
        n = len(words)
        return pa.RecordBatch.from_arrays([
            pa.array([(task_part() << 32) + at] * (n + 1), pa.int64()), pa.array([*words, None], pa.int32()),
            pa.array([*(pack(END.join(w)) for w in words.values()), None], pa.binary()), pa.array([*[None] * n, keys], pa.list_(pa.int64())),
            *(pa.array([*[None] * n, pack_numbers(x)], pa.binary()) for x in (np.array([len(x) for x in numbers]), np.concatenate(numbers), places))], names=_BLOCKS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, keys, texts = 0, 0, [], []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and size + len(t or "") > block_bytes:
                    yield block_rows(at, keys, texts)
                    at, size, keys, texts = at + 1, 0, [], []
                keys.append(k)
                texts.append(t or "")
                size += len(t or "")
        if texts:
            yield block_rows(at, keys, texts)

    buckets = min(MOST_BUCKETS, 2 + 2 * (total // max(1, block_bytes)))     # twice as many as blocks: few meet
    blocks = in_buckets(rows.mapInArrow(number, BLOCKS), "block", buckets, "chunk_blocks")

    def answer(table: pa.Table) -> pa.Table:
        """All places of one part's chunks: each distinct chunk is segmented once."""
        seen, known = Places(), model(path)
        where = [np.fromiter(map(seen.__getitem__, unpack(c).split(END)), dtype=np.int64) for c in table.column("chunks").to_pylist()]
        ids = known.segment([w.decode() for w in seen])
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for row in ids for i in row), dtype=known.dtype, count=int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        return pa.table({
            "block": table.column("block"), "part": table.column("part"), "lengths": pa.array([pack_numbers(lengths[w]) for w in where], pa.binary()),
            "ids": pa.array([pack(flat[ranges(starts[w], lengths[w])].tobytes()) for w in where], pa.binary())})

    lists = blocks.filter(F.col("part").isNotNull()).select("block", "part", "chunks")
    answers = lists.groupBy("part").applyInArrow(answer, ANSWERS)
    # one line per block, of the size of the block's list
    answers = answers.repartition(buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "lengths", "ids"))).alias("answers"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(path)
        before, after = ([np.array(e, dtype="<u4").tobytes() for e in known.ends] if ends else (b"", b""))
        for batch in batches:
            for at in range(batch.num_rows):
                keys, sizes, numbers, places, found = (batch.column(c)[at].as_py() for c in ("keys", "sizes", "numbers", "places", "answers"))
                lengths = np.concatenate([np.zeros(0, dtype=np.int64), *(unpack_numbers(x["lengths"]) for x in found or [])]).astype(np.int64)
                flat = np.frombuffer(b"".join(unpack(x["ids"]) for x in found or []), dtype=known.dtype)
                starts, order = np.cumsum(lengths) - lengths, unpack_numbers(places)
                chunks, ids = order[unpack_numbers(numbers)], []
                for part in np.split(chunks, np.cumsum(unpack_numbers(sizes))[:-1]):
                    ids.append(before + flat[ranges(starts[part], lengths[part])].astype("<u4").tobytes() + after)
                for k in range(0, len(ids), OUT_ROWS):
                    part = ids[k:k + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[k:k + OUT_ROWS], pa.int64()), pa.array([len(i) // 4 for i in part], pa.int64()), pa.array(part, pa.binary())], names=["key", "n_tokens", "ids"])

    numbered = blocks.filter(F.col("part").isNull()).select("block", "keys", "sizes", "numbers", "places")
    out = numbered.join(answers, "block", "left").mapInArrow(place, "key bigint, n_tokens bigint, ids binary")
    return out.withColumnRenamed("key", key)


_BLOCKS = [c.split()[0] for c in BLOCKS.split(", ")]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length of each pair, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the library's ``decode`` makes of the ids (little-endian unsigned 32-bit). Null ids: null."""
    ready(rows.sparkSession)
    names = rows.columns
    at = names.index(ids)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{text}` string"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            known = [None if x is None else library.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, pa.string())], names=[*names, text])

    return rows.mapInArrow(step, schema)
