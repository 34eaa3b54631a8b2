"""Words, shingles and line hashes of many texts at once, on the bytes of an Arrow column.

A word is a run of bytes outside 0x20 and 0x09-0x0D. In UTF-8 these bytes never occur inside another
character, so byte runs and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

from helioframe.session import prepare

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
MULTIPLIERS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(16)], dtype=U64)
LONG = 32                          # bytes from which a range is hashed on its own
SLICE_BYTES = 1 << 19              # arrays of this size stay in the processor's cache

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RAW = np.arange(256, dtype=U64) + U64(1)
_LOWER = _RAW.copy()
_LOWER[ord("A"):ord("Z") + 1] = _RAW[ord("a"):ord("z") + 1]
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]

#: rows and bytes of one Arrow batch, so that long texts do not add up in a Python worker
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package's settings and small Arrow batches."""
    prepare(spark)
    for key, value in ARROW.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


class Texts:
    """A run of texts: bytes, text borders and word borders."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, first: int):
        self.data, self.borders, self.first = data, borders, first
        self.n = len(borders) - 1
        solid = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[borders] = True
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.solid = solid
        self.starts = np.flatnonzero(solid & (~before | cut[:-1]))
        self.ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        # words of text k: word_borders[k] .. word_borders[k + 1]
        self.word_borders = np.searchsorted(self.starts, borders)
        self.n_words = np.diff(self.word_borders)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many positions of a byte mask lie in each text."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.borders[1:]] - total[self.borders[:-1]]

    def per_text_words(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.word_borders[1:]] - total[self.word_borders[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges.

        Sums over powers modulo 2**64 are fast for many short ranges, but regular long ones can agree in them; ranges
        of ``LONG`` bytes and more get a hash of their own.
        """
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((_LOWER if lower else _RAW)[self.data] * up[:len(self.data)], out=sums[1:])
        found = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(INVERSE))
        far = np.flatnonzero(ends - starts >= LONG)
        if len(far):
            data = ((_LOWER if lower else _RAW)[self.data] - U64(1)).astype(np.uint8).data
            found[far] = [xxhash.xxh3_64_intdigest(data[a:b], BASE) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
        return found

    def words(self, lower: bool = False) -> np.ndarray:
        return self.hashes(self.starts, self.ends, lower)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, the first word of each, and its text."""
        text = np.repeat(np.arange(self.n), self.n_words)
        count = len(words) - size + 1
        if count <= 0:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(U64), none, none
        inside = np.flatnonzero(text[:count] == text[size - 1:])
        total = np.zeros(count, dtype=U64)
        for k in range(size):
            total += words[k:k + count] * MULTIPLIERS[k]
        return mix(total[inside]), inside, text[inside]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a binary column into runs of at most ``size`` bytes or one text. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Texts(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at], at)
        at = end
