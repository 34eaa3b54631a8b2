"""Order-preserving packing of documents into sequences of bounded length.

The documents of a task follow each other as one stream of ids. Cuts may lie after a document (free),
after a sentence (``SENTENCE``) or, inside a sentence longer than ``LONG``, after every ``GRID`` ids
(``FORCED``). The cuts that minimise padding plus these penalties come from

    f[j] = penalty[j] + min over i with c[j] - c[i] <= L of f[i] + L - (c[j] - c[i])

With g = f + c the inner minimum is one of g over a sliding window, which a monotone queue gives in linear time.
The queue is worked block by block of L positions: a window is the end of one block and the beginning of the next. The
first part is a running minimum from the block's end. In the second only values that come from the block before can
win, as a cut adds L and a penalty to what it starts from; they are known for the whole block at once.
The stream is handled ``CHUNK`` ids at a time; sequences that end near the end of a chunk are planned again
with the next one, so memory is bounded by a chunk and one document. Sequences whose length is a power of
two need no padding: what is left at the end of a task is cut into such lengths if that costs less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.storage import task_part
from helioframe.llm.text import ready
from helioframe.llm.tokens import END_ID, encoder

LENGTH = 2048
SENTENCE, FORCED = 4.0, 12.0
LONG, GRID = 48, 16
CHUNK = 1 << 16
SETTLED = 3            # sequences at the end of a chunk that are planned again

_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def candidates(ids: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of one document and their penalties; the last is its end."""
    ends = np.flatnonzero(sentence_end[ids[:-1]]) + 1 if len(ids) > 1 else np.zeros(0, dtype=np.int64)
    if len(ids) > 1 and len(ends) and ends[-1] == len(ids) - 1:
        ends = ends[:-1]          # the id that ends the document stays with its last sentence
    edges = np.concatenate([[0], ends, [len(ids)]])
    gaps = edges[1:] - edges[:-1]
    steps = np.where(gaps > LONG, (gaps - 1) // GRID, 0)
    nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    forced = np.repeat(edges[:-1], steps) + GRID * nth
    cuts = np.concatenate([ends, forced, [len(ids)]]).astype(np.int64)
    cost = np.concatenate([np.full(len(ends), SENTENCE), np.full(len(forced), FORCED), [0.0]])
    order = np.argsort(cuts, kind="stable")
    return cuts[order], cost[order]


def best_cuts(cuts: np.ndarray, cost: np.ndarray, length: int = LENGTH, last: bool = True) -> list[int]:
    """Positions at which the cheapest plan ends its sequences; ``cuts`` ascend, from 0 exclusive.

    What follows the last position returned, at most ``length`` ids, is left open: with ``last`` at the price of
    ``tail``, otherwise for nothing, as more documents follow.
    """
    at, price = np.concatenate([[0], cuts]), np.concatenate([[0.0], cost]) + length
    first = np.searchsorted(at, at - length)
    blocks = np.searchsorted(at, np.arange(0, at[-1] + length, length), side="right").tolist()
    g = np.zeros(len(at))
    before = 0
    for low, high in zip(blocks, blocks[1:], strict=False):
        least = np.append(np.minimum.accumulate(g[before:low][::-1])[::-1], np.inf)
        here = price[low:high] + least[first[low:high] - before]
        g[low:high] = here
        np.minimum(here[1:], price[low + 1:high] + np.minimum.accumulate(here)[:-1], out=g[low + 1:high])
        before = low
    opened = int(first[-1])
    total = g[opened:] - at[opened:]
    if last:
        total += [price_of_tail(rest, length) for rest in (at[-1] - at[opened:]).tolist()]
    j = len(at) - 1 - int(np.argmin(total[::-1]))
    ends = []
    while j:
        ends.append(int(at[j]))
        j -= 1 + int(np.argmin(g[first[j]:j][::-1]))
    return ends[::-1]


def powers(rest: int, limit: int = LENGTH) -> list[int]:
    """The last ids of a task as lengths that need no padding, or as one sequence if its padding costs less."""
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return bits if (len(bits) - 1) * FORCED < limit - rest else [rest]


def price_of_tail(rest: int, limit: int = LENGTH) -> float:
    return min(limit - rest, (rest.bit_count() - 1) * FORCED) if rest else 0.0


class Packer:
    """Documents in, pieces out."""

    def __init__(self, first_sequence: int, length: int = LENGTH, chunk: int = CHUNK):
        self.length, self.chunk, self.sequence = length, chunk, first_sequence
        self.docs: list[tuple[int, np.ndarray, int]] = []      # key, rest of the ids, ids before it
        self.cuts: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.waiting = 0

    def add(self, key: int, ids: np.ndarray, sentence_end: np.ndarray) -> Iterator[tuple]:
        cuts, cost = candidates(ids, sentence_end)
        self.docs.append((key, ids, 0))
        self.cuts.append(cuts + self.waiting)
        self.cost.append(cost)
        self.waiting += len(ids)
        if self.waiting >= self.chunk:
            yield from self.plan(last=False)

    def plan(self, last: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        cuts, cost = np.concatenate(self.cuts), np.concatenate(self.cost)
        ends = best_cuts(cuts, cost, self.length, last)
        if last:
            start = ends[-1] if ends else 0
            if start < self.waiting:
                ends += (start + np.cumsum(powers(self.waiting - start, self.length))).tolist()
        else:
            ends = ends[:-SETTLED]
        done = ends[-1] if ends else 0
        yield from self.emit(ends)
        rest = cuts > done
        self.cuts, self.cost, self.waiting = [cuts[rest] - done], [cost[rest]], self.waiting - done

    def emit(self, ends: list[int]) -> Iterator[tuple]:
        docs, k, used, at = self.docs, 0, 0, 0
        for end in ends:
            offset = 0
            while at < end:
                key, ids, before = docs[k]
                take = min(len(ids) - used, end - at)
                yield key, before + used, take, ids[used:used + take].astype("<u4").tobytes(), before + len(ids), self.sequence, offset
                used, at, offset = used + take, at + take, offset + take
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        self.docs = docs[k:]
        if used:
            key, ids, before = self.docs[0]
            self.docs[0] = key, ids[used:], before + used


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit numbers.

    Documents keep their order within an input split; a split is one task and shares no sequence with another,
    so nothing is shuffled. ``sequence_id`` is the task's number times 2**33 plus a count. Null or empty text is
    the end id alone; rows with equal or null keys are packed one by one; other columns are not read; an empty
    table gives no pieces.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("_text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end, packer = np.array([end_id], dtype=code.dtype).tobytes(), Packer(task_part() << 33, length)
        for batch in batches:
            held: list[tuple] = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(code.encode(content.as_py() or b"") + end, dtype=code.dtype)
                held.extend(packer.add(doc_id, ids, code.sentence_end))
                if len(held) >= 2000:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)
        held = list(packer.plan(last=True))
        if held:
            yield _batch(held)

    return rows.mapInArrow(step, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
