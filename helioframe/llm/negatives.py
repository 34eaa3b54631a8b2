"""Hard negatives by segment summaries.

A vector is cut into segments. Of each segment two numbers are stored: its mean and its deviation, both times the
root of its length. For two vectors the product over a segment is the product of the means, plus or minus at most
the product of the deviations (Cauchy-Schwarz), so summaries bound the score of a pair. Few long segments are looked
at first, more and shorter ones for the rows that are left, and only pairs whose bounds still allow a place among the
first ones are multiplied out, in exact integers.

Anchors are compared with all rows in tiles: a block of rows meets a block of anchors. A tile returns its first few
rows per anchor, a window over these picks the first few of all. Blocks have a bounded size and are dealt by a hash of
the row number, so neither a frequent label nor a vector with many copies makes a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.text import ready
from helioframe.session import persist_table

SCALE = 256
POSITIVES = NEGATIVES = 5
LENGTHS = (16, 4, 2)         # components of a segment, coarse to fine
BLOCK_ROWS = 16_384
BLOCK_ANCHORS = 4_096
LEAST_ROWS, FEW_BLOCKS = 512, 48       # tables of few blocks are cut finer, to occupy the executors
SLICE_PAIRS = 1 << 19        # pairs bounded at a time
EXACT_PAIRS = 1 << 15        # pairs multiplied out at a time
LIMIT = 1 << 53
ANY = 1 << 62              # beyond all scores
ROUNDING = 1e-5              # bounds are in single precision
DENSE = 16                   # a slice with more than one pair in so many left is multiplied out as a matrix

ROWS = "row bigint, vec_id bigint, label bigint, dims bigint, x binary, summary binary"


def segment_borders(dims: int, length: int) -> np.ndarray:
    return np.append(np.arange(0, dims, length), dims)


def summaries(x: np.ndarray) -> np.ndarray:
    """Mean and deviation of the segments of all levels, times the root of their length."""
    out = []
    for length in LENGTHS:
        borders = segment_borders(x.shape[1], length)
        size = np.diff(borders)
        mean = np.add.reduceat(x, borders[:-1], axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        out += [mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, borders[:-1], axis=1))]
    return np.hstack(out).astype("<f4")


def stored_rows(vectors: DataFrame, key: Column, label: Column, vector: str) -> DataFrame:
    """The rows that take part, numbered, with their integers and summaries; stored.

    Rows with a null label, a null or empty vector, or a null or non-finite component are left out.
    """
    picked = vectors.select(key.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    picked = picked.filter(F.col("label").isNotNull() & (F.size("v") > 0)).withColumn("row", F.monotonically_increasing_id())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                fine = np.flatnonzero(np.isfinite(flat).all(axis=1))
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * flat[fine])
                if np.abs(x).max(initial=0) >= LIMIT:
                    raise OverflowError("a component is too large to be scaled to an integer")
                part = part.take(pa.array(fine))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("vec_id"), part.column("label"), pa.array(np.full(len(fine), d)),
                     pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()), pa.array([s.tobytes() for s in summaries(x)], pa.binary())],
                    names=[c.split()[0] for c in ROWS.split(", ")])

    return persist_table(picked.mapInArrow(step, ROWS), "segment-summaries")


class Side:
    """Rows or anchors of one length in one tile, in the order of their ids."""

    def __init__(self, table: pa.Table, dims: int):
        ids = table.column("vec_id")
        order = np.lexsort((table.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
        self.table = table.take(pa.array(order))
        self.row = self.table.column("row").to_numpy()
        self.label = self.table.column("label").to_numpy()
        n = len(order)
        self.x = np.frombuffer(b"".join(self.table.column("x").to_pylist()), dtype="<f8").reshape(n, dims)
        self.most = float(np.abs(self.x).max(initial=0))
        self.levels = []
        parts = np.frombuffer(b"".join(self.table.column("summary").to_pylist()), dtype="<f4").reshape(n, -1)
        at = 0
        for length in LENGTHS:
            k = len(segment_borders(dims, length)) - 1
            self.levels.append((parts[:, at:at + k], parts[:, at + k:at + 2 * k]))
            at += 2 * k


def bounds(anchors: Side, rows: Side, level: int, part: slice, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of some anchors with some rows."""
    (mean, spread), (other, wide) = anchors.levels[level], rows.levels[level]
    centre = mean[part] @ other[columns].T
    reach = spread[part] @ wide[columns].T
    reach += np.float32(ROUNDING + 2.5e-7 * mean.shape[1]) * (reach + np.abs(mean[part]) @ np.abs(other[columns]).T) + np.float32(1e-6)
    return centre - reach, centre + reach


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, exact: type) -> np.ndarray:
    out = np.zeros(len(i), dtype=exact)
    for at in range(0, len(i), EXACT_PAIRS):
        part = slice(at, at + EXACT_PAIRS)
        out[part] = np.einsum("ij,ij->i", a[i[part]].astype(exact, copy=False), b[j[part]].astype(exact, copy=False))
    return out


def first_rows(anchors: Side, rows: Side, same_label: bool, low: np.ndarray, high: np.ndarray, k: int, stats: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window w: anchors i, rows j and scores of the first k rows with ``low <= score <= high``.

    ``low`` and ``high`` hold a line per anchor and a column per window. Only rows of the same label other than the
    anchor itself take part, or else only rows of other labels. ``stats`` counts pairs seen and multiplied out.
    """
    if max(1.0, anchors.most) * max(1.0, rows.most) * anchors.x.shape[1] * 100 >= 1 << 63:
        raise OverflowError("scores are beyond 63 bits")
    exact = np.float64 if max(1.0, anchors.most) * max(1.0, rows.most) * anchors.x.shape[1] * 100 < LIMIT else np.int64
    every = np.arange(len(rows.row))
    step = max(1, SLICE_PAIRS // max(1, len(every)))
    for at in range(0, len(anchors.row), step):
        part = slice(at, at + step)
        equal = anchors.label[part, None] == rows.label[None, :]
        allowed = equal & (anchors.row[part, None] != rows.row[None, :]) if same_label else ~equal
        columns, open_pairs = every, [allowed] * low.shape[1]
        for level in range(len(LENGTHS)):
            least, most = bounds(anchors, rows, level, part, columns)
            for w, mask in enumerate(open_pairs):
                lo, hi = (limit[part, w, None].astype(np.float32) for limit in (low, high))
                slack = np.float32(1e-6) * np.abs(lo), np.float32(1e-6) * np.abs(hi)
                mask = mask & (most >= lo - slack[0]) & (least <= hi + slack[1])
                sure = mask & (least >= lo + slack[0]) & (most <= hi - slack[1])
                enough = np.flatnonzero(np.count_nonzero(sure, axis=1) >= k)
                if len(enough):
                    mask[enough] &= most[enough] >= kth_largest(np.where(sure[enough], least[enough], -np.inf), k)[:, None]
                open_pairs[w] = mask
            left = np.flatnonzero(np.logical_or.reduce(open_pairs).any(axis=0))
            columns, open_pairs = columns[left], [m[:, left] for m in open_pairs]
        i, j = np.nonzero(np.logical_or.reduce(open_pairs))
        score = np.zeros(open_pairs[0].shape, dtype=exact)
        if exact is np.float64 and len(i) * DENSE > score.size:
            score = anchors.x[part] @ rows.x[columns].T
        else:
            score[i, j] = exact_scores(anchors.x[part], rows.x[columns], i, j, exact)
        if stats is not None:
            stats["pairs"], stats["exact"] = stats.get("pairs", 0) + int(allowed.sum()), stats.get("exact", 0) + len(i)
        for w, mask in enumerate(open_pairs):
            i, j = np.nonzero(mask & (score >= low[part, w, None]) & (score <= high[part, w, None]))
            value = score[i, j]
            order = np.lexsort((j, -value, i))      # rows lie in the order of their ids
            i, j, value = i[order], j[order], value[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            yield w, i[place < k] + at, columns[j[place < k]], value[place < k].astype(np.int64)


def tiles(rows: DataFrame, anchors: DataFrame, counted: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides, each row once per tile it takes part in."""
    n, m = counted
    row_blocks = max(-(-n // BLOCK_ROWS), min(FEW_BLOCKS, -(-n // LEAST_ROWS)), 1)
    anchor_blocks = max(1, -(-m // BLOCK_ANCHORS))
    own, other = F.pmod(F.xxhash64("row"), F.lit(row_blocks)), F.pmod(F.xxhash64("row"), F.lit(anchor_blocks))
    left = rows.withColumns({"rows_of": own, "anchors_of": F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))})
    right = anchors.withColumns({"anchors_of": other, "rows_of": F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))})
    return tuple(t.withColumns({c: F.col(c).cast("int") for c in ("rows_of", "anchors_of")}) for t in (left, right))


def _each_length(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[Side, Side, pa.Table]]:
    ours, theirs = rows.column("dims").to_numpy(), anchors.column("dims").to_numpy()
    for d in np.intersect1d(ours, theirs).tolist():
        side = Side(anchors.take(pa.array(np.flatnonzero(theirs == d))), d)
        yield Side(rows.take(pa.array(np.flatnonzero(ours == d))), d), side, side.table


FOUND = "anchor bigint, anchor_id bigint, place int, found_id bigint, found bigint, score bigint"


def _found(anchors: Side, rows: Side, windows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    parts = [pa.table({
        "anchor": pa.array(anchors.row[i]), "anchor_id": anchors.table.column("vec_id").take(pa.array(i)), "place": pa.array(np.full(len(i), w + 1, dtype=np.int32)),
        "found_id": rows.table.column("vec_id").take(pa.array(j)), "found": pa.array(rows.row[j]), "score": pa.array(score)}) for w, i, j, score in windows]
    return pa.concat_tables(parts) if parts else _NOTHING


_NOTHING = pa.table({"anchor": pa.array([], pa.int64()), "anchor_id": pa.array([], pa.int64()), "place": pa.array([], pa.int32()),
                     "found_id": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def _meet(rows: DataFrame, anchors: DataFrame, counted: tuple[int, int], tile) -> DataFrame:
    left, right = (t.withColumn("is_anchor", F.lit(k)) for k, t in enumerate(tiles(rows, anchors, counted)))

    def step(table: pa.Table) -> pa.Table:
        kind = table.column("is_anchor").to_numpy()
        r, a = (table.take(pa.array(np.flatnonzero(kind == k))) for k in (0, 1))
        return pa.concat_tables([_NOTHING, *(tile(a_side, r_side, a_table) for r_side, a_side, a_table in _each_length(r, a))])

    return left.unionByName(right, allowMissingColumns=True).groupBy("rows_of", "anchors_of").applyInArrow(step, FOUND)


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = 80, most_percent: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchor``, an expression over ``vec_id`` and ``label``, is true. An anchor's
    positives are the first rows of its label other than itself, by falling score, then id. For each of them the
    negatives are the first rows of other labels whose score is ``least_percent`` to ``most_percent`` of the
    positive's. Scores are integer products of the components times 256, rounded down.

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part; vectors of
    different lengths are not compared. Rows with equal ids are rows of their own; a null id comes last among equals.
    Scores beyond 63 bits raise. Other columns are not read; an empty table gives no rows.
    """
    ready(vectors.sparkSession)
    rows = stored_rows(vectors, F.col(f"`{key}`"), F.col("`label`") if label is None else label, vector)
    anchors = rows.filter(anchor)
    counted = rows.agg(F.count(F.lit(1)), F.count_if(anchor)).first()

    def near(anchor_side: Side, row_side: Side, table: pa.Table) -> pa.Table:
        free = np.full((len(anchor_side.row), 1), ANY)
        return _found(anchor_side, row_side, first_rows(anchor_side, row_side, True, -free, free, positives))

    best = _first(_meet(rows, anchors, counted, near), positives, "anchor")
    best = persist_table(best.select("anchor", "anchor_id", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most as many entries per anchor as it has positives
    scores = best.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("by_place"))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda p: F.col("by_place")[p])
    armed = anchors.join(scores.select(F.col("anchor").alias("row"), wanted.alias("wanted")), "row")

    def hard(anchor_side: Side, row_side: Side, table: pa.Table) -> pa.Table:
        wanted = table.column("wanted").to_pylist()
        none = np.array([[s is None for s in row] for row in wanted], dtype=bool).reshape(-1, positives)
        target = np.array([[s or 0 for s in row] for row in wanted], dtype=np.int64).reshape(-1, positives)
        # least_percent * target <= 100 * score <= most_percent * target
        low, high = -(-least_percent * target // 100), most_percent * target // 100
        return _found(anchor_side, row_side, first_rows(anchor_side, row_side, False, np.where(none, ANY, low), np.where(none, -ANY, high), negatives))

    found = _first(_meet(rows, armed, counted, hard), negatives, "anchor", "place")
    found = found.select("anchor", "place", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
