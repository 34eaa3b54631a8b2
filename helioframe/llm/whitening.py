"""Whitening of embeddings from exact integer cross-products, by bit-sliced scatter.

Entries c become x = floor(256 c). The fit list holds every distinct x vector once. Per dimension x is shifted by its
minimum, and bit k of the shifted values of many rows is packed into 64-bit words: a bit plane. For planes p of
dimension i and q of dimension j,

    sum over rows of u_i u_j = sum over k, l of 2**(k + l) * popcount(p_k AND q_l)

so cross-products are exact integers, which tasks count per block of rows and Spark adds up as decimals. The driver
gets one number per pair of dimensions, whatever the number of rows, centres them as integers (n M - U U'), and only
then divides and calls ``eigh``.

Vectors of different lengths are whitened apart, each length by its own fit list; lengths are meant to be few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.text import ready
from helioframe.session import persist_table

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 1 << 16
PLANE_BYTES = 32 << 20
LIMIT = 1 << 53          # beyond, a double no longer holds every integer
SAFE_BITS = 23           # two numbers of so many bits over BLOCK_ROWS rows stay below 2**63


@dataclass(frozen=True)
class Whitening:
    """The fit of one vector length."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    values: np.ndarray          # falling eigenvalues, the first few
    vectors: np.ndarray         # their unit eigenvectors, as columns
    explained: np.ndarray
    identity_error: float = float("nan")


def integer_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dims, x (little-endian 64-bit integers) of the rows whose vector has only finite entries.

    Null and empty vectors and vectors with a null or non-finite entry are left out. An entry beyond 2**53 / 256 raises.
    """
    picked = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)       # null entries become NaN
            starts = np.cumsum(lengths) - lengths
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = np.flatnonzero((lengths > 0) & (bad[starts + lengths] == bad[starts]))
            if not len(fine):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(SCALE * flat)
            out = []
            for at in fine.tolist():
                x = whole[starts[at]:starts[at] + lengths[at]]
                if np.abs(x).max() >= LIMIT:
                    raise OverflowError("an entry is too large to be scaled to an integer")
                out.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(fine)), pa.array(lengths[fine]), pa.array(out, pa.binary())], names=["vec_id", "dims", "x"])

    return picked.mapInArrow(step, "vec_id bigint, dims bigint, x binary")


def by_length(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of one length at a time: length, integers as a matrix, and the rows themselves."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            for k in range(0, len(at), rows):
                part = batch.take(pa.array(at[k:k + rows]))
                yield d, np.frombuffer(b"".join(part.column("x").to_pylist()), dtype="<i8").reshape(-1, d), part


def planes(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of all columns as 64-bit words, dimension by dimension, low bits first."""
    words = -(-len(shifted) // 64)
    out = np.zeros((int(bits.sum()), words * 8), dtype=np.uint8)
    at = 0
    for column, count in zip(shifted.T, bits.tolist(), strict=True):
        for k in range(count):
            packed = np.packbits((column >> k & 1).astype(bool), bitorder="little")
            out[at, :len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def cross_products(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of two columns; bits: of each column's largest value."""
    own = planes(shifted, bits)
    counts = np.zeros((len(own), len(own)), dtype=np.int64)
    for p in range(len(own)):
        counts[p, p:] = np.bitwise_count(own[p] & own[p:]).sum(axis=1, dtype=np.int64)
        counts[p:, p] = counts[p, p:]
    total = np.zeros((len(bits), len(bits)), dtype=np.int64 if bits.max(initial=0) <= SAFE_BITS else object)
    used = np.flatnonzero(bits)
    if len(used):
        power = np.concatenate([np.arange(b) for b in bits])
        kind = total.dtype
        weight = np.array([1 << int(p) for p in power], dtype=kind)
        first = (np.cumsum(bits) - bits)[used]
        weighted = counts.astype(kind) * weight[:, None] * weight[None, :]
        total[np.ix_(used, used)] = np.add.reduceat(np.add.reduceat(weighted, first, axis=0), first, axis=1)
    return total


def _fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x vector once, stored. A vector that many rows share is reduced before the shuffle."""
    return persist_table(rows.groupBy("dims", "x").agg(F.count(F.lit(1)).alias("copies")).select("dims", "x"), "whitening-fit")


def _ranges(fit: DataFrame) -> dict[int, tuple[int, list[int], list[int], list[int]]]:
    """Per length: number of vectors, and sum, minimum and maximum of each dimension."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, _ in by_length(batches):
            high, low = x >> 32, x & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, len(x))), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0)),
                 pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["dims", "i", "n", "hi", "lo", "least", "most"])

    parts = fit.mapInArrow(step, "dims bigint, i bigint, n bigint, hi bigint, lo bigint, least bigint, most bigint")
    rows = parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), _exact("hi", "lo").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    out: dict[int, tuple[int, list[int], list[int], list[int]]] = {}
    for r in rows.orderBy("dims", "i").collect():
        n, sums, least, most = out.setdefault(r.dims, (r.n, [], [], []))
        sums.append(int(r.s))
        least.append(r.least)
        most.append(r.most)
    return out


def _exact(high: str, low: str):
    """Sum of high * 2**32 + low."""
    return F.sum(F.col(high).cast("decimal(38,0)")) * F.lit(1 << 32).cast("decimal(11,0)") + F.sum(F.col(low).cast("decimal(38,0)"))


def _scatter(fit: DataFrame, ranges: dict[int, tuple[int, list[int], list[int], list[int]]]) -> dict[int, list[list[int]]]:
    """Per length: exact sums of products of shifted dimensions."""
    low = {d: np.array(r[2], dtype=np.int64) for d, r in ranges.items()}
    bits = {d: np.array([(b - a).bit_length() for a, b in zip(r[2], r[3], strict=True)]) for d, r in ranges.items()}
    for b in bits.values():
        if b.max() > 38:
            raise OverflowError("the entries of a dimension lie too far apart for exact cross-products")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x, _ in by_length(batches):
            rows = max(64, PLANE_BYTES // (8 * max(1, int(bits[d].sum()))) * 64)
            for at in range(0, len(x), rows):
                found = cross_products(x[at:at + rows] - low[d], bits[d])
                high, rest = found >> 32, found & 0xFFFFFFFF
                kept = total.setdefault(d, np.zeros((2, d, d), dtype=np.int64))
                kept[0] += high.astype(np.int64)
                kept[1] += rest.astype(np.int64)
        for d, (high, rest) in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(high[i, j]), pa.array(rest[i, j])], names=["dims", "i", "j", "hi", "lo"])

    parts = fit.mapInArrow(step, "dims bigint, i bigint, j bigint, hi bigint, lo bigint")
    out = {d: [[0] * d for _ in range(d)] for d in ranges}
    for r in parts.groupBy("dims", "i", "j").agg(_exact("hi", "lo").alias("m")).collect():
        out[r.dims][r.i][r.j] = out[r.dims][r.j][r.i] = int(r.m)
    return out


def _fitted(ranges: tuple[int, list[int], list[int], list[int]], products: list[list[int]], components: int) -> Whitening:
    n, sums, low, high = ranges
    moved = [s - n * a for s, a in zip(sums, low, strict=True)]
    centred = [[n * m - u * v for m, v in zip(row, moved, strict=True)] for row, u in zip(products, moved, strict=True)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    trace = sum(row[i] for i, row in enumerate(centred)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    used = values > len(sums) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    values, vectors = values[used], vectors[:, used]
    return Whitening(n, tuple(sums), tuple(low), tuple(high), values, vectors, values / trace if trace else values)


def project(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, as exact integers, and the whitened values."""
    sums = np.array(fit.sums, dtype=object)
    largest = max(max(abs(fit.n * a - s), abs(fit.n * b - s)) for a, b, s in zip(fit.low, fit.high, fit.sums, strict=True))
    kind = np.int64 if largest < 1 << 62 else object
    moved = x.astype(kind) * fit.n - sums.astype(kind)
    return moved, (moved.astype(np.float64) / fit.n) @ fit.vectors / np.sqrt(fit.values)


def deviations(moved: np.ndarray, fit: Whitening) -> np.ndarray:
    """Sum of squares of each row, exact; raises where it is beyond 63 bits."""
    most = sum(max(abs(fit.n * a - s), abs(fit.n * b - s)) ** 2 for a, b, s in zip(fit.low, fit.high, fit.sums, strict=True))
    if most < 1 << 63:
        return (moved * moved).sum(axis=1)
    squares = (moved.astype(object) ** 2).sum(axis=1)
    if squares.max() >= 1 << 63:
        raise OverflowError("a deviation is beyond 63 bits")
    return squares.astype(np.int64)


def _identity_errors(fit: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, per length."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x, _ in by_length(batches):
            w = project(x, fits[d])[1]
            w = np.hstack([w, np.ones((len(w), 1))])        # the last row and column are sums
            total[d] = total.get(d, 0) + w.T @ w
        for d, t in total.items():
            i, j = np.indices(t.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(t[i, j])], names=["dims", "i", "j", "v"])

    parts = fit.mapInArrow(step, "dims bigint, i bigint, j bigint, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v"))
    found = {d: np.zeros((len(f.values) + 1,) * 2) for d, f in fits.items()}
    for r in parts.collect():
        found[r.dims][r.i, r.j] = r.v
    out = {}
    for d, t in found.items():
        n, mean = fits[d].n, t[-1, :-1] / fits[d].n
        out[d] = float(np.abs(t[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Fits by vector length, from :func:`integer_rows`. Components without variance are left out."""
    fit = _fit_list(rows)
    ranges = _ranges(fit)
    products = _scatter(fit, ranges)
    fits = {d: _fitted(ranges[d], products[d], components) for d in ranges}
    errors = _identity_errors(fit, fits)
    return {d: Whitening(**(vars(f) | {"identity_error": errors[d]})) for d, f in fits.items()}


def whiten(rows: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, part in by_length(batches):
            fit = fits.get(d)
            if fit is None or not len(fit.values):
                continue
            moved, white = project(x, fit)
            m, k = white.shape
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                pa.array(deviations(moved, fit)[each]), pa.array(white.reshape(-1)), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, fit.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(step, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, by the fit of all distinct vectors.

    Null and empty vectors and those with null or non-finite entries are left out. Rows with equal or null keys are
    rows of their own; repeated vectors count once in the fit. Components without variance are left out, so a table
    of one distinct vector gives no rows, as does an empty one. Other columns are not read.
    """
    ready(vectors.sparkSession)
    rows = integer_rows(vectors, key, vector)
    return whiten(rows, fit_whitening(rows, components))
