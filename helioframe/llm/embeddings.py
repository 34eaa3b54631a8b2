"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors are scaled to unit length in double precision and quantised to int8 with a scale of their own. For
v = s q + e the error length |e| is computed, so for two vectors

    |v.w - s_v s_w q_v.q_w| <= |e_v| |w| + |s_v q_v| |e_w| <= |e_v| + (1 + |e_v|) |e_w|

A tile multiplies the int8 vectors of two blocks, ``STRETCH`` dimensions at a time (sums below 2**24, so float32 matrix
products are exact) and adds the products in double precision; only
pairs whose product plus bound reaches the threshold are computed again in double precision.

Which blocks meet: vectors are cut into cells by ``tables`` independent sets of ``bits`` random hyperplanes, and
blocks of at most ``BLOCK`` vectors of the same cell meet. ``bits`` follows the number of vectors, so cells stay
near ``BLOCK`` vectors and the work near n log n; ``tables`` follows ``bits``, so that a pair at the very
threshold shares a cell with probability ``RECALL`` and a closer one with more. A cell of any size is cut into
blocks, of which all pairs meet; none is capped. With a recall of 1 there is one cell and every pair of blocks meets.
 A pair that shares several cells belongs to the first one.
Equal vectors are one row with a count throughout, so a group of copies costs one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.components import components
from helioframe.llm.text import ready
from helioframe.session import persist_table

THRESHOLD = 0.9
RECALL = 0.9995
BLOCK = 1024
STRETCH = 1024         # 1024 * 127**2 < 2**24
SEED = 7


def plan_cells(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes per table, and tables; none with a recall of 1, whatever the number of vectors."""
    if recall >= 1:
        return 0, 1
    bits = max(0, math.ceil(math.log2(max(1, vectors) / BLOCK)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def hyperplanes(dims: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, tables * bits))


def unit_rows(raw: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    top = np.abs(rows).max(axis=1, keepdims=True)       # first, so that squares neither overflow nor vanish
    rows = rows / top
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and lengths of the errors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, error + 1e-12


def possible_pairs(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that may reach the threshold."""
    (q, s, e), (r, t, f) = left, right
    product = np.zeros((len(q), len(r)))
    for at in range(0, q.shape[1], STRETCH):
        part = slice(at, at + STRETCH)
        product += q[:, part].astype(np.float32) @ r[:, part].astype(np.float32).T
    reach = product * (s[:, None] * t[None, :]) + (e[:, None] + (1 + e[:, None]) * f[None, :])
    return np.nonzero(reach >= threshold - 1e-12)


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of unit vectors whose product in double precision reaches the threshold."""
    i, j = possible_pairs(quantise(left), quantise(right), threshold)
    keep = [np.zeros(0, dtype=bool)]
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        keep.append(np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= threshold)
    chosen = np.concatenate(keep)
    return i[chosen], j[chosen]


def distinct_vectors(vectors: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the bytes of their vector (null if it links with nothing), and the distinct vectors with a number."""
    values = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fine = values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.withColumn("_values", F.when(fine, values))
    known = rows.filter(F.col("_values").isNotNull()).groupBy("_values").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("first_id"))
    # the number is stored with the vector, so later reads agree
    return rows, known.withColumn("node", F.monotonically_increasing_id())


def vector_links(known: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (node, copies, _values): links of each to others, weighted by copies; edges that span them."""
    sizes = [(r[0], r[1]) for r in known.groupBy(F.size("_values")).count().collect()]     # one line per dimension
    counted = sum(n for _, n in sizes)
    bits, tables = plan_cells(counted, threshold, recall)
    planes = {d: hyperplanes(d, bits, tables) for d, _ in sizes}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                rows = batch.take(pa.array(at))
                flat = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                side = (flat @ planes[int(d)] > 0).reshape(len(at), tables, bits) if bits else np.zeros((len(at), 1, 0))
                keys = (side.astype(np.int64) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) if bits else np.zeros((len(at), 1), dtype=np.int64)
                raw = [r.tobytes() for r in np.ascontiguousarray(flat, dtype=np.float64)]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array(np.full(len(at), d, dtype=np.int64)), pa.array(raw, pa.binary()),
                    pa.array([k.tobytes() for k in np.ascontiguousarray(keys)], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                    names=["node", "copies", "dims", "raw", "keys", "cells"])

    placed = known.select("node", "copies", "_values").mapInArrow(cells, "node bigint, copies bigint, dims bigint, raw binary, keys binary, cells array<bigint>")
    placed = persist_table(placed, "cells")
    rows = placed.select("node", "dims", F.posexplode("cells").alias("table", "cell"))
    blocks = rows.groupBy("dims", "table", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = persist_table(blocks, "cell-blocks")
    tiles = placed.select("node", "copies", "dims", "raw", "keys", F.posexplode("cells").alias("table", "cell")).join(blocks, ["dims", "table", "cell"])
    tiles = tiles.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    tiles = tiles.select("node", "copies", "dims", "table", "cell", "mine", other.alias("other"), "raw", "keys")
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    tiles = tiles.select("dims", "table", "cell", low.alias("low"), high.alias("high"), "mine", "node", "copies", "raw", "keys")

    def multiply(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        _, table, _, a, b = key
        first, second = pdf[pdf["mine"] == a], pdf[pdf["mine"] == b]
        left = unit_rows(first["raw"].tolist()) if len(first) else np.zeros((0, 1))
        right = left if a == b else unit_rows(second["raw"].tolist()) if len(second) else np.zeros((0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        i, j = tile_links(left, right, threshold)
        if a == b:
            i, j = i[i < j], j[i < j]
        if table:      # a pair that shares an earlier cell was met there
            x, y = (np.frombuffer(b"".join(side["keys"]), dtype=np.int64).reshape(len(side), -1)[:, :table] for side in (first, second))
            new = np.array([not (x[p] == y[q]).any() for p, q in zip(i, j, strict=True)], dtype=bool)
            i, j = i[new], j[new]
        n, m = first["node"].to_numpy(), second["node"].to_numpy()
        ids, where = np.unique(np.concatenate([n[i], m[j]]), return_inverse=True)
        u, v = where[:len(i)], where[len(i):]
        links = np.bincount(u, weights=second["copies"].to_numpy()[j], minlength=len(ids)) + np.bincount(v, weights=first["copies"].to_numpy()[i], minlength=len(ids))
        return pd.DataFrame({"node": ids, "links": links.astype("int64"), "root": ids[spanning(len(ids), u, v)]})

    found = tiles.groupBy("dims", "table", "cell", "low", "high").applyInPandas(multiply, "node bigint, links bigint, root bigint")
    found = persist_table(found, "tile-links")
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions by the links u, v."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    A link at the very threshold is found with probability ``recall``; with 1 all tiles are multiplied and none is missed.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of
    different lengths do not link. Rows with equal ids are rows of their own and count as such; a null id is passed
    over in the minimum, and ``kept`` is false for it. Other columns are not read; an empty table gives no rows.
    """
    ready(vectors.sparkSession)
    picked = vectors.select(F.col(f"`{key}`").cast("bigint").alias("_id"), F.col(f"`{vector}`").alias("_vector"))
    rows, known = distinct_vectors(picked, "_vector")
    known = persist_table(known, "distinct-vectors")
    links, edges = vector_links(known, threshold, recall)
    labels = components(edges)
    own = known.join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = own.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = own.join(smallest, "label").select(
        F.col("_values").alias("_known"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # equal vectors hash alike; the plain comparison decides
    joined = rows.join(named.withColumn("_hk", F.xxhash64("_known")), (F.xxhash64("_values") == F.col("_hk")) & (F.col("_values") == F.col("_known")), "left")
    component = F.when(F.col("_values").isNotNull(), F.col("component_id")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
