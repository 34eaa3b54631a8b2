"""Whitening and hard negatives next to plain versions."""

import math

import duckdb
import numpy as np
import pytest

from checks.compare import difference
from helioframe.llm import negatives, whitening
from helioframe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
FIELDS = "vec_id bigint, embedding array<float>, label int, n int, x int, row int, dims int, score int"


def write(spark, path, rows):
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], FIELDS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def odd_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = [(k, [float(np.float32(v)) for v in centres[k % 4] + 0.3 * rng.normal(size=6)], k % 3) for k in range(0, 620, 2)]
    rows += [(700 + k, [0.5, 0.25, 0.0, -0.5, 1.0, 0.125], k % 4) for k in range(60)]                 # ties
    rows += [(100, [1.0] * 6, 1), (100, [1.0] * 6, 1), (200, [0.0] * 6, 2), (300, [-0.5] * 6, None), (None, [1.0] * 6, 2), (None, [1.0] * 6, 0)]
    rows += [(400, None, 1), (400, [], 1), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (500, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 2)]
    rows += [(800, [3.0, 4.0], 0), (801, [3.0, 4.0], 0), (802, [3.0, 3.5], 1), (900, [1000.0, -1000.0, 0.0, 0.0, 0.0, 0.001], 5)]
    return rows


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("vectors"), odd_rows())


# -- 12 ------------------------------------------------------------------------
def usable(rows):
    return [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute_whitening(rows):
    """(vec_id, component) -> n, deviation, whitened, explained of each length."""
    out = []
    for d in {len(x) for _, x in rows}:
        own = [(i, x) for i, x in rows if len(x) == d]
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
        v = centred.T @ centred / n
        e, u = np.linalg.eigh(v)
        for i, x in own:
            dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            for k in range(min(4, d)):
                if e[-1 - k] > 1e-9 * e[-1] > 0:
                    w = np.dot([c - s / n for c, s in zip(x, sums, strict=True)], u[:, -1 - k]) / math.sqrt(e[-1 - k])
                    out.append((i, k + 1, n, dev, w, e[-1 - k] / np.trace(v)))
    return out


def key(r):
    return r[0] is None, r[0] or 0, r[1], r[2], r[3], round(abs(r[4]), 6)


def same_whitening(got, want):
    assert len(got) == len(want)
    sign = {}
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:4]) == tuple(w[:4])
        assert math.isclose(abs(g[4]), abs(w[4]), rel_tol=1e-6, abs_tol=1e-6) and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert g[6] < 1e-9
        if abs(w[4]) > 1e-3:
            assert sign.setdefault((g[2], g[1]), g[4] * w[4] > 0) == (g[4] * w[4] > 0)


def test_whitening_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    same_whitening(list(map(tuple, QUERIES["op12_whitening"](spark, SF).collect())), brute_whitening(usable(rows)))


def test_whitening_odd_rows(spark, odd_vectors):
    got = list(map(tuple, QUERIES["op12_whitening"](spark, odd_vectors).collect()))
    rows = spark.read.parquet(f"{odd_vectors}/embeddings.parquet").select("vec_id", "embedding").collect()
    same_whitening(got, brute_whitening(usable(rows)))


def test_one_distinct_vector_has_no_components(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert whitening.whiten_vectors(df).count() == 0


@pytest.mark.parametrize("span", [1, 300, 1 << 22, 1 << 30])
@pytest.mark.parametrize("rows", [1, 63, 64, 65, 200])
def test_cross_products_are_exact(span, rows):
    u = np.random.default_rng(rows).integers(0, span, size=(rows, 5))
    u[:, 3] = 0
    bits = np.array([int(c).bit_length() for c in u.max(axis=0)])
    want = [[sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.cross_products(u, bits).tolist() == want


def test_too_large_entries_raise(spark):
    df = spark.createDataFrame([(1, [1e300, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten_vectors(df).count()


# -- 13 ------------------------------------------------------------------------
def sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return con.execute(ORACLE[name]).df()


def test_negatives_odd_rows(spark, odd_vectors, monkeypatch):
    want = sql(odd_vectors, "op13_hard_negatives")
    assert len(want) > 30
    assert difference(QUERIES["op13_hard_negatives"](spark, odd_vectors).toPandas(), want) is None
    for name, value in (("BLOCK_ANCHORS", 2), ("BLOCK_ROWS", 50), ("SLICE_PAIRS", 64), ("EXACT_PAIRS", 5), ("LENGTHS", (6, 2, 1)), ("DENSE", 0)):
        monkeypatch.setattr(negatives, name, value)
    assert difference(QUERIES["op13_hard_negatives"](spark, odd_vectors).toPandas(), want) is None


def test_bounds_hold_and_prune():
    """Every score lies within its bounds, and few pairs of smooth clustered vectors are multiplied out."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centres = np.repeat(rng.normal(size=(40, 16)) * 256, 4, axis=1)
    x = np.floor(centres[np.arange(2000) % 40] + 40 * rng.normal(size=(2000, 64)))
    table = pa.table({"row": np.arange(2000), "vec_id": np.arange(2000), "label": np.arange(2000) % 7, "dims": np.full(2000, 64),
                      "x": pa.array([r.tobytes() for r in x], pa.binary()), "summary": pa.array([s.tobytes() for s in negatives.summaries(x)], pa.binary())})
    rows, anchors = negatives.Side(table, 64), negatives.Side(table.slice(0, 50), 64)
    scores = x[:50] @ x.T
    for level in range(len(negatives.LENGTHS)):
        least, most = negatives.bounds(anchors, rows, level, slice(0, 50), np.arange(2000))
        assert (least <= scores).all() and (scores <= most).all()
    stats = {}
    free = np.full((50, 1), negatives.ANY)
    found = {}
    for _, i, j, s in negatives.first_rows(anchors, rows, True, -free, free, 5, stats):
        for a, b, v in zip(i, j, s, strict=True):
            found.setdefault(int(a), []).append((int(b), int(v)))
    for a in range(50):
        own = [b for b in range(2000) if b % 7 == a % 7 and b != a]
        assert found[a] == [(b, int(scores[a, b])) for b in sorted(own, key=lambda b: (-scores[a, b], b))[:5]]
    assert stats["exact"] < 0.2 * stats["pairs"]
