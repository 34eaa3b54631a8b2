"""Local-polynomial smoothing and derivatives (one-sample spacing)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.operators.timeline import LEN, RN, Timeline

SUFFIXES = ("smooth", "vel", "accel")


@lru_cache(maxsize=None)
def weights(window: int, degree: int, deriv: int) -> tuple[tuple[float, ...], ...]:
    """Row ``p`` holds the taps that give the fitted polynomial's derivative at position ``p``."""
    half = window // 2
    at = (np.arange(window, dtype=float) - half) / half   # within [-1, 1]: well conditioned
    fit = np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
    power = np.arange(degree + 1)
    scale = np.array([np.prod(np.arange(k, k - deriv, -1.0)) if k >= deriv else 0.0 for k in power])
    exponent = np.maximum(power - deriv, 0)
    rows = (at[:, None] ** exponent * scale) @ fit / half ** deriv
    return tuple(tuple(float(v) for v in row) for row in rows)


def _numbers(row: tuple[float, ...]) -> list[str]:
    return [f"({w!r}D)" for w in row]


def _dot(names: list[str], row: tuple[float, ...]) -> Column:
    return F.expr(" + ".join(f"`{n}` * {w}" for n, w in zip(names, _numbers(row), strict=True)))


def _edge_dot(taps: str, table: tuple[tuple[float, ...], ...], place: str) -> Column:
    rows = ", ".join(f"array({', '.join(_numbers(row))})" for row in table)
    return F.expr(
        f"aggregate(zip_with(`{taps}`, get(array({rows}), cast({place} AS INT)), (x, w) -> x * w), 0D, (a, v) -> a + v)"
    )


def poly_filter(
    tl: Timeline,
    outputs: dict[str, str],
    window: int = 11,
    degree: int = 3,
    derivs: tuple[int, ...] = (0, 1, 2),
) -> Timeline:
    """For every ``{column: prefix}`` add ``prefix_smooth``, ``prefix_vel``, ``prefix_accel``.

    Interior rows are a weighted sum of their neighbours, which stays in generated code. The rows
    nearer than half a window to an end use the polynomial of the first or last full window: that
    window is seen by one row only, so this row shares it with its series. A series shorter than
    the window is its own smooth, with zero derivatives.
    """
    half = window // 2
    offsets = range(-half, half + 1)

    def step(t: Timeline) -> Timeline:
        w, rn, n = t.window(), F.col(RN), F.col(LEN)
        names = {col: [f"_{prefix}_{k}" for k in offsets] for col, prefix in outputs.items()}
        t = t.with_columns({
            name: F.lag(col, -k).over(w) if k else F.col(col)
            for col in outputs for name, k in zip(names[col], offsets, strict=True)
        })
        first_full, last_full = rn == half, rn == n - half - 1
        edges = {
            f"_{prefix}_{end}": F.first(F.when(here, F.array(*names[col])), ignorenulls=True).over(t.whole())
            for col, prefix in outputs.items() for end, here in (("head", first_full), ("tail", last_full))
        }
        t = t.with_columns(edges)
        results = {}
        for col, prefix in outputs.items():
            for d in derivs:
                table = weights(window, degree, d)
                short = F.col(col) if d == 0 else F.col(col) * 0
                results[f"{prefix}_{SUFFIXES[d]}"] = (
                    F.when(n < window, short)
                    .when(rn < half, _edge_dot(f"_{prefix}_head", table[:half], RN))
                    .when(rn >= n - half, _edge_dot(f"_{prefix}_tail", table[half + 1:], f"{RN} - ({LEN} - {half})"))
                    .otherwise(_dot(names[col], table[half]))
                )
        t = t.with_columns(results)
        return t.having(t.df.drop(*edges, *[name for group in names.values() for name in group]))

    written = [f"{prefix}_{SUFFIXES[d]}" for prefix in outputs.values() for d in derivs]
    return tl.bounded(window - 1, window - 1, step, list(outputs), written)
