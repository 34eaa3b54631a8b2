"""Look-ahead peaks and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.functions.classify import flux_class
from helioframe.operators.timeline import LEN, RN, Timeline
from helioframe.schema import HORIZONS


def _ladder(t: Timeline, col: str, sizes: list[int]) -> tuple[Timeline, dict[int, str]]:
    """Columns holding max over the next m rows, for every m in ``sizes``.

    A maximum over m rows is the greater of two overlapping shorter ones, so each size costs one
    shifted column on top of a smaller size instead of a frame of m rows.
    """
    w = t.window()
    have: dict[int, str] = {}
    for size in sorted(set(sizes)):
        while size not in have:
            best = max(have, default=0)
            name = f"_next_{min(size, 2 * best) if best else min(size, 16)}"
            reach = int(name.rsplit("_", 1)[1])
            if best == 0:
                column = F.max(col).over(w.rowsBetween(1, reach))
            else:
                column = F.greatest(F.col(have[best]), F.lead(have[best], reach - best).over(w))
            t = t.with_column(name, column)
            have[reach] = name
    return t, have


def horizon_peaks(
    tl: Timeline, col: str, steps: dict[str, int] = HORIZONS, prefix: str = "TargetPeak", strict_reference: bool = True,
) -> Timeline:
    """Maximum of ``col`` (without gaps) over the next ``n`` rows, for every horizon name.

    The window shrinks at the end; the last row, which has no future, repeats the row before it.
    ``strict_reference`` keeps two rules of the original target table: positions before ``n``
    never count, which shortens the window of the first ``n - 1`` rows, and a series of at most
    ``n`` rows gets 0. Without it the plain next-``n``-rows maximum is returned.
    """
    widest = max(steps.values())

    def step(t: Timeline) -> Timeline:
        w, rn, n = t.window(), F.col(RN), F.col(LEN)
        t, have = _ladder(t, col, list(steps.values()))
        if not strict_reference:
            results = {f"{prefix}_{h}": F.coalesce(have_col(have, k), F.when(n > 1, F.col(col)), F.lit(0.0)) for h, k in steps.items()}
            return t.with_columns(results).pipe(_without, have)
        # max over positions k..here, which a row k earlier reads as "from k to my horizon"
        t = t.with_columns({f"_from_{k}": F.max(F.when(rn >= k, F.col(col))).over(t.so_far()) for k in steps.values()})
        t = t.with_columns({f"_head_{k}": F.lead(f"_from_{k}", k).over(w) for k in steps.values()})
        t = t.with_columns({f"_all_{k}": F.max(F.when(rn >= k, F.col(col))).over(t.whole()) for k in steps.values()})
        results = {
            f"{prefix}_{h}": (
                F.when(n <= k, F.lit(0.0))
                .when(rn == n - 1, F.col(col))
                .when(rn < k - 1, F.coalesce(f"_head_{k}", f"_all_{k}"))
                .otherwise(have_col(have, k))
            )
            for h, k in steps.items()
        }
        extra = {f"_{kind}_{k}": f"_{kind}_{k}" for kind in ("from", "head", "all") for k in steps.values()}
        return t.with_columns(results).pipe(_without, have, extra)

    # head rows read up to 2n - 2 rows on, all of them inside the first chunk and its halo
    if strict_reference and tl.chunk_rows < widest:
        raise ValueError(f"chunk_rows must be at least the widest horizon ({widest})")
    return tl.bounded(0, widest, step, [col], [f"{prefix}_{h}" for h in steps])


def have_col(have: dict[int, str], size: int) -> Column:
    return F.col(have[size])


def _without(t: Timeline, *maps: dict) -> Timeline:
    return t.having(t.df.drop(*[name for m in maps for name in m.values()]))


def horizon_targets(
    tl: Timeline, col: str, steps: dict[str, int] = HORIZONS, strict_reference: bool = True,
) -> Timeline:
    """Peak and class for every horizon."""
    out = horizon_peaks(tl, col, steps, strict_reference=strict_reference)
    return out.with_columns({f"TargetClass_{h}": flux_class(F.col(f"TargetPeak_{h}")) for h in steps})
