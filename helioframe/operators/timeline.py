"""Rows of many series in time order, laid out so that no task holds a whole long series.

All windows of this package are row-count windows over one ordered series, and one series may
hold most of the data. A plain ``Window.partitionBy(series)`` would put it into a single task.
``build_timeline`` therefore measures the longest series first:

* up to ``SMALL_ROWS`` rows, every series is one window partition (one shuffle, no copies);
* beyond, rows are range-partitioned on the full sort key, which splits hot series and hot
  timestamps alike. The result is written once, numbered, and cut into chunks of ``CHUNK_ROWS``.
  Bounded frames then read their neighbours from halo copies (``spread``), unbounded ones from a
  per-chunk carry table (``carry``).

Both layouts give the same answer for every operator; ``layout=`` forces one of them. A column computed under
a halo is itself exact only so far into it: the timeline records how many rows each such column has used up, in
both layouts, and an operator that would read beyond raises in both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from helioframe.session import persist_table

SMALL_ROWS = 1_000_000
CHUNK_ROWS = 250_000

RN = "_rn"          # position in the series, from 0
LEN = "_len"        # length of the series
CHUNK = "_chunk"    # chunk whose window this row takes part in
OWN = "_own"        # False on halo copies
_SLICE, _POS = "_tl_slice", "_tl_pos"
HELPERS = (RN, LEN, CHUNK, OWN, _SLICE, _POS)

# monotonically_increasing_id() = partition << 33 | position in the partition
_POS_BITS = 33


@dataclass(frozen=True)
class Timeline:
    """An ordered DataFrame with position columns. Operators take one and return one."""

    df: DataFrame
    by: tuple[str, ...]
    chunked: bool
    chunk_rows: int = CHUNK_ROWS
    back: int = 0
    ahead: int = 0
    settled: bool = False
    declared: bool = False      # inside spread() .. collapse()
    used: dict[str, tuple[int, int]] = field(default_factory=dict)

    # -- shape ---------------------------------------------------------------
    def having(self, df: DataFrame) -> Timeline:
        return replace(self, df=df, settled=False)

    def with_column(self, name: str, column: Column) -> Timeline:
        return self.with_columns({name: column})

    def with_columns(self, columns: dict[str, Column]) -> Timeline:
        """Columns whose expressions may read any column: under a halo they count as the most used one."""
        out = self.having(self.df.withColumns(columns))
        return replace(out, used=self.used | dict.fromkeys(columns, self.consumed())) if self.used else out

    def consumed(self, cols: Sequence[str] | None = None) -> tuple[int, int]:
        """Halo rows behind and ahead that the given columns (default: any) have used up."""
        rows = list(self.used.values()) if cols is None else [self.used.get(c, (0, 0)) for c in cols]
        return max((r[0] for r in rows), default=0), max((r[1] for r in rows), default=0)

    def pipe(self, step: Callable[..., Timeline], *args, **kwargs) -> Timeline:
        return step(self, *args, **kwargs)

    def rows(self) -> DataFrame:
        """The result without helper columns."""
        return self.df.drop(*HELPERS)

    @property
    def keys(self) -> tuple[str, ...]:
        """What one window partition is made of."""
        return self.by + ((CHUNK,) if self.chunked else ())

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(RN)

    def reverse_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.desc(RN))

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # -- bounded frames --------------------------------------------------------
    def spread(self, back: int, ahead: int) -> Timeline:
        """Give every chunk the ``back`` rows before it and the ``ahead`` rows after it.

        A pipeline spreads once and runs many bounded operators on the same shuffle, up to ``collapse``. Whole
        series need no copies, but keep to the declared width all the same.
        """
        if self.declared:
            if self.back >= back and self.ahead >= ahead:
                return self
            raise ValueError(f"halo is {self.back}/{self.ahead} rows, {back}/{ahead} are needed; spread wider at the start")
        if not self.chunked:
            return replace(self, back=back, ahead=ahead, declared=True)
        size = F.lit(self.chunk_rows)
        home = chunk_of(self.chunk_rows)
        last = F.least(F.col(RN) + back, F.col(LEN) - 1)
        first = F.greatest(F.col(RN) - ahead, F.lit(0))
        copies = F.sequence(F.floor(first / size), F.floor(last / size))
        # away from a chunk border a row has exactly one home
        target = F.explode_outer(copies)
        df = self.df.withColumn("_home", home).withColumn(CHUNK, target)
        df = df.withColumn(OWN, F.col(CHUNK) == F.col("_home")).drop("_home")
        return replace(self, df=df, back=back, ahead=ahead, settled=False, declared=True)

    def collapse(self) -> Timeline:
        """Drop the halo copies."""
        bare = replace(self, back=0, ahead=0, declared=False, used={})
        if OWN not in self.df.columns:
            return bare
        return replace(bare, df=self.df.filter(OWN).drop(OWN), settled=False)

    def bounded(
        self, back: int, ahead: int, step: Callable[[Timeline], Timeline], reads: Sequence[str], writes: Sequence[str],
    ) -> Timeline:
        """Run ``step``, which reads that many rows of ``reads``, under a halo; keeps an enclosing halo if there is one."""
        before = self.consumed(reads)
        need = before[0] + back, before[1] + ahead
        wide = self.spread(*need)
        out = replace(step(replace(wide, used={})), used=self.used | dict.fromkeys(writes, need))
        return out if self.declared else out.collapse()

    # -- unbounded frames ------------------------------------------------------
    def settled_now(self) -> Timeline:
        """A chunked timeline whose rows come straight from a stored table.

        Carrying needs the rows twice (their windows and the per-chunk summary), so whatever was
        computed since the last write is written first instead of being run twice.
        """
        if self.settled or not self.chunked:
            return self
        return replace(self, df=persist_table(self.df, "timeline"), settled=True)

    def carry(
        self,
        *,
        last: dict[str, str] | None = None,
        upcoming: dict[str, str] | None = None,
        first: dict[str, str] | None = None,
        sums: dict[str, Column] | None = None,
        totals: dict[str, Column] | None = None,
    ) -> Timeline:
        """Columns whose frame reaches to an end of the series, named ``{new: source}``.

        ``last`` newest non-null value at or before the row; ``upcoming`` next one at or after it;
        ``first`` first non-null value of the series; ``sums`` running sum including the row;
        ``totals`` sum over the series. Descending order serves ``upcoming``: a frame from the
        current row to the partition end would be recomputed for every row.
        """
        last, upcoming, first = last or {}, upcoming or {}, first or {}
        sums, totals = sums or {}, totals or {}
        base = self.settled_now()
        so_far = base.so_far()
        to_come = base.reverse_window().rowsBetween(Window.unboundedPreceding, 0)

        local = {n: F.last(c, ignorenulls=True).over(so_far) for n, c in last.items()}
        local |= {n: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for n, c in sums.items()}
        backwards = {n: F.last(c, ignorenulls=True).over(to_come) for n, c in upcoming.items()}
        if not base.chunked:
            everywhere = Window.partitionBy(*base.by)
            local |= {n: F.first(c, ignorenulls=True).over(base.whole()) for n, c in first.items()}
            local |= {n: F.coalesce(F.sum(c).over(everywhere), F.lit(0)) for n, c in totals.items()}
            return base.with_columns(local).with_columns(backwards)

        def at_edge(pick, c: str) -> Column:
            return pick(c, F.when(F.col(c).isNotNull(), F.col(RN)))

        edges = {f"_e_{n}": at_edge(F.max_by, c) for n, c in last.items()}
        edges |= {f"_e_{n}": at_edge(F.min_by, c) for n, c in [*upcoming.items(), *first.items()]}
        edges |= {f"_e_{n}": F.sum(c) for n, c in [*sums.items(), *totals.items()]}
        chunks = base.df.groupBy(*base.keys).agg(*[c.alias(n) for n, c in edges.items()])

        up, down = (Window.partitionBy(*base.by).orderBy(o) for o in (F.col(CHUNK), F.desc(CHUNK)))
        before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (up, down))
        every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = {n: F.last(f"_e_{n}", ignorenulls=True).over(before) for n in last}
        carried |= {n: F.last(f"_e_{n}", ignorenulls=True).over(after) for n in upcoming}
        carried |= {n: F.first(f"_e_{n}", ignorenulls=True).over(every) for n in first}
        carried |= {n: F.sum(f"_e_{n}").over(before) for n in sums}
        carried |= {n: F.sum(f"_e_{n}").over(every) for n in totals}
        # rows / chunk_rows lines; the join strategy is left to the runtime statistics
        table = chunks.select(*base.keys, *[c.alias(f"_c_{n}") for n, c in carried.items()])

        own = base.with_columns(local).with_columns(backwards).df
        df = lookup(own, table, base.keys)
        df = df.withColumns(
            {n: F.coalesce(n, f"_c_{n}") for n in [*last, *upcoming]}
            | {n: F.col(f"_c_{n}") for n in first}
            | {n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
            | {n: F.coalesce(f"_c_{n}", F.lit(0)) for n in totals}
        )
        return base.having(df.drop(*[f"_c_{n}" for n in carried]))

    def renumber(self, position: str, length: str) -> Timeline:
        """Take dense positions from two columns after rows were filtered out."""
        df = self.df.withColumns({RN: F.col(position), LEN: F.col(length)}).drop(position, length)
        if self.chunked:
            df = df.withColumn(CHUNK, chunk_of(self.chunk_rows))
        return self.having(df)


def chunk_of(chunk_rows: int) -> Column:
    return F.expr(f"{RN} div {chunk_rows}")


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL, keeping the key columns of ``rows``."""
    renamed = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(renamed, same).drop(*[f"_k_{k}" for k in keys])


def longest_series(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest series: one pre-aggregated pass over the key columns."""
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return top or 0


def build_timeline(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    layout: str = "auto",
    small_rows: int = SMALL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Timeline:
    """Number the rows of every series along ``order`` (time first, a unique column last).

    ``layout`` is ``"auto"`` (measure, then choose), ``"whole"`` or ``"chunked"``. Without
    ``by`` all rows form one series.
    """
    by = tuple(by)
    if not by:
        df, by = df.withColumn("series", F.lit("all")), ("series",)
    if layout == "auto":
        layout = "whole" if longest_series(df, by) <= small_rows else "chunked"
    if layout == "whole":
        in_order = Window.partitionBy(*by).orderBy(*order)
        df = df.withColumns({
            RN: F.row_number().over(in_order) - F.lit(1).cast("long"),
            LEN: F.count(F.lit(1)).over(Window.partitionBy(*by)),
        })
        return Timeline(df, by, chunked=False, chunk_rows=chunk_rows)
    if layout != "chunked":
        raise ValueError(f"unknown layout {layout!r}")
    return _number_chunks(df, by, tuple(order), chunk_rows)


def _number_chunks(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], chunk_rows: int) -> Timeline:
    # Range borders come from a sample, so a second run of the plan could cut elsewhere. Writing the
    # sorted slices makes slice and position facts that both branches below read.
    row_id = F.monotonically_increasing_id()
    slices = persist_table(
        df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
        .withColumn("_id", row_id)
        .withColumns({
            _SLICE: F.shiftright("_id", _POS_BITS),
            _POS: F.col("_id").bitwiseAND(F.lit((1 << _POS_BITS) - 1)),
        }).drop("_id"),
        "slices",
    )
    spans = slices.groupBy(*by, _SLICE).agg(F.count(F.lit(1)).alias("_rows"), F.min(_POS).alias("_start"))
    up = Window.partitionBy(*by).orderBy(_SLICE)
    spans = spans.select(
        *by, _SLICE,
        (F.coalesce(F.sum("_rows").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_start")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias(LEN),
    )
    df = lookup(slices, spans, [*by, _SLICE]).withColumn(RN, F.col(_POS) + F.col("_shift"))
    df = df.withColumn(CHUNK, chunk_of(chunk_rows)).drop(_SLICE, _POS, "_shift")
    return Timeline(df, by, chunked=True, chunk_rows=chunk_rows, settled=True)
