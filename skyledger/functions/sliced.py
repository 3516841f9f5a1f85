"""Ordered per-key computations that never put one key into one task.

A plain ``Window.partitionBy(key).orderBy(time)`` sorts a whole key in one task, which fails when one
principal, address or case holds a third of the rows. Here each key is cut into time slices. The window runs
inside (key, slice); one summary row per (key, slice) is combined along the slices and joined back as the
carry-in. Summaries use partial aggregation and their number per key is bounded by time span / slice width,
so results equal the unsliced window while no group grows with the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SLICE = "_slice"
DEFAULT_WIDTH = 60_000_000 * 5  # five minutes: about 105,000 slices per key and year at most


def slice_of(us: Column, width: int = DEFAULT_WIDTH) -> Column:
    return F.floor(us / F.lit(width)).cast("bigint")


def carry_scan(
    df: DataFrame,
    keys: list[str],
    order: list,
    local: dict[str, Callable[[WindowSpec], Column]],
    summary: dict[str, Column],
    carry: dict[str, Callable[[WindowSpec], Column]],
    descending: bool = False,
) -> DataFrame:
    """Add ``local`` columns computed inside a slice and ``carry`` columns computed over earlier slices.

    ``df`` needs a non-null ``_slice`` column that grows with the order. ``descending`` scans backwards.
    """
    part = [*keys, SLICE]
    inside = Window.partitionBy(*part).orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(F.desc(SLICE) if descending else F.asc(SLICE))
    rows = df.select("*", *[fn(inside).alias(name) for name, fn in local.items()])
    per_slice = df.groupBy(*part).agg(*[c.alias(name) for name, c in summary.items()])
    carried = per_slice.select(*part, *[fn(along).alias(name) for name, fn in carry.items()])
    return rows.join(carried, part, "left")


def _neighbour(df, keys, order, values, name, width, us, forward):
    packed = F.struct(*order, *[v for v in values if v not in order])
    src = df.withColumn(SLICE, slice_of(F.col(us), width))
    step = F.lead if forward else F.lag
    edge = F.min(packed) if forward else F.max(packed)
    out = carry_scan(src, keys, order,
                     local={"_near": lambda w: step(packed).over(w)},
                     summary={"_edge": edge},
                     carry={"_far": lambda w: step("_edge").over(w)})
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", SLICE)


def with_previous(df: DataFrame, keys: list[str], values: list[str], name: str = "prev",
                  order: list[str] | None = None, width: int = DEFAULT_WIDTH, us: str = "us") -> DataFrame:
    """Add struct ``name`` with the previous row's order columns and ``values`` (null for the first row)."""
    return _neighbour(df, keys, order or ["us", "seq"], values, name, width, us, forward=False)


def with_next(df: DataFrame, keys: list[str], values: list[str], name: str = "next",
              order: list[str] | None = None, width: int = DEFAULT_WIDTH, us: str = "us") -> DataFrame:
    """Mirror of :func:`with_previous`."""
    return _neighbour(df, keys, order or ["us", "seq"], values, name, width, us, forward=True)


def with_latest(df: DataFrame, keys: list[str], flag: Column, values: list[str], name: str,
                order: list[str] | None = None, width: int = DEFAULT_WIDTH, us: str = "us") -> DataFrame:
    """Add struct ``name``: order columns and ``values`` of the latest row up to here where ``flag`` holds."""
    order = order or ["us", "seq"]
    packed = F.when(flag, F.struct(*order, *[v for v in values if v not in order]))
    src = df.withColumn(SLICE, slice_of(F.col(us), width))
    out = carry_scan(src, keys, order,
                     local={"_near": lambda w: F.last(packed, ignorenulls=True).over(
                         w.rowsBetween(Window.unboundedPreceding, Window.currentRow))},
                     summary={"_edge": F.max(packed)},
                     carry={"_far": lambda w: F.max("_edge").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", SLICE)


def with_running_sum(df: DataFrame, keys: list[str], delta: Column, name: str, order: list,
                     width: int = DEFAULT_WIDTH, us: str = "us") -> DataFrame:
    """Add the inclusive running sum of ``delta`` per key."""
    src = df.withColumn(SLICE, slice_of(F.col(us), width))
    out = carry_scan(src, keys, order,
                     local={"_near": lambda w: F.sum(delta).over(
                         w.rowsBetween(Window.unboundedPreceding, Window.currentRow))},
                     summary={"_edge": F.sum(delta)},
                     carry={"_far": lambda w: F.sum("_edge").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return (out.withColumn(name, F.col("_near") + F.coalesce("_far", F.lit(0)))
            .drop("_near", "_far", SLICE))


def with_global_number(df: DataFrame, us: str, order: list, name: str, keys: list[str] | None = None,
                       width: int = DEFAULT_WIDTH) -> DataFrame:
    """Number all rows (of each key, where keys are given) 1..n by ``us`` (nulls last) then ``order`` without a single-partition sort.

    Only the per-slice counts, bounded by time span / width, meet in one place.
    """
    last = F.lit((1 << 62))
    src = df.withColumn(SLICE, F.coalesce(slice_of(F.col(us), width), last)).withColumn("_all", F.lit(0))
    out = carry_scan(src, keys or ["_all"], [F.asc_nulls_last(us), *order],
                     local={"_near": lambda w: F.row_number().over(w)},
                     summary={"_edge": F.count("*")},
                     carry={"_far": lambda w: F.sum("_edge").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return (out.withColumn(name, (F.col("_near") + F.coalesce("_far", F.lit(0))).cast("bigint"))
            .drop("_near", "_far", "_all", SLICE))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``. An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)
