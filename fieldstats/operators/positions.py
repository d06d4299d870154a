"""Exact positions of values inside groups of any size.

Medians, quartiles and ranks all need to know how many values of a group lie below
a given value. A plain window would sort a whole group in one task. Here

1. rows become (group, value, count) in one pass over the input, which collapses ties
   before any sort; these cells are kept, and all that follows reads them;
2. the value axis is cut at quantiles of the cells, so each (group, segment) holds a
   bounded number of them, however the groups are sized;
3. a running sum is taken inside each (group, segment);
4. the totals of the earlier segments, at most one row per group and segment, are
   added by a join that finds the counts already partitioned by its key.

Cut points come from a tree of sketches: each task sketches its cells, ``FAN`` sketches are
merged by one task, and so on up. A few hundred coarse cuts are numbers in the plan; where a
coarse stretch still holds too much, it is cut again by sketches of its own, and these cuts
are a small table, joined by stretch. They only balance the work: any cut points give the
same result, and data of any size takes the same path, a small table as one segment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.kept import kept

# Cells that one task can sort comfortably.
ROWS_PER_SEGMENT = 4_000_000
# Segments that are made where a task would hold more than SMALLEST cells with fewer.
LEAST, SMALLEST = 64, 65_536
# Stretches that the first cuts make, at most, and segments that each can be cut into.
COARSE, FINE = 256, 1_024
# Sketches that one task merges, and their size (ranks within about 0.2 %).
FAN = 256
SKETCH_K = 4_096

# Rows that every task can hold for a join.
LIGHT_ROWS = 100_000

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

SEGMENT = "_segment"


class Positions(NamedTuple):
    """Counted values with their segment, and the segments with their offsets."""

    cells: DataFrame  # groups, value, extra keys, n, _segment
    segments: DataFrame  # groups, _segment, offset, total, _size
    groups: list[str]
    value: str


def number(c: str) -> Column:
    """A numeric column as double, with NaN read as missing and -0.0 as 0.0."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(F.isnan(v), None).otherwise(v + F.lit(0.0))


def sortable(df: DataFrame, c: str) -> Column:
    """A column to rank by: integers and decimals as they are, all else as a number."""
    exact = isinstance(df.schema[c].dataType, (T.IntegralType, T.DecimalType))
    return F.col(f"`{c}`") if exact else number(c)


def filled(df: DataFrame, c: str) -> Column:
    """A column of any type in which NaN reads as missing."""
    v = F.col(f"`{c}`")
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.when(~F.isnan(v), v) if floating else v


def present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which all of ``cols`` are present."""
    for c in cols:
        df = df.filter(F.col(f"`{c}`").isNotNull())
    return df


def sketch_tree(rows: DataFrame, value: str, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch (``sketch``, a KLL sketch of doubles) of the finite values per key.

    Tasks sketch what they read, then up to ``FAN`` sketches are merged at a time: by 256
    and by 65,536 neighbouring tasks, then for the whole key. No task reads more than
    ``FAN`` sketches of a key as long as the input has fewer than ``FAN`` ** 3 tasks.
    """
    by = list(by)
    v = F.col(value).cast("double")
    parts = rows.filter(F.abs(v) < F.lit(math.inf)).select(*by, v.alias("_v"), F.spark_partition_id().alias("_part"))
    near = F.floor(F.col("_part") / FAN).alias("_part")
    level = parts.groupBy(*by, near).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"))
    level = level.groupBy(*by, near).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return level.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketch: Column, grid: int) -> Column:
    """The ``grid - 1`` values at the ranks 1 / grid, 2 / grid ... of a sketch."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(np.arange(1, grid) / grid))


def _thinned(cuts: Column, grid: int, wanted: Column) -> Column:
    """Of the cuts by ``grid``, those that make ``wanted`` parts, without repeats."""
    wanted = F.greatest(F.least(wanted, F.lit(grid)), F.lit(1))
    at = F.filter(F.sequence(F.lit(0), wanted - 1), lambda i: i > 0)
    return F.array_distinct(F.transform(at, lambda i: F.get(cuts, F.floor(i * grid / wanted).cast("int") - 1)))


def _stretch(value: Column, cuts: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` (fewer than ``most``) are not above ``value``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def segmented(cells: DataFrame, value: str, size: int, least: int = 1) -> DataFrame:
    """``cells`` (kept) with their segment of about ``size`` cells, numbered in order.

    There are at least ``least`` segments, unless they would hold fewer than ``SMALLEST``.
    """
    at = F.lit(0).cast("long")
    n = cells.count()
    size = min(size, max(math.ceil(n / least), SMALLEST))
    if n <= size:
        return cells.withColumn(SEGMENT, at)
    wanted = math.ceil(n / size)
    top = sketch_tree(cells, value).select(_thinned(sketch_quantiles(F.col("sketch"), COARSE), COARSE, F.lit(wanted)))
    coarse = sorted(top.first()[0] or [])
    if coarse:
        splits = [-math.inf, *coarse, math.inf]
        cells = Bucketizer(splits=splits, inputCol="_at", outputCol=SEGMENT).transform(
            cells.withColumn("_at", F.col(value).cast("double"))
        ).drop("_at")
        # Never null, so that no null filter is pushed below one use of the counts
        # only: all uses then share one shuffle.
        at = F.coalesce(F.col(SEGMENT).cast("long"), at)
    cells = cells.withColumn(SEGMENT, at)
    if wanted <= COARSE:
        return cells
    # Stretches that still hold too much are cut again.
    per_stretch = F.ceil(F.kll_sketch_get_n_double("sketch") / size).cast("int")
    fine = kept(
        sketch_tree(cells, value, [SEGMENT]).select(
            SEGMENT, _thinned(sketch_quantiles(F.col("sketch"), FINE), FINE, per_stretch).alias("_cuts")
        )
    )
    found = cells.join(fine.withColumnRenamed(SEGMENT, "_in"), F.col(SEGMENT) == F.col("_in"), "left")
    inner = F.coalesce(_stretch(F.col(value).cast("double"), F.col("_cuts"), FINE), F.lit(0))
    return found.withColumn(SEGMENT, F.col(SEGMENT) * FINE + inner).drop("_in", "_cuts")


def counted(
    rows: DataFrame, groups: Sequence[str], value: str, extra: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """The distinct values of each group (and extra key) with their count ``n``.

    Rows with a missing value, group or extra key are dropped. ``weight`` is a column of
    whole-number row weights.
    """
    keys = [*groups, *extra, value]
    picked = rows.withColumn(value, sortable(rows, value)).select(
        *keys, (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")
    )
    return present(picked, keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def locate(
    rows: DataFrame,
    groups: Sequence[str],
    value: str,
    extra: Sequence[str] = (),
    weight: str | None = None,
    rows_per_segment: int = ROWS_PER_SEGMENT,
    least: int = 1,
    folded: bool = False,
) -> Positions:
    """Count the values of each group and assign them to segments.

    The input is read once, into cells that are kept (see :func:`counted`). ``extra``
    columns split the counts further without being part of the order. ``folded`` rows are
    cells that are kept already, with ``weight`` as their count; a value may be in several.
    """
    groups = list(groups)
    if folded:
        known = rows.withColumn(value, sortable(rows, value)).select(*groups, *extra, value, F.col(weight).cast("long").alias("n"))
        cells = present(known, [*groups, *extra, value])
    else:
        cells = kept(counted(rows, groups, value, extra, weight))
    cells = segmented(cells, value, rows_per_segment, least)
    sizes = cells.groupBy(*groups, SEGMENT).agg(F.sum("n").alias("_size"))
    by_group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = by_group.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    segments = sizes.select(
        *groups,
        SEGMENT,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("offset"),
        F.sum("_size").over(by_group).alias("total"),
        "_size",
    )
    return Positions(cells, segments, groups, value)


def ranked_cells(pos: Positions, tied: bool = False) -> DataFrame:
    """The counted values with ``before``, ``ties`` and ``total``.

    ``before`` is the number of rows of the group with a smaller value, ``ties`` the
    number with this value, ``total`` the size of the group. Set ``tied`` when
    extra keys let one value occur in several cells.
    """
    keys = [*pos.groups, SEGMENT]
    inside = Window.partitionBy(*keys).orderBy(pos.value)
    if tied:
        # Range frames: up to, and exactly, the cells with the same value.
        same = inside.rangeBetween(Window.currentRow, Window.currentRow)
        upto = F.sum("n").over(inside)
        ties = F.sum("n").over(same)
    else:
        upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.col("n")
    cells = pos.cells.withColumns({"_upto": upto, "ties": ties})
    cells = cells.join(pos.segments, keys, "inner")
    return cells.withColumn("before", F.col("offset") + F.col("_upto") - F.col("ties")).drop(
        "_upto", "offset", "_size"
    )


def quartile_columns(value: str, aggregate=lambda c: c) -> dict[str, Column]:
    """Aggregates over :func:`ranked_cells` that pick the quartiles (type 7).

    Position ``(total - 1) * q`` is interpolated between its two neighbours, each of
    which is the value that covers it. ``aggregate`` turns an aggregate into a
    window expression where that is wanted.
    """
    out = {}
    for name, q in QUARTILES.items():
        spot = (F.col("total") - F.lit(1)) * F.lit(q)
        upto = F.col("before") + F.col("ties")
        low, high = F.floor(spot), F.ceil(spot)
        lo_v = aggregate(
            F.max(F.when((F.col("before") <= low) & (low < upto), F.col(value).cast("double")))
        )
        hi_v = aggregate(
            F.max(F.when((F.col("before") <= high) & (high < upto), F.col(value).cast("double")))
        )
        part = aggregate(F.max(spot - low))
        out[name] = lo_v + (hi_v - lo_v) * part
    return out


def light(df: DataFrame) -> DataFrame:
    """``df`` kept, and broadcast in joins if it has at most ``LIGHT_ROWS`` rows."""
    table = kept(df)
    return F.broadcast(table) if table.count() <= LIGHT_ROWS else table


def quartiles(pos: Positions, **more: Column) -> DataFrame:
    """``q1``, ``median`` and ``q3`` per group of :func:`locate`.

    Only segments that hold one of these positions are shuffled and sorted; the sizes of
    the others are enough. ``more`` are aggregates over the sorted cells.
    """
    end = F.col("offset") + F.col("_size")
    holds = F.lit(False)
    for q in QUARTILES.values():
        spot = (F.col("total") - F.lit(1)) * F.lit(q)
        holds = holds | ((F.floor(spot) < end) & (F.ceil(spot) >= F.col("offset")))
    segments = light(pos.segments.filter(holds))
    cells = pos.cells.join(segments.select(*pos.groups, SEGMENT), [*pos.groups, SEGMENT], "left_semi")
    ranked = ranked_cells(Positions(cells, segments, pos.groups, pos.value), tied=True)
    return ranked.groupBy(*pos.groups).agg(*[c.alias(k) for k, c in (quartile_columns(pos.value) | more).items()])
