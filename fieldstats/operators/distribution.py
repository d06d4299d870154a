"""Box statistics, histograms and numeric profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.kept import kept
from fieldstats.names import any_names
from fieldstats.operators.joins import join_stats
from fieldstats.operators.positions import (
    COARSE,
    QUARTILES,
    ROWS_PER_SEGMENT,
    SKETCH_K,
    counted,
    light,
    locate,
    number,
    present,
    quartiles,
)
from fieldstats.operators.reshape import to_long

WHISKER = 1.5


def _fences() -> dict:
    reach = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    return {"_low": F.col("q1") - reach, "_high": F.col("q3") + reach}


def _whisker_aggs(value: str, n: str) -> list:
    inside = (F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high"))
    return [
        F.min(F.when(inside, F.col(value).cast("double"))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value).cast("double"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col(n))).cast("long").alias("n_outliers"),
    ]


_BOX = ["n", "q1", "median", "q3", "mean", "whisker_low", "whisker_high", "n_outliers"]


def _approx_quartiles(rows: DataFrame, groups: list[str], value: str, accuracy: int) -> DataFrame:
    return (
        rows.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias("_q"),
        )
        .select(
            *groups,
            "n",
            "mean",
            F.col("_q")[0].alias("q1"),
            F.col("_q")[1].alias("median"),
            F.col("_q")[2].alias("q3"),
        )
    )


@any_names
def box_stats(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    approx: bool = False,
    accuracy: int = 10_000,
    rows_per_segment: int = ROWS_PER_SEGMENT,
    weight: str | None = None,
    folded: bool = False,
) -> DataFrame:
    """Box-plot statistics of ``value`` per group.

    Quartiles interpolate linearly (type 7); whiskers are the most extreme values
    within 1.5 interquartile ranges of the box; what lies beyond is an outlier.
    Missing values and groups are dropped. ``approx`` takes the quartiles from a
    sketch instead and never shuffles values. ``weight`` is a column of whole-number row
    weights; ``folded`` says that the rows are kept cells (see :func:`locate`).
    """
    groups = list(groups)
    if approx:
        if weight:
            raise ValueError("approx takes no weight")
        rows = present(df.select(*groups, number(value).alias(value)), [*groups, value])
        fences = _approx_quartiles(rows, groups, value, accuracy).withColumns(_fences())
        if not groups:
            rows, fences = rows.withColumn("_all", F.lit(0)), fences.withColumn("_all", F.lit(0))
        keys = groups or ["_all"]
        joined = join_stats(rows, fences, keys)
        carried = ("n", "q1", "median", "q3", "mean")
        whiskers = joined.withColumn("_one", F.lit(1)).groupBy(*keys).agg(
            *[F.max(c).alias(c) for c in carried], *_whisker_aggs(value, "_one")
        )
        return whiskers.select(*groups, *_BOX)

    keys = groups or ["_all"]
    rows = df if groups else df.withColumn("_all", F.lit(0))
    pos = locate(rows, keys, value, weight=weight, rows_per_segment=rows_per_segment, least=COARSE, folded=folded)
    mean = F.sum(F.col(value).cast("double") * F.col("n")) / F.sum("n")
    fences = light(quartiles(pos, _mean=mean, _sorted=F.sum("n")).withColumns(_fences()))
    boxes = (
        join_stats(pos.cells.select(*keys, value, "n"), fences, keys)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("_n"),
            # Added in order of value, so that reruns agree in the last digit, if all was sorted.
            F.when(F.max("_sorted") == F.sum("n"), F.max("_mean")).otherwise(mean).alias("mean"),
            *[F.max(c).alias(c) for c in QUARTILES],
            *_whisker_aggs(value, "n"),
        )
        .withColumnRenamed("_n", "n")
    )
    return boxes.select(*groups, *_BOX)


@any_names
def quantile_sketches(df: DataFrame, groups: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable sketch of the values per group: groups, ``n``, ``sketch`` (binary).

    Missing values and groups are dropped. A sketch has a fixed size by ``k``, may be
    written to a table, and is exact up to about ``k`` values; beyond, ranks are within
    about 2.3 / k ** 0.9 of n.
    """
    groups = list(groups)
    rows = present(df.select(*groups, number(value).alias(value)), [*groups, value])
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, k).alias("sketch"))


@any_names
def merge_quantile_sketches(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of parts (sites, days, files) as one per coarser group, without the rows."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


@any_names
def sketched_quartiles(sketches: DataFrame) -> DataFrame:
    """Adds ``q1``, ``median`` and ``q3``: values of the data whose rank is within the sketch's error."""
    at = F.kll_sketch_get_quantile_double("sketch", F.lit(np.array([0.25, 0.5, 0.75])))
    found = sketches.withColumn("_q", at)
    return found.withColumns({name: F.col("_q")[i] for i, name in enumerate(("q1", "median", "q3"))}).drop("sketch", "_q")


@any_names
def box_outliers(
    df: DataFrame, groups: Sequence[str], value: str, rows_per_segment: int = ROWS_PER_SEGMENT
) -> DataFrame:
    """The rows whose value lies beyond the whiskers of their group."""
    groups = list(groups)
    pos = locate(df, groups, value, rows_per_segment=rows_per_segment, least=COARSE)
    fences = quartiles(pos).withColumns(_fences()).select(*groups, "_low", "_high")
    joined = join_stats(df, fences, groups)
    outside = (number(value) < F.col("_low")) | (number(value) > F.col("_high"))
    return joined.filter(outside).select(*df.columns)


@any_names
def box_stats_many(
    df: DataFrame, groups: Sequence[str], cols: Sequence[str], **options
) -> DataFrame:
    """:func:`box_stats` of several columns by one grouping, in one job."""
    long = to_long(df, groups, cols, "variable", "value")
    return box_stats(long, ["variable", *groups], "value", **options)


@any_names
def group_histogram(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of each group over its own range.

    The largest value falls in the last bin; a constant group spans half a unit to
    each side. Empty bins are listed with a count of zero.
    """
    # The source is read once: what differs is counted and kept, and gives spans and bins.
    rows = kept(counted(df.select(group, number(value).alias(value)), [group], value))
    spans = rows.groupBy(group).agg(
        F.sum("n").alias("n"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    flat = F.col("_min") == F.col("_max")
    spans = spans.select(
        group,
        "n",
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    ).filter(F.col("_lo") < F.col("_hi"))  # always so; keeps all uses of the spans alike
    width = F.col("_hi") - F.col("_lo")
    at = F.least(
        F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width * F.lit(bins)).cast("int")
    )
    per_bin = (
        join_stats(rows.withColumnRenamed("n", "_n"), spans, [group])
        .groupBy(group, at.alias("bin"))
        .agg(F.sum("_n").alias("count"))
    )
    edges = spans.select(
        group, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return edges.join(per_bin, [group, "bin"], "left").select(
        group,
        "bin",
        (F.col("_lo") + width * F.col("bin") / bins).alias("low"),
        (F.col("_lo") + width * (F.col("bin") + 1) / bins).alias("high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


@any_names
def describe_numeric(
    df: DataFrame, cols: Sequence[str] | None = None, rows_per_segment: int = ROWS_PER_SEGMENT
) -> DataFrame:
    """Count, mean, sd, minimum, quartiles and maximum of numeric columns."""
    cols = list(
        cols
        if cols is not None
        else [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    )
    long = to_long(df.select(*[number(c).alias(c) for c in cols]), [], cols)
    middle = quartiles(locate(long, ["variable"], "value", rows_per_segment=rows_per_segment, least=COARSE))
    # Long rows exist only inside the task: each partial aggregate has one line per column.
    moments = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        (F.count(F.lit(1)) - F.count("value")).alias("n_missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return (
        moments.join(middle, "variable", "left")
        .select("variable", "count", "mean", "sd", "min", "q1", "median", "q3", "max", "n_missing")
    )


@any_names
def variable_summary(df: DataFrame, col: str, **options) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number missing of one column."""
    return describe_numeric(df, [col], **options).select(
        "variable", "min", "q1", "median", "mean", "q3", "max", "n_missing"
    )
