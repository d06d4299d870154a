"""Grouped means, sums, counts and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats import constants as K
from fieldstats.functions.domain import by_key, co2_equivalent, per_year
from fieldstats.names import any_names
from fieldstats.operators.positions import filled, number, present
from fieldstats.operators.reshape import to_long


def _sem(n: Column, sd: Column) -> Column:
    return sd / F.sqrt(n)


def _with_limits(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"lower": F.col("mean") - F.col("sem"), "upper": F.col("mean") + F.col("sem")}
    )


@any_names
def mean_sem(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, mean, standard error and error-bar limits per group.

    Rows with a missing group or value do not count; a group of one has no standard
    error. Both statistics come from one aggregate with map-side partial sums.
    """
    groups = list(groups)
    rows = present(df.select(*groups, number(value).alias("_v")), [*groups, "_v"])
    out = rows.groupBy(*groups).agg(
        F.count("_v").alias("n"),
        F.avg("_v").alias("mean"),
        _sem(F.count("_v"), F.stddev_samp("_v")).alias("sem"),
    )
    return _with_limits(out if groups else out.filter(F.col("n") > 0))


@any_names
def mean_sem_wide(
    df: DataFrame, groups: Sequence[str], cols: Mapping[str, Column | str], name: str = "variable"
) -> DataFrame:
    """:func:`mean_sem` of several columns, named by the keys of ``cols``.

    The rows become lines of (name, value) inside the map task, next to the partial
    aggregate: what is shuffled is one line per group and column.
    """
    groups = list(groups)
    values = {k: (F.col(c) if isinstance(c, str) else c) for k, c in cols.items()}
    rows = present(df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())}), groups)
    lines = [F.struct(F.lit(k).alias(name), number(f"_v{i}").alias("_v")) for i, k in enumerate(values)]
    return mean_sem(rows.select(*groups, F.inline(F.array(*lines))), [*groups, name], "_v")


@any_names
def sum_of_means(
    summary: DataFrame,
    by: Sequence[str],
    mean: str = "mean",
    sem: str = "sem",
    sem_policy: str = "omit",
    zero_where: Column | None = None,
) -> DataFrame:
    """Add the means, and linearly the standard errors, of several variables.

    ``omit``: a missing standard error is left out, and a class with none at all
    disappears. ``zero``: such a class stays with 0. ``zero_where`` applies ``zero``
    to the classes it selects and ``sem_policy`` to the others.
    """
    if sem_policy not in ("omit", "zero"):
        raise ValueError(f"unknown sem_policy {sem_policy!r}")
    by = list(by)
    keep = F.lit(sem_policy == "zero")
    if zero_where is not None:
        keep = keep | zero_where
    out = present(summary, by).groupBy(*by).agg(
        F.sum(mean).alias("mean"), F.sum(sem).alias("sem")
    )
    return out.filter(F.col("mean").isNotNull() & (F.col("sem").isNotNull() | keep)).withColumn(
        "sem", F.coalesce("sem", F.lit(0.0))
    )


@any_names
def pool_summaries(summary: DataFrame, by: Sequence[str], mean: str = "mean", sem: str = "sem") -> DataFrame:
    """Mean and standard error of several groups taken together, from their summaries.

    The same numbers as a :func:`mean_sem` over the pooled rows, without reading
    them again.
    """
    by = list(by)
    rows = summary.select(
        *by,
        F.col("n"),
        F.col(mean).alias("_m"),
        # Sum of squares around the group's own mean; a group of one has none.
        (F.coalesce(F.col(sem), F.lit(0.0)) ** 2 * F.col("n") * (F.col("n") - 1)).alias("_ss"),
    )
    # Around the mean of everything, so that no group has to wait for its own centre.
    shared = summary.agg(F.sum(F.col("n") * F.col(mean)) / F.sum("n")).scalar()
    off = F.col("_m") - F.coalesce(shared, F.lit(0.0))
    sums = rows.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * off).alias("_off"),
        F.sum(F.col("n") * off * off).alias("_off2"),
        F.sum("_ss").alias("_within"),
    )
    centre = F.coalesce(shared, F.lit(0.0)) + F.col("_off") / F.col("n")
    between = F.greatest(F.lit(0.0), F.col("_off2") - F.col("_off") * F.col("_off") / F.col("n"))
    variance = (F.col("_within") + between) / F.nullif(F.col("n") - 1, F.lit(0))
    return sums.select(
        *by,
        "n",
        centre.alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(variance / F.col("n"))).alias("sem"),
    )


def null_sum(v: Column, policy: str) -> Column:
    """Sum of values under a null policy.

    ``omit``: nulls do not count. ``zero``: the same, but nothing sums to 0.
    ``strict``: one null makes the sum null.
    """
    total = F.sum(v)
    if policy == "omit":
        return total
    if policy == "zero":
        return F.coalesce(total, F.lit(0))
    if policy == "strict":
        return F.when(F.count(F.lit(1)) == F.count(v), total)
    raise ValueError(f"unknown null policy {policy!r}")


@any_names
def group_sum(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], null_policy: str = "strict"
) -> DataFrame:
    """Sum of several columns per group; a missing group key is a group, NaN is missing."""
    return df.groupBy(*by).agg(*[null_sum(filled(df, c), null_policy).alias(c) for c in cols])


@any_names
def add_co2_equivalent(
    df: DataFrame, gas_col: str, value_cols: Sequence[str], suffix: str = "_co2eq"
) -> DataFrame:
    """Add CO2-equivalent copies of columns."""
    return df.withColumns({f"{c}{suffix}": co2_equivalent(c, gas_col) for c in value_cols})


@any_names
def to_co2_equivalent(
    df: DataFrame, gas_col: str, value_col: str, gwp: Mapping[str, float] = K.GWP
) -> DataFrame:
    """Weight a value by the warming potential of its gas."""
    return df.withColumn(value_col, F.col(value_col) * by_key(gas_col, gwp))


@any_names
def from_co2_equivalent(
    df: DataFrame, gas_col: str, value_col: str, gwp: Mapping[str, float] = K.GWP
) -> DataFrame:
    """Undo :func:`to_co2_equivalent`."""
    return df.withColumn(value_col, F.col(value_col) / by_key(gas_col, gwp))


@any_names
def annual_emission(
    df: DataFrame,
    key: str,
    value_cols: Sequence[str],
    areas: Mapping[str, float] = K.AREAS,
    suffix: str = "_gg_yr",
) -> DataFrame:
    """Gg per year from mg per m2 and day and the area of each key (km2)."""
    return df.withColumns(
        {f"{c}{suffix}": per_year(c, by_key(key, areas)) for c in value_cols}
    )


@any_names
def rescale(df: DataFrame, cols: Sequence[str], k: float) -> DataFrame:
    """Divide columns by a constant."""
    return df.withColumns({c: F.col(c) / F.lit(float(k)) for c in cols})


@any_names
def symbol_size(
    df: DataFrame, cols: Sequence[str], k: float = 60.0, shared_max: bool = False, suffix: str = "_size"
) -> DataFrame:
    """Marker size ``k * sqrt(z) / sqrt(max z)``.

    The maximum is taken per column, or over all columns with ``shared_max``; it is
    read as a scalar subquery. Negative and missing values have no size.
    """
    tops = [F.max(number(c)) for c in cols]
    if shared_max:
        tops = [F.greatest(*tops) if len(tops) > 1 else tops[0]] * len(cols)
    top = df.agg(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tops)])).scalar()

    def size(i: int, c: str) -> Column:
        v = number(c)
        ok = (v >= 0) & (top[f"t{i}"] > 0)
        return F.when(ok, F.lit(float(k)) * F.sqrt(v) / F.sqrt(top[f"t{i}"]))

    return df.withColumns({f"{c}{suffix}": size(i, c) for i, c in enumerate(cols)})


@any_names
def overall_mean_sem(
    df: DataFrame,
    gas_col: str,
    value_col: str,
    areas: Mapping[str, float] = K.AREAS,
) -> DataFrame:
    """Mean and standard error per gas over all sites, with yearly totals.

    Totals are for the whole basin, plain and in CO2-equivalent.
    """
    return basin_totals(mean_sem(df, [gas_col], value_col), gas_col, areas)


@any_names
def basin_totals(summary: DataFrame, gas_col: str, areas: Mapping[str, float]) -> DataFrame:
    """CO2-equivalents of mean and SEM, and both per year over the whole area."""
    area = float(sum(areas.values()))
    out = add_co2_equivalent(summary.drop("lower", "upper"), gas_col, ["mean", "sem"])
    return out.withColumns(
        {f"{c}_gg_yr": per_year(c, area) for c in ("mean", "sem", "mean_co2eq", "sem_co2eq")}
    )


@any_names
def category_count(df: DataFrame, col: str, facet: str | None = None) -> DataFrame:
    """Rows per category, optionally within facets."""
    keys = [facet, col] if facet else [col]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@any_names
def category_counts(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """:func:`category_count` of several columns in one job, named in ``variable``."""
    lines = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("category")) for c in cols]
    long = df.select(F.col(f"`{group}`"), F.inline(F.array(*lines)))
    return long.groupBy(F.col(f"`{group}`"), "variable", "category").agg(F.count(F.lit(1)).alias("n"))


@any_names
def contingency_share(df: DataFrame, x: str, fill: str) -> DataFrame:
    """Two-way table with the share inside each ``x`` and the share of ``x`` in all.

    The second is the column width of a mosaic plot. The windows run on the counted
    table.
    """
    counts = df.groupBy(x, fill).agg(F.count(F.lit(1)).alias("n"))
    rows_of_x = F.sum("n").over(Window.partitionBy(x))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumns({"share": F.col("n") / rows_of_x, "width": rows_of_x / total})


@any_names
def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Number of distinct non-null values."""
    count = F.approx_count_distinct(col) if approx else F.count_distinct(F.col(col))
    return df.agg(count.alias("n_distinct")).withColumn("variable", F.lit(col))


@any_names
def distinct_sketches(df: DataFrame, groups: Sequence[str], col: str, lg_k: int = 12) -> DataFrame:
    """One mergeable sketch of the distinct non-null values per group: groups, ``sketch`` (binary).

    NaN is missing. Counts from it are within a few times 1 / 2 ** (lg_k / 2), and right or
    nearly so for few values. Parts to be merged must have the column as the same type.
    """
    value = filled(df, col)
    if not isinstance(df.schema[col].dataType, (T.IntegralType, T.StringType, T.BinaryType)):
        value = (number(col) if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)) else value).cast("string")
    return df.groupBy(*groups).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


@any_names
def merge_distinct_sketches(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of parts as one per coarser group; values that parts share count once."""
    return sketches.groupBy(*groups).agg(F.hll_union_agg("sketch").alias("sketch"))


@any_names
def sketched_distinct(sketches: DataFrame) -> DataFrame:
    """The sketches' counts as ``n_distinct``."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


@any_names
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The distinct non-null values, one per row, in order."""
    return df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


@any_names
def share_of_total(
    df: DataFrame, by: Sequence[str], value: str, extra: Sequence[str] = (), suffix: str = "_pct"
) -> DataFrame:
    """Percent of the group's total of ``value``, for ``value`` and ``extra`` columns.

    Meant for summary tables: the extra columns (standard errors) are divided by the
    total of ``value``, not by their own.
    """
    total = F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0.0))
    return df.withColumns({f"{c}{suffix}": F.col(c) * 100 / total for c in (value, *extra)})


@any_names
def emission_share(
    df: DataFrame, by: str, cols: Sequence[str], areas: Mapping[str, float] = K.AREAS
) -> DataFrame:
    """Per key and variable: sum, fraction of all sums, yearly amount and its percent.

    The yearly amount is ``sum * 365 * area``; one missing value makes the sum of its
    key missing, and with it the shares of that variable. The totals are one row, read
    as a scalar subquery, so the number of keys does not matter.
    """
    sums = group_sum(df, [by], cols, "strict")
    per_area = F.lit(K.DAYS_PER_YEAR) * by_key(by, areas)
    wide = sums.select(
        by,
        *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(cols)],
        *[(F.col(c) * per_area).alias(f"_a{i}") for i, c in enumerate(cols)],
    )
    names = [f"_{k}{i}" for k in "sa" for i in range(len(cols))]
    total = wide.agg(F.struct(*[null_sum(F.col(c), "strict").alias(c) for c in names])).scalar()
    lines = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"_s{i}").alias("flux_sum"),
            F.col(f"_a{i}").alias("flux_area"),
            (F.col(f"_s{i}") / F.nullif(total[f"_s{i}"], F.lit(0.0))).alias("fraction"),
            (F.col(f"_a{i}") * 100 / F.nullif(total[f"_a{i}"], F.lit(0.0))).alias("area_percent"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(by, F.inline(F.array(*lines)))
