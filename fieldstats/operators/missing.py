"""Missing data: patterns, shares, margins and mean imputation. NaN is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.names import any_names
from fieldstats.operators.distribution import box_stats
from fieldstats.operators.positions import filled


@any_names
def missing_pattern(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct present (1) / missing (0) masks with their row counts."""
    masks = {f"has_{c}": filled(df, c).isNotNull().cast("int") for c in cols}
    present = sum((F.col(f"`{m}`") for m in masks), F.lit(0))
    return (
        df.select(*[e.alias(m) for m, e in masks.items()])
        .groupBy(*[F.col(f"`{m}`") for m in masks])
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_missing", F.lit(len(cols)) - present)
    )


@any_names
def missing_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count and share of each column, most missing first."""
    sums = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(filled(df, c)).alias(f"_n{i}") for i, c in enumerate(cols)],
    )
    entries = [
        F.struct(F.lit(c).alias("variable"), (F.col("_rows") - F.col(f"_n{i}")).alias("n_missing"))
        for i, c in enumerate(cols)
    ]
    return (
        sums.select("_rows", F.inline(F.array(*entries)))
        .select(
            "variable",
            "n_missing",
            (F.col("n_missing") / F.nullif(F.col("_rows"), F.lit(0))).alias("share"),
        )
        .orderBy(F.desc("n_missing"), "variable")
    )


@any_names
def margin_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distribution of ``x`` where ``y`` is missing and where it is present.

    Each row also carries how many rows miss x only, y only and both.
    """
    no_x, no_y = filled(df, x).isNull(), filled(df, y).isNull()
    status = F.when(no_y, "missing").otherwise("present")
    boxes = box_stats(df.select(F.col(f"`{x}`"), status.alias("other")), ["other"], x)
    counts = df.agg(
        F.struct(
            F.count_if(no_x & ~no_y).alias("x_only"),
            F.count_if(~no_x & no_y).alias("y_only"),
            F.count_if(no_x & no_y).alias("both"),
        )
    ).scalar()
    return boxes.select(
        "*",
        counts["x_only"].alias("missing_x_only"),
        counts["y_only"].alias("missing_y_only"),
        counts["both"].alias("missing_both"),
    )


@any_names
def impute_mean(
    df: DataFrame, cols: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Replace missing values of numeric columns by the column mean.

    ``cols`` are all numeric columns where it is not given, without those in ``keep``.
    They become double, as a mean is one; keys belong into ``keep``, where they stay
    as they are, like columns of other types. The means are one row, read as a scalar
    subquery.
    """
    numeric = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType)
        and (f.name in cols if cols is not None else f.name not in keep)
    ]
    if not numeric:
        return df
    means = df.agg(
        F.struct(*[F.avg(filled(df, c)).alias(f"m{i}") for i, c in enumerate(numeric)])
    ).scalar()
    return df.withColumns(
        {
            c: F.coalesce(filled(df, c).cast("double"), means[f"m{i}"])
            for i, c in enumerate(numeric)
        }
    )
