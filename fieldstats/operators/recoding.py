"""Whole-value recodes and ordered levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.names import any_names
from fieldstats.sources.io import lookup_table


@any_names
def recode_exact(
    df: DataFrame,
    col: str,
    mapping: Mapping[str, str],
    into: str | None = None,
    default: str | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Replace whole values by a dictionary.

    A value outside the dictionary becomes ``default``, or stays as it is with
    ``keep_unmatched``.
    """
    into = into or col
    table = lookup_table(df.sparkSession, list(mapping.items()), "_from string, _to string")
    joined = df.join(table, F.col(f"`{col}`") == F.col("_from"), "left")
    other = F.col(f"`{col}`") if keep_unmatched else F.lit(default)
    return joined.withColumn(into, F.coalesce(F.col("_to"), other)).drop("_from", "_to")


@any_names
def order_levels(
    df: DataFrame,
    col: str,
    levels: Sequence[str],
    labels: Sequence[str] | None = None,
    ord_col: str = "ord",
) -> DataFrame:
    """Give a category an explicit order.

    Adds the 1-based position of the level as ``ord_col`` and replaces the value by
    its label. Values outside ``levels`` become null in both.
    """
    labels = list(labels) if labels is not None else list(levels)
    if len(labels) != len(levels):
        raise ValueError("one label for each level")
    rows = [(v, i, lab) for i, (v, lab) in enumerate(zip(levels, labels), start=1)]
    table = lookup_table(df.sparkSession, rows, "_level string, _ord int, _label string")
    joined = df.join(table, F.col(f"`{col}`") == F.col("_level"), "left")
    return joined.withColumns({col: F.col("_label"), ord_col: F.col("_ord")}).drop(
        "_level", "_ord", "_label"
    )
