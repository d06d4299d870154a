"""Choosing, naming and typing columns; filters; sorts; stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.names import any_names


@any_names
def select_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])


@any_names
def drop_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    names = df.columns
    start, stop = names.index(first), names.index(last)
    if start > stop:
        raise ValueError(f"{first!r} comes after {last!r}")
    return names[start : stop + 1]


@any_names
def select_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return select_cols(df, columns_between(df, first, last))


def rename_cols(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumnsRenamed(dict(mapping))


@any_names
def reorder_cols(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same columns in another order."""
    if sorted(order) != sorted(df.columns):
        raise ValueError("the order must name every column exactly once")
    return select_cols(df, order)


@any_names
def cast_category(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Treat columns as categories: trimmed text."""
    return df.withColumns({n: F.trim(F.col(f"`{n}`").cast("string")) for n in names})


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


@any_names
def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which every one of ``cols`` is present."""
    return df.dropna(subset=list(cols))


@any_names
def significant_only(tests: DataFrame, p_col: str = "p_adjusted", alpha: float = 0.05) -> DataFrame:
    """Test rows at or under ``alpha``; a missing p is not significant."""
    return tests.filter(F.col(p_col) <= F.lit(alpha))


@any_names
def sort_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ascending global sort, for final output only."""
    return df.orderBy(*keys)


def stack_with_id(named: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """Append tables and write each one's name into ``id_col``."""
    parts = [df.withColumn(id_col, F.lit(name)) for name, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
