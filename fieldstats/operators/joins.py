"""Dictionary joins, key joins and joins with per-group statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.names import any_names

def _lookup_side(lookup: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column, list[str]]:
    """The dictionary with renamed keys, the null-safe condition and those key names."""
    names = {k: f"_lk_{k}" for k in on}
    cond = reduce(
        lambda a, b: a & b,
        [F.col(f"`{k}`").eqNullSafe(F.col(f"`{r}`")) for k, r in names.items()],
    )
    return lookup.withColumnsRenamed(names), cond, list(names.values())


@any_names
def left_lookup(df: DataFrame, lookup: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to a dictionary in which a missing key matches a missing key.

    The size of the dictionary decides the strategy: Catalyst broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    on = [on] if isinstance(on, str) else list(on)
    table, cond, extra = _lookup_side(lookup, on)
    return df.join(table, cond, "left").drop(*extra)


@any_names
def right_lookup(df: DataFrame, lookup: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Right join to a dictionary.

    Rows whose key is not listed are dropped; dictionary rows that nothing uses are
    kept with nulls. A right outer join cannot broadcast its preserved side, so the
    matched part is an inner join and the unused rows come from an anti join with
    the (distinct) keys in use.
    """
    on = [on] if isinstance(on, str) else list(on)
    table, cond, extra = _lookup_side(lookup, on)
    matched = df.join(table, cond, "inner").drop(*extra)
    used, _, _ = _lookup_side(df.select(*on).distinct(), on)
    unused = lookup.join(used, cond, "left_anti")
    return matched.unionByName(unused, allowMissingColumns=True).select(*matched.columns)


@any_names
def inner_on_keys(
    a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Inner join on key columns; measures present in both get a suffix."""
    keys = list(keys)
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    a = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, keys, "inner")


def _one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.any_value(F.col(f"`{c}`")).alias(c) for c in others]
    )
    checked = F.when(
        F.col("_rows") > 1,
        F.raise_error(F.concat(F.lit(f"duplicate key in {key}: "), F.col(key).cast("string"))),
    ).otherwise(F.col(key))
    return grouped.withColumn(key, checked).drop("_rows").select(*df.columns)


@any_names
def align_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Put two tables side by side, one row of each per key.

    A key that occurs twice on either side is an error. The check shares the
    shuffle of the join, and duplicates are folded before it.
    """
    return _one_row_per_key(a, key).join(_one_row_per_key(b, key), key, "inner")


def join_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of data rows with one statistics row per key, in one pass over both.

    The keys are joined as one value, so both sides get an exchange of their own and
    adaptive execution can split the rows of a hot key among tasks (repeating its one
    statistics row), or broadcast the statistics when they turn out small.
    """
    keys = list(keys)
    one = F.struct(*[F.col(f"`{k}`") for k in keys])
    right = stats.withColumn("_join", one).drop(*keys)
    return rows.withColumn("_join", one).join(right, "_join").drop("_join")
