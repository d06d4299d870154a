"""Wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.names import any_names


@any_names
def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    name: str = "variable",
    value: str = "value",
) -> DataFrame:
    """Columns to (name, value) rows; id columns and null values are kept.

    Numeric columns of different types are widened to double.
    """
    types = {df.schema[v].dataType for v in values}
    if len(types) > 1:
        df = df.withColumns({v: F.col(v).cast("double") for v in values})
    return df.select(*ids, *values).unpivot(list(ids), list(values), name, value)


@any_names
def to_long_twice(
    df: DataFrame,
    measure_cols: Sequence[str],
    label_cols: Sequence[str],
    measure: str = "variable",
    value: str = "value",
    label_name: str = "label",
    label_value: str = "category",
    ids: Sequence[str] = (),
) -> DataFrame:
    """Unpivot measures and then label columns.

    Every measured value appears once for each label column.
    """
    ids = list(ids)
    long = to_long(df, [*ids, *label_cols], measure_cols, measure, value)
    return to_long(long, [*ids, measure, value], label_cols, label_name, label_value)
