"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldstats.names import any_names, make_names
from fieldstats.operators.positions import filled


def read_survey(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "csv",
    bad_cells: str = "fail",
    check_names: bool = False,
) -> DataFrame:
    """Read a survey with an explicit schema.

    CSV files have a header, ``NA`` means missing and dates are ``dd/MM/yyyy``.
    Parquet files are projected to the columns of ``schema`` and cast to its types.
    A CSV cell that its type cannot hold ends the read; with ``bad_cells="keep"`` it
    becomes null and the whole line is in the column ``_bad_line``.

    ``check_names`` repairs the header's names as base R does (:func:`make_names`):
    ``schema`` then has repaired names, in any order and not necessarily all of them. All files of
    a path have the header of the first.
    """
    if fmt == "csv":
        if bad_cells not in ("fail", "keep"):
            raise ValueError(f"unknown treatment of bad cells {bad_cells!r}")
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        wanted = schema.names
        if check_names:
            first = spark.read.option("header", False).option("nullValue", None).csv(path).first()
            header = make_names([c or "" for c in first] if first else [])
            missing = [c for c in wanted if c not in header]
            if missing:
                raise ValueError(f"no such columns: {missing}; the file has {header}")
            schema = T.StructType([schema[c] if c in wanted else T.StructField(c, T.StringType()) for c in header])
        if bad_cells == "keep":
            wanted = [*wanted, "_bad_line"]
            schema = T.StructType([*schema, T.StructField("_bad_line", T.StringType())])
        df = (
            spark.read.schema(schema)
            .option("mode", "FAILFAST" if bad_cells == "fail" else "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad_line")
            .option("header", True)
            .option("nullValue", "NA")
            .option("dateFormat", "dd/MM/yyyy")
            .option("enforceSchema", bad_cells == "keep" or check_names)
            .csv(path)
        )
        return df.select(*[F.col(f"`{c}`") for c in wanted]) if check_names else df
    df = spark.read.format(fmt).load(path)
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a result, one file per partition; nothing passes through the driver."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").option(
            "dateFormat", "dd/MM/yyyy"
        ).csv(path)
    else:
        writer.format(fmt).save(path)


def lookup_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A dictionary table from literal rows.

    The rows become a local relation, whose size Catalyst knows exactly, so a join
    with it is broadcast without a hint.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=schema)


@any_names
def table_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and number of values that are not missing."""
    names = df.columns
    counts = df.agg(*[F.count(filled(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


@any_names
def preview(df: DataFrame, order_by: str | Sequence[str], n: int = 5, last: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows in the order of the given columns."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    order = [F.col(k).desc() if last else F.col(k).asc() for k in keys]
    return df.orderBy(*order).limit(n)
