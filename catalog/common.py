"""Loading, rounding and the survey view shared by the registered queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every floating column so that both engines print the same number."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with nulls by rule, as the tables have none."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_tax": F.when(F.col("l_linenumber") % 7 != 0, F.col("l_tax")),
            "l_discount": F.when(F.col("l_suppkey") % 11 != 0, F.col("l_discount")),
        }
    )


GAPPY = """gappy AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN l_suppkey % 11 <> 0 THEN l_discount END AS l_discount,
         CASE WHEN l_linenumber % 7 <> 0 THEN l_tax END AS l_tax,
         l_returnflag, l_linestatus
  FROM lineitem)"""

# The tables seen as a river survey: market segments are rivers, order priorities and
# line flags are quality classes, supplier and part numbers pick land uses.
LAND_USES = [
    "Arable", "Construction", "Factory", "Forest", "Mining",
    "Orchard", "Resident", "River", "Road", "Urban",
]
PRATI_OF_PRIORITY = {
    "5": "Good Quality",
    "4": "Acceptable Quality",
    "3": "Polluted",
    "2": "Heavily Polluted",
    "1": "Very Heavily Polluted",
}
AREAS = {
    "AUTOMOBILE": 95.92,
    "BUILDING": 111.19,
    "FURNITURE": 138.98,
    "HOUSEHOLD": 113.03,
    "MACHINERY": 113.81,
}
FLUX = {"CO2": "f_co2", "CH4": "f_ch4", "N2O": "f_n2o"}
DISSOLVED = {"CO2": "d_co2", "CH4": "d_ch4", "N2O": "d_n2o"}
PPM = {"N2O": "ppm_n2o", "CH4": "ppm_ch4", "CO2": "ppm_co2"}
INDEXES = {"Prati Index": "prati", "Oregon Index": "oregon"}
BANKS = {"Left Bank": "lb", "Right Bank": "rb"}


def _pick(number, values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order and customer, under the survey's column names."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        customers, orders.o_custkey == customers.c_custkey
    )
    digit = F.substring("o_orderpriority", 1, 1)
    prati = F.lit(None).cast("string")
    for d, name in PRATI_OF_PRIORITY.items():
        prati = F.when(digit == d, name).otherwise(prati)
    first, good = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    oregon = (
        F.when(first & good, "Good").when(first, "Fair").when(good, "Poor").otherwise("Very Poor")
    )
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"),
        F.col("c_mktsegment").alias("river"),
        prati.alias("prati"),
        oregon.alias("oregon"),
        _pick(F.col("l_suppkey") % 10, LAND_USES).alias("lb"),
        _pick(F.col("l_partkey") % 10, LAND_USES).alias("rb"),
        (F.col("l_extendedprice") / 100).alias("f_co2"),
        F.col("l_quantity").alias("f_ch4"),
        F.col("l_discount").alias("f_n2o"),
        (F.col("l_extendedprice") / 10).alias("d_co2"),
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity") / 10).alias("d_ch4"),
        (F.col("l_discount") * 20 + 0.5).alias("d_n2o"),
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity") / 5 + 10).alias("t_w"),
        (F.col("l_extendedprice") / 50).alias("ppm_co2"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_quantity") * 3).alias("ppm_ch4"),
        (F.col("l_tax") * 100 + 1).alias("ppm_n2o"),
        (F.col("l_tax") * 100).alias("DO"),
        (F.col("l_discount") * 10).alias("NH4"),
        F.col("l_tax").alias("NO2"),
        F.col("l_quantity").alias("COD"),
        (F.col("l_quantity") / 50).alias("Velocity"),
        (F.col("l_extendedprice") / 1000).alias("Depth"),
    )


def _case(expr: str, values: Mapping[str, str]) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {expr} {body} END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SURVEY = f"""survey AS (
  SELECT l_orderkey * 10 + l_linenumber AS site, c_mktsegment AS river,
    {_case("substr(o_orderpriority, 1, 1)", PRATI_OF_PRIORITY)} AS prati,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Good'
         WHEN l_returnflag = 'A' THEN 'Fair'
         WHEN l_linestatus = 'F' THEN 'Poor' ELSE 'Very Poor' END AS oregon,
    ({_list(LAND_USES)})[l_suppkey % 10 + 1] AS lb,
    ({_list(LAND_USES)})[l_partkey % 10 + 1] AS rb,
    l_extendedprice / 100 AS f_co2, l_quantity AS f_ch4, l_discount AS f_n2o,
    l_extendedprice / 10 AS d_co2,
    CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity / 10 END AS d_ch4,
    l_discount * 20 + 0.5 AS d_n2o,
    CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity / 5 + 10 END AS t_w,
    l_extendedprice / 50 AS ppm_co2,
    CASE WHEN l_suppkey % 11 <> 0 THEN l_quantity * 3 END AS ppm_ch4,
    l_tax * 100 + 1 AS ppm_n2o,
    l_tax * 100 AS "DO", l_discount * 10 AS "NH4", l_tax AS "NO2", l_quantity AS "COD",
    l_quantity / 50 AS "Velocity", l_extendedprice / 1000 AS "Depth"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey)"""


def sql_case(expr: str, values: Mapping[str, float | str]) -> str:
    """A CASE over literal keys; numbers stay doubles."""
    body = " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)")
        for k, v in values.items()
    )
    return f"CASE {expr} {body} END"
