"""Sources, sinks, columns, filters, recodes and reshaping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.common import gappy_lineitem, rounded, table, GAPPY
from fieldstats.functions.recode import replace_sequence
from fieldstats.operators import columns as C
from fieldstats.operators.recoding import order_levels, recode_exact
from fieldstats.operators.reshape import to_long, to_long_twice
from fieldstats.sources import io

CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
PRIORITY_CLASS = {
    "1-URGENT": "Very Heavily Polluted",
    "2-HIGH": "Heavily Polluted",
    "3-MEDIUM": "Polluted",
    "4-NOT SPECIFIED": "Acceptable Quality",
}
# The harmful order: "Polluted" is replaced inside the longer names.
REVERSED_PAIRS = [
    ("Acceptable Quality", "Good"),
    ("Polluted", "Fair"),
    ("Very Heavily Polluted", "Very Poor"),
    ("Heavily Polluted", "Poor"),
]
NAME_PAIRS = [("bolt", "rod"), ("rod", "ring"), ("(red|blue) ", "coloured "), ("old", "aged")]


LINE_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or a local one where none is configured."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fieldstats-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def read_survey(spark, sf_dir) -> DataFrame:
    return io.read_survey(spark, f"{sf_dir}/customer.parquet", CUSTOMER_SCHEMA, "parquet")


def read_survey_csv(spark, sf_dir) -> DataFrame:
    """Through a CSV file with gaps, in which one cell in seven is no number."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n.d.")).when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    io.write_table(rows, path)
    back = io.read_survey(spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double", bad_cells="keep")
    return back.select("c_custkey", "c_mktsegment", "c_acctbal", F.col("_bad_line").isNotNull().alias("bad"))


def write_table(spark, sf_dir) -> DataFrame:
    path = shared_folder(spark)
    rows = read_survey(spark, sf_dir).withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    )
    io.write_table(rows, path)
    return io.read_survey(spark, path, CUSTOMER_SCHEMA)


def lookup_table(spark, sf_dir) -> DataFrame:
    urgency = io.lookup_table(
        spark,
        [("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)],
        "o_orderpriority string, urgency int",
    )
    joined = table(spark, sf_dir, "orders").join(urgency, "o_orderpriority")
    return joined.groupBy("urgency").agg(F.count(F.lit(1)).alias("n"))


def preview(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return io.preview(orders, "o_orderkey", 5)


def preview_last(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return io.preview(orders, "o_orderkey", 5, last=True)


def table_schema(spark, sf_dir) -> DataFrame:
    return io.table_schema(gappy_lineitem(spark, sf_dir).select(*LINE_TYPES))


def select_cols(spark, sf_dir) -> DataFrame:
    return C.select_cols(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


def drop_cols(spark, sf_dir) -> DataFrame:
    return C.drop_cols(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderstatus"])


def select_range(spark, sf_dir) -> DataFrame:
    return C.select_range(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_tax")


def rename_cols(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return C.rename_cols(part, {"p_partkey": "part", "p_retailprice": "price"})


def reorder_cols(spark, sf_dir) -> DataFrame:
    order = ["p_type", "p_partkey", "p_retailprice", "p_size", "p_brand", "p_name"]
    return C.reorder_cols(table(spark, sf_dir, "part"), order)


def cast_category(spark, sf_dir) -> DataFrame:
    labels = C.cast_category(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"])
    return labels


def filter_rows(spark, sf_dir) -> DataFrame:
    condition = (F.col("o_totalprice") < 200000) & (F.col("o_orderstatus") == "F")
    return C.filter_rows(table(spark, sf_dir, "orders"), condition).select(
        "o_orderkey", "o_totalprice"
    )


def complete_cases(spark, sf_dir) -> DataFrame:
    rows = gappy_lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity"
    )
    return C.complete_cases(rows, ["l_discount", "l_tax"])


def sort_rows(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return C.sort_rows(suppliers, ["s_nationkey", "s_acctbal"])


def stack_with_id(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal")
    )
    return C.stack_with_id({"supplier": suppliers, "customer": customers}, "source")


def replace_in_names(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", replace_sequence("p_name", NAME_PAIRS).alias("name"))


def replace_reversed(spark, sf_dir) -> DataFrame:
    classes = recode_exact(
        table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITY_CLASS, "class", "Good Quality"
    )
    return classes.select(
        "o_orderkey", replace_sequence("class", REVERSED_PAIRS).alias("label")
    )


def recode_whole(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return recode_exact(orders, "o_orderpriority", PRIORITY_CLASS, "class")


def ordered_levels(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    levels = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return order_levels(orders, "o_orderpriority", levels, ["low", "medium", "high", "urgent"])


def long_part(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn(
        "p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    )
    return to_long(part, ["p_partkey"], ["p_size", "p_retailprice"])


def long_twice(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return to_long_twice(
        orders,
        ["o_totalprice", "o_custkey"],
        ["o_orderstatus", "o_orderpriority"],
        ids=["o_orderkey"],
    )


QUERIES = {
    "read_survey": read_survey,
    "read_survey_csv": read_survey_csv,
    "write_table": write_table,
    "lookup_table": lookup_table,
    "preview": preview,
    "preview_last": preview_last,
    "table_schema": table_schema,
    "select_cols": select_cols,
    "drop_cols": drop_cols,
    "select_range": select_range,
    "rename_cols": rename_cols,
    "reorder_cols": reorder_cols,
    "cast_category": cast_category,
    "filter_rows": filter_rows,
    "complete_cases": complete_cases,
    "sort_rows": sort_rows,
    "stack_with_id": stack_with_id,
    "replace_sequence": replace_in_names,
    "replace_sequence_reversed": replace_reversed,
    "recode_exact": recode_whole,
    "order_levels": ordered_levels,
    "to_long": long_part,
    "to_long_twice": long_twice,
}


def _nested_replace(column: str, pairs) -> str:
    for pattern, text in pairs:
        column = f"regexp_replace({column}, '{pattern}', '{text}', 'g')"
    return column


_CLASS = "CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_CLASS.items()
)

ORACLES = {
    "read_survey": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "write_table": """SELECT c_custkey, c_name,
      CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer""",
    "lookup_table": """SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS urgency,
      count(*) AS n FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""",
    "preview": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
    "preview_last": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
      ORDER BY o_orderkey DESC LIMIT 5""",
    "table_schema": f"WITH {GAPPY} " + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM gappy"
        for i, (c, t) in enumerate(LINE_TYPES.items())
    ),
    "select_cols": "SELECT o_orderkey, o_totalprice FROM orders",
    "drop_cols": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
    "select_range": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_tax FROM lineitem""",
    "rename_cols": """SELECT p_partkey AS part, p_name, p_brand, p_type, p_size,
      p_retailprice AS price FROM part""",
    "reorder_cols": "SELECT p_type, p_partkey, p_retailprice, p_size, p_brand, p_name FROM part",
    "cast_category": "SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings",
    "filter_rows": """SELECT o_orderkey, o_totalprice FROM orders
      WHERE o_totalprice < 200000 AND o_orderstatus = 'F'""",
    "complete_cases": f"""WITH {GAPPY}
      SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity FROM gappy
      WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""",
    "sort_rows": """SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier
      ORDER BY s_nationkey, s_acctbal""",
    "stack_with_id": """SELECT s_suppkey AS key, s_acctbal AS acctbal, 'supplier' AS source FROM supplier
      UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer""",
    "replace_sequence": f"SELECT p_partkey, {_nested_replace('p_name', NAME_PAIRS)} AS name FROM part",
    "replace_sequence_reversed": f"""SELECT o_orderkey,
      {_nested_replace("class", REVERSED_PAIRS)} AS label
      FROM (SELECT o_orderkey, {_CLASS} ELSE 'Good Quality' END AS class FROM orders)""",
    "recode_exact": f"SELECT o_orderkey, o_orderpriority, {_CLASS} END AS class FROM orders",
    "order_levels": """SELECT o_orderkey,
      CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '3-MEDIUM' THEN 'medium'
        WHEN '2-HIGH' THEN 'high' WHEN '1-URGENT' THEN 'urgent' END AS o_orderpriority,
      CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2
        WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS ord FROM orders""",
    "to_long": """SELECT p_partkey, 'p_size' AS variable,
        CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS value FROM part
      UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
    "to_long_twice": """WITH m AS (
        SELECT o_orderkey, o_orderstatus, o_orderpriority, 'o_totalprice' AS variable,
               o_totalprice AS value FROM orders
        UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, 'o_custkey',
               CAST(o_custkey AS DOUBLE) FROM orders)
      SELECT o_orderkey, variable, value, 'o_orderstatus' AS label, o_orderstatus AS category FROM m
      UNION ALL SELECT o_orderkey, variable, value, 'o_orderpriority', o_orderpriority FROM m""",
}
ORACLES["read_survey_csv"] = """SELECT c_custkey, c_mktsegment,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, c_custkey % 7 = 0 AS bad FROM customer"""
