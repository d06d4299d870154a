"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import rounded, table
from fieldstats.operators import joins as J
from fieldstats.sources.io import lookup_table

SEGMENTS = [("AUTOMOBILE", "road"), ("BUILDING", "site"), ("SHIPS", "sea"), ("HOUSEHOLD", "home")]


def left_lookup(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("nation")
    )
    nations = table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("nation"), "n_name"
    )
    return J.left_lookup(suppliers, nations, "nation")


def right_lookup(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    names = lookup_table(spark, SEGMENTS, "c_mktsegment string, place string")
    return J.right_lookup(customers, names, "c_mktsegment")


def inner_on_keys(spark, sf_dir) -> DataFrame:
    spent = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("custkey"))
        .agg(F.avg("o_totalprice").alias("amount"))
    )
    balance = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount")
    )
    return rounded(J.inner_on_keys(spent, balance, ["custkey"]))


def align_by_key(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    spent = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return J.align_by_key(
        orders.select("o_orderkey", "o_totalprice"),
        spent.withColumnRenamed("l_orderkey", "o_orderkey"),
        "o_orderkey",
    )


QUERIES = {
    "left_lookup": left_lookup,
    "right_lookup": right_lookup,
    "inner_on_keys": inner_on_keys,
    "align_by_key": align_by_key,
}

ORACLES = {
    "left_lookup": """SELECT s_suppkey, s.nation, n_name
      FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS nation FROM supplier) s
      LEFT JOIN (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS nation, n_name FROM nation) n
        ON s.nation IS NOT DISTINCT FROM n.nation""",
    "right_lookup": """SELECT c_custkey, c_acctbal, l.c_mktsegment, place FROM customer c
      RIGHT JOIN (VALUES ('AUTOMOBILE', 'road'), ('BUILDING', 'site'), ('SHIPS', 'sea'),
        ('HOUSEHOLD', 'home')) l(c_mktsegment, place) ON c.c_mktsegment = l.c_mktsegment""",
    "inner_on_keys": """SELECT o_custkey AS custkey, round(avg(o_totalprice), 6) AS amount_x,
      round(any_value(c_acctbal), 6) AS amount_y
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""",
    "align_by_key": """SELECT o_orderkey, o_totalprice, n_lines FROM orders
      JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
}
