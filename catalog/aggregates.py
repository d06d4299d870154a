"""Grouped summaries, distributions and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import AREAS, GAPPY, VARIABLES, gappy_lineitem, rounded, sql_case, table
from catalog.gaps import box_sql
from fieldstats.operators import distribution as D
from fieldstats.operators import summary as S
from fieldstats.operators.ranks import mid_rank
from fieldstats.operators.reshape import to_long

GAS_OF_STATUS = {"P": "CO2", "F": "CH4", "O": "N2O"}


def mean_sem(spark, sf_dir) -> DataFrame:
    long = to_long(gappy_lineitem(spark, sf_dir), ["l_returnflag"], VARIABLES)
    return rounded(S.mean_sem(long, ["l_returnflag", "variable"], "value"))


def mean_sem_wide(spark, sf_dir) -> DataFrame:
    wide = {v: v for v in VARIABLES}
    return rounded(S.mean_sem_wide(gappy_lineitem(spark, sf_dir), ["l_returnflag"], wide))


def _single_gaps(spark, sf_dir) -> DataFrame:
    """Mean prices where some classes have no standard error."""
    orders = table(spark, sf_dir, "orders")
    rare = F.when(F.col("o_orderkey") == 1, "RARE").otherwise(F.col("o_orderpriority"))
    rows = orders.withColumn("class", rare)
    return S.mean_sem(rows, ["class", "o_orderstatus"], "o_totalprice")


def sum_of_means(spark, sf_dir) -> DataFrame:
    return rounded(S.sum_of_means(_single_gaps(spark, sf_dir), ["class"]), 4)


def sum_of_means_zero(spark, sf_dir) -> DataFrame:
    return rounded(S.sum_of_means(_single_gaps(spark, sf_dir), ["class"], sem_policy="zero"), 4)


def group_sum(spark, sf_dir) -> DataFrame:
    rows = gappy_lineitem(spark, sf_dir)
    return rounded(S.group_sum(rows, ["l_linenumber"], ["l_quantity", "l_discount", "l_tax"]), 4)


def group_sum_zero(spark, sf_dir) -> DataFrame:
    rows = gappy_lineitem(spark, sf_dir)
    return rounded(S.group_sum(rows, ["l_linenumber"], ["l_quantity", "l_tax"], "zero"), 4)


def overall_mean_sem(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    gas = F.when(status == "P", "CO2").when(status == "F", "CH4").otherwise("N2O")
    return rounded(S.overall_mean_sem(orders.withColumn("gas", gas), "gas", "o_totalprice"), 3)


def category_count(spark, sf_dir) -> DataFrame:
    return S.category_count(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


def contingency_share(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rounded(S.contingency_share(orders, "o_orderpriority", "o_orderstatus"))


def category_counts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return S.category_counts(rows, "l_returnflag", ["l_linestatus", "l_linenumber", "l_quantity"])


def distinct_count(spark, sf_dir) -> DataFrame:
    return S.distinct_count(table(spark, sf_dir, "events"), "user_id")


def distinct_values(spark, sf_dir) -> DataFrame:
    return S.distinct_values(table(spark, sf_dir, "events"), "event_type")


def box_stats(spark, sf_dir) -> DataFrame:
    return rounded(
        D.box_stats(gappy_lineitem(spark, sf_dir), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    )


def box_stats_approx(spark, sf_dir) -> DataFrame:
    """Whether each quartile of the sketch has a rank within the error the accuracy promises."""
    rows = gappy_lineitem(spark, sf_dir).select("l_returnflag", "l_extendedprice")
    boxes = D.box_stats(rows, ["l_returnflag"], "l_extendedprice", approx=True)
    value = F.col("l_extendedprice")
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ranks = rows.join(boxes, "l_returnflag").groupBy("l_returnflag").agg(
        F.max("n").alias("n"),
        *[F.count_if(value < F.col(q)).alias(f"_below_{q}") for q in quarters],
        *[F.count_if(value <= F.col(q)).alias(f"_upto_{q}") for q in quarters],
    )
    error = F.col("n") / 10_000 + 1
    return ranks.select(
        "l_returnflag",
        "n",
        *[
            ((F.col(f"_below_{q}") <= F.col("n") * k + error) & (F.col(f"_upto_{q}") >= F.col("n") * k - error)).alias(q)
            for q, k in quarters.items()
        ],
    )


def box_stats_sketch(spark, sf_dir) -> DataFrame:
    """Quartiles of merged sketches, taken per nation first."""
    customers = table(spark, sf_dir, "customer")
    parts = D.quantile_sketches(customers, ["c_mktsegment", "c_nationkey"], "c_acctbal")
    return D.sketched_quartiles(D.merge_quantile_sketches(parts, ["c_mktsegment"]))


def distinct_count_sketch(spark, sf_dir) -> DataFrame:
    """Distinct counts of merged sketches, taken per line status first."""
    lines = table(spark, sf_dir, "lineitem")
    parts = S.distinct_sketches(lines, ["l_returnflag", "l_linestatus"], "l_discount")
    return S.sketched_distinct(S.merge_distinct_sketches(parts, ["l_returnflag"]))


def mean_sem_dotted(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "l.flag", "l_extendedprice": "l.price"})
    return rounded(S.mean_sem(lines, ["l.flag"], "l.price"))


def box_stats_segmented(spark, sf_dir) -> DataFrame:
    rows = gappy_lineitem(spark, sf_dir)
    boxes = D.box_stats(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", rows_per_segment=100)
    return rounded(boxes)


def mid_rank_segmented(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return mid_rank(events, ["event_type"], "value", rows_per_segment=100)


def box_outliers(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return D.box_outliers(events, ["event_type"], "value")


def box_stats_many(spark, sf_dir) -> DataFrame:
    return rounded(D.box_stats_many(gappy_lineitem(spark, sf_dir), ["l_returnflag"], VARIABLES))


def group_histogram(spark, sf_dir) -> DataFrame:
    return rounded(D.group_histogram(table(spark, sf_dir, "events"), "event_type", "value"))


def describe_numeric(spark, sf_dir) -> DataFrame:
    return rounded(D.describe_numeric(gappy_lineitem(spark, sf_dir), VARIABLES))


def variable_summary(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").withColumn(
        "s_acctbal", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal"))
    )
    return rounded(D.variable_summary(suppliers, "s_acctbal"))


def share_of_total(spark, sf_dir) -> DataFrame:
    means = S.mean_sem(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    shares = S.share_of_total(means, ["o_orderstatus"], "mean", ["sem"])
    return rounded(shares.drop("lower", "upper"), 5)


def emission_share(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_mktsegment", F.abs("c_acctbal").alias("balance"), F.col("c_custkey").alias("key")
    )
    return rounded(S.emission_share(customers, "c_mktsegment", ["balance", "key"], AREAS), 3)


def mid_ranks(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return mid_rank(events, ["event_type"], "value")


QUERIES = {
    "mean_sem": mean_sem,
    "mean_sem_wide": mean_sem_wide,
    "sum_of_means": sum_of_means,
    "sum_of_means_zero": sum_of_means_zero,
    "group_sum": group_sum,
    "group_sum_zero": group_sum_zero,
    "overall_mean_sem": overall_mean_sem,
    "category_count": category_count,
    "contingency_share": contingency_share,
    "distinct_count": distinct_count,
    "distinct_values": distinct_values,
    "box_stats": box_stats,
    "box_stats_approx": box_stats_approx,
    "box_stats_sketch": box_stats_sketch,
    "distinct_count_sketch": distinct_count_sketch,
    "mean_sem_dotted": mean_sem_dotted,
    "box_stats_segmented": box_stats_segmented,
    "box_outliers": box_outliers,
    "box_stats_many": box_stats_many,
    "group_histogram": group_histogram,
    "describe_numeric": describe_numeric,
    "variable_summary": variable_summary,
    "share_of_total": share_of_total,
    "emission_share": emission_share,
    "category_counts": category_counts,
    "mid_rank": mid_ranks,
    "mid_rank_segmented": mid_rank_segmented,
}

LONG = " UNION ALL ".join(
    f"SELECT l_returnflag, '{v}' AS variable, {v} AS value FROM gappy" for v in VARIABLES
)
_MEAN_SEM = f"""WITH {GAPPY}, long AS ({LONG})
  SELECT l_returnflag, variable, count(value) AS n, round(avg(value), 6) AS mean,
    round(stddev_samp(value) / sqrt(count(value)), 6) AS sem,
    round(avg(value) - stddev_samp(value) / sqrt(count(value)), 6) AS lower,
    round(avg(value) + stddev_samp(value) / sqrt(count(value)), 6) AS upper
  FROM long WHERE value IS NOT NULL GROUP BY ALL"""
_RARE = """WITH m AS (
    SELECT CASE WHEN o_orderkey = 1 THEN 'RARE' ELSE o_orderpriority END AS class, o_orderstatus,
      avg(o_totalprice) AS mean,
      CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) / sqrt(count(*)) END AS sem
    FROM orders GROUP BY ALL),
  s AS (SELECT class, sum(mean) AS mean, sum(sem) AS sem FROM m GROUP BY class)"""
_STATS = ", ".join(
    [
        "count(value) AS count",
        "round(avg(value), 6) AS mean",
        "round(stddev_samp(value), 6) AS sd",
        "round(min(value), 6) AS min",
        "round(quantile_cont(value, 0.25), 6) AS q1",
        "round(quantile_cont(value, 0.5), 6) AS median",
        "round(quantile_cont(value, 0.75), 6) AS q3",
        "round(max(value), 6) AS max",
        "count(*) - count(value) AS n_missing",
    ]
)
_GAS = sql_case("o_orderstatus", GAS_OF_STATUS)
_AREA = sum(AREAS.values())

ORACLES = {
    "mean_sem": _MEAN_SEM,
    "mean_sem_wide": _MEAN_SEM,
    "sum_of_means": f"""{_RARE}
      SELECT class, round(mean, 4) AS mean, round(sem, 4) AS sem FROM s WHERE sem IS NOT NULL""",
    "sum_of_means_zero": f"""{_RARE}
      SELECT class, round(mean, 4) AS mean, round(coalesce(sem, 0), 4) AS sem FROM s""",
    "group_sum": f"""WITH {GAPPY}
      SELECT l_linenumber, round(sum(l_quantity), 4) AS l_quantity,
        round(CASE WHEN count(*) = count(l_discount) THEN sum(l_discount) END, 4) AS l_discount,
        round(CASE WHEN count(*) = count(l_tax) THEN sum(l_tax) END, 4) AS l_tax
      FROM gappy GROUP BY l_linenumber""",
    "group_sum_zero": f"""WITH {GAPPY}
      SELECT l_linenumber, round(sum(l_quantity), 4) AS l_quantity,
        round(coalesce(sum(l_tax), 0), 4) AS l_tax FROM gappy GROUP BY l_linenumber""",
    "overall_mean_sem": f"""WITH s AS (
        SELECT {_GAS} AS gas, count(*) AS n, avg(o_totalprice) AS mean,
               stddev_samp(o_totalprice) / sqrt(count(*)) AS sem FROM orders GROUP BY 1),
      w AS (SELECT *, {sql_case('gas', {"CO2": 1.0, "CH4": 28.0, "N2O": 265.0})} AS w,
                   365 * {_AREA!r}::DOUBLE / 1000000 AS k FROM s)
      SELECT gas, n, round(mean, 3) AS mean, round(sem, 3) AS sem,
        round(mean * w, 3) AS mean_co2eq, round(sem * w, 3) AS sem_co2eq,
        round(mean * k, 3) AS mean_gg_yr, round(sem * k, 3) AS sem_gg_yr,
        round(mean * w * k, 3) AS mean_co2eq_gg_yr, round(sem * w * k, 3) AS sem_co2eq_gg_yr FROM w""",
    "category_count": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL",
    "contingency_share": """WITH c AS (
        SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
      SELECT o_orderpriority, o_orderstatus, n,
        round(n / sum(n) OVER (PARTITION BY o_orderpriority)::DOUBLE, 6) AS share,
        round(sum(n) OVER (PARTITION BY o_orderpriority) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS width
      FROM c""",
    "distinct_count": "SELECT count(DISTINCT user_id) AS n_distinct, 'user_id' AS variable FROM events",
    "distinct_values": "SELECT DISTINCT event_type FROM events ORDER BY event_type",
    "box_stats": f"WITH {GAPPY} SELECT * FROM "
    + box_sql("gappy", "l_returnflag, l_linestatus", "l_extendedprice"),
    "box_stats_sketch": """SELECT c_mktsegment, count(c_acctbal) AS n, quantile_disc(c_acctbal, 0.25) AS q1,
        quantile_disc(c_acctbal, 0.5) AS median, quantile_disc(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1""",
    "distinct_count_sketch": "SELECT l_returnflag, count(DISTINCT l_discount) AS n_distinct FROM lineitem GROUP BY 1",
    "mean_sem_dotted": """SELECT l_returnflag AS "l.flag", count(*) AS n, round(avg(l_extendedprice), 6) AS mean,
        round(stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS sem,
        round(avg(l_extendedprice) - stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS lower,
        round(avg(l_extendedprice) + stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS upper
        FROM lineitem GROUP BY 1""",
    "box_stats_approx": """SELECT l_returnflag, count(*) AS n, true AS q1, true AS median, true AS q3
      FROM lineitem GROUP BY 1""",
    "box_outliers": """WITH q AS (
        SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM events GROUP BY event_type)
      SELECT event_id, e.event_type, value FROM events e JOIN q ON e.event_type = q.event_type
      WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "box_stats_many": f"WITH {GAPPY}, long AS ({LONG}) SELECT * FROM "
    + box_sql("long", "variable, l_returnflag", "value"),
    "group_histogram": """WITH s AS (
        SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
      b AS (SELECT e.event_type,
              CAST(least(29, floor((value - lo) / (hi - lo) * 30)) AS INTEGER) AS bin, count(*) AS n
            FROM events e JOIN s ON e.event_type = s.event_type GROUP BY ALL),
      edges AS (SELECT event_type, lo, hi, CAST(i AS INTEGER) AS bin FROM s, range(30) t(i))
      SELECT edges.event_type, edges.bin, round(lo + (hi - lo) * edges.bin / 30, 6) AS low,
        round(lo + (hi - lo) * (edges.bin + 1) / 30, 6) AS high, coalesce(n, 0) AS count
      FROM edges LEFT JOIN b ON edges.event_type = b.event_type AND edges.bin = b.bin""",
    "describe_numeric": f"""WITH {GAPPY}, long AS ({LONG})
      SELECT variable, {_STATS} FROM long GROUP BY variable""",
    "variable_summary": f"""WITH s AS (
        SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS value FROM supplier),
      d AS (SELECT {_STATS} FROM s)
      SELECT 's_acctbal' AS variable, min, q1, median, mean, q3, max, n_missing FROM d""",
    "share_of_total": """WITH m AS (
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean,
               stddev_samp(o_totalprice) / sqrt(count(*)) AS sem FROM orders GROUP BY ALL)
      SELECT o_orderstatus, o_orderpriority, n, round(mean, 5) AS mean, round(sem, 5) AS sem,
        round(mean * 100 / sum(mean) OVER (PARTITION BY o_orderstatus), 5) AS mean_pct,
        round(sem * 100 / sum(mean) OVER (PARTITION BY o_orderstatus), 5) AS sem_pct FROM m""",
    "emission_share": f"""WITH s AS (
        SELECT c_mktsegment, 'balance' AS variable, sum(abs(c_acctbal)) AS flux_sum FROM customer GROUP BY 1
        UNION ALL SELECT c_mktsegment, 'key', CAST(sum(c_custkey) AS DOUBLE) FROM customer GROUP BY 1),
      a AS (SELECT *, flux_sum * 365 * {sql_case('c_mktsegment', AREAS)} AS flux_area FROM s)
      SELECT c_mktsegment, variable, round(flux_sum, 3) AS flux_sum, round(flux_area, 3) AS flux_area,
        round(flux_sum / sum(flux_sum) OVER (PARTITION BY variable), 3) AS fraction,
        round(flux_area * 100 / sum(flux_area) OVER (PARTITION BY variable), 3) AS area_percent FROM a""",
    "mid_rank": """SELECT event_id, event_type, value,
        rank() OVER (PARTITION BY event_type ORDER BY value)
        + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS mid_rank FROM events""",
}
ORACLES["box_stats_segmented"] = ORACLES["box_stats"]
ORACLES["mid_rank_segmented"] = ORACLES["mid_rank"]
ORACLES["category_counts"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS variable, {as_text} AS category, count(*) AS n FROM lineitem GROUP BY 1, 3"
    for c, as_text in (
        ("l_linestatus", "l_linestatus"),
        ("l_linenumber", "CAST(l_linenumber AS VARCHAR)"),
        ("l_quantity", "CAST(CAST(l_quantity AS DECIMAL(12, 1)) AS VARCHAR)"),
    )
)
