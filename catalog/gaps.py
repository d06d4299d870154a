"""Missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import GAPPY, gappy_lineitem, rounded
from fieldstats.operators import missing as M
from fieldstats.operators.summary import symbol_size

COLS = ["l_quantity", "l_discount", "l_tax"]


def missing_pattern(spark, sf_dir) -> DataFrame:
    return M.missing_pattern(gappy_lineitem(spark, sf_dir), COLS)


def missing_share(spark, sf_dir) -> DataFrame:
    return rounded(M.missing_share(gappy_lineitem(spark, sf_dir), COLS))


def margin_summary(spark, sf_dir) -> DataFrame:
    return rounded(M.margin_summary(gappy_lineitem(spark, sf_dir), "l_discount", "l_tax"))


def impute_mean(spark, sf_dir) -> DataFrame:
    rows = gappy_lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag"
    )
    return rounded(M.impute_mean(rows, ["l_discount", "l_tax"]))


def _with_nan(spark, sf_dir) -> DataFrame:
    """NaN where the other queries have null."""
    rows = gappy_lineitem(spark, sf_dir)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("l_discount", "l_tax")})


def missing_share_nan(spark, sf_dir) -> DataFrame:
    return rounded(M.missing_share(_with_nan(spark, sf_dir), COLS))


def missing_pattern_nan(spark, sf_dir) -> DataFrame:
    return M.missing_pattern(_with_nan(spark, sf_dir), COLS)


def margin_summary_nan(spark, sf_dir) -> DataFrame:
    return rounded(M.margin_summary(_with_nan(spark, sf_dir), "l_discount", "l_tax"))


def impute_mean_nan(spark, sf_dir) -> DataFrame:
    rows = _with_nan(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    return rounded(M.impute_mean(rows, keep=["l_orderkey", "l_linenumber"]))


def symbol_size_nan(spark, sf_dir) -> DataFrame:
    rows = _with_nan(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_tax")
    return rounded(symbol_size(rows, ["l_tax"]).drop("l_tax"))


QUERIES = {
    "missing_pattern": missing_pattern,
    "missing_share": missing_share,
    "margin_summary": margin_summary,
    "impute_mean": impute_mean,
    "missing_pattern_nan": missing_pattern_nan,
    "missing_share_nan": missing_share_nan,
    "margin_summary_nan": margin_summary_nan,
    "impute_mean_nan": impute_mean_nan,
    "symbol_size_nan": symbol_size_nan,
}


def box_sql(source: str, groups: str, value: str, nudge: str = "") -> str:
    """Box statistics by ``quantile_cont``; ``source`` is a table expression.

    ``nudge`` is added before rounding, where values end in a five too often."""
    g = [x.strip() for x in groups.split(",")]
    on = " AND ".join(f"r.{x} = q.{x}" for x in g)
    cols = ", ".join(f"q.{x}" for x in g)
    inside = f"r.{value} BETWEEN q.q1 - 1.5*(q.q3 - q.q1) AND q.q3 + 1.5*(q.q3 - q.q1)"
    present = " AND ".join(f"{x} IS NOT NULL" for x in [*g, value])
    return f"""(WITH r AS (SELECT {groups}, {value} FROM {source} WHERE {present}),
      q AS (SELECT {groups}, count(*) AS n, quantile_cont({value}, 0.25) AS q1,
                   quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3,
                   avg({value}) AS mean FROM r GROUP BY {groups})
      SELECT {cols}, any_value(q.n) AS n, round(any_value(q.q1){nudge}, 6) AS q1,
        round(any_value(q.median){nudge}, 6) AS median, round(any_value(q.q3){nudge}, 6) AS q3,
        round(any_value(q.mean){nudge}, 6) AS mean,
        round(min(CASE WHEN {inside} THEN r.{value} END){nudge}, 6) AS whisker_low,
        round(max(CASE WHEN {inside} THEN r.{value} END){nudge}, 6) AS whisker_high,
        CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
      FROM r JOIN q ON {on} GROUP BY {cols})"""


ORACLES = {
    "missing_pattern": f"""WITH {GAPPY}
      SELECT CAST(l_quantity IS NOT NULL AS INTEGER) AS has_l_quantity,
             CAST(l_discount IS NOT NULL AS INTEGER) AS has_l_discount,
             CAST(l_tax IS NOT NULL AS INTEGER) AS has_l_tax, count(*) AS n,
             CAST(any_value(CAST(l_quantity IS NULL AS INTEGER) + CAST(l_discount IS NULL AS INTEGER)
               + CAST(l_tax IS NULL AS INTEGER)) AS INTEGER) AS n_missing
      FROM gappy GROUP BY 1, 2, 3""",
    "missing_share": f"""WITH {GAPPY}
      SELECT 'l_quantity' AS variable, count(*) - count(l_quantity) AS n_missing,
             round((count(*) - count(l_quantity)) / count(*)::DOUBLE, 6) AS share FROM gappy
      UNION ALL SELECT 'l_discount', count(*) - count(l_discount),
             round((count(*) - count(l_discount)) / count(*)::DOUBLE, 6) FROM gappy
      UNION ALL SELECT 'l_tax', count(*) - count(l_tax),
             round((count(*) - count(l_tax)) / count(*)::DOUBLE, 6) FROM gappy""",
    "margin_summary": f"""WITH {GAPPY},
      s AS (SELECT l_discount, CASE WHEN l_tax IS NULL THEN 'missing' ELSE 'present' END AS other FROM gappy),
      b AS (SELECT * FROM {box_sql("s", "other", "l_discount")}),
      n AS (SELECT count(*) FILTER (l_discount IS NULL AND l_tax IS NOT NULL) AS missing_x_only,
                   count(*) FILTER (l_discount IS NOT NULL AND l_tax IS NULL) AS missing_y_only,
                   count(*) FILTER (l_discount IS NULL AND l_tax IS NULL) AS missing_both FROM gappy)
      SELECT b.*, n.* FROM b, n""",
    "impute_mean": f"""WITH {GAPPY}
      SELECT l_orderkey, l_linenumber,
        round(coalesce(l_discount, (SELECT avg(l_discount) FROM gappy)), 6) AS l_discount,
        round(coalesce(l_tax, (SELECT avg(l_tax) FROM gappy)), 6) AS l_tax, l_returnflag FROM gappy""",
}
ORACLES |= {f"{k}_nan": ORACLES[k] for k in ("missing_pattern", "missing_share", "margin_summary", "impute_mean")}
ORACLES["symbol_size_nan"] = f"""WITH {GAPPY}
  SELECT l_orderkey, l_linenumber,
    round(60 * sqrt(l_tax) / sqrt((SELECT max(l_tax) FROM gappy)), 6) AS l_tax_size FROM gappy"""
