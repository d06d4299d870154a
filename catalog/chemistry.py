"""Domain formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import AREAS, rounded, sql_case, table
from fieldstats import constants as K
from fieldstats.functions import domain as D
from fieldstats.operators import summary as S

GASES = ["CO2", "CH4", "N2O"]
STATUS_GAS = {"P": "CO2", "F": "CH4", "O": "N2O"}


def utm_to_latlon(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    east = F.lit(500000.0) + (F.col("c_custkey") % 1201 - 600) * 100
    north = F.lit(9600000.0) + (F.col("c_custkey") % 997) * 150
    lat, lon = D.utm_to_latlon(east, north)
    return rounded(customers.select("c_custkey", lat.alias("lat"), lon.alias("lon")))


def henry_coefficient(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return rounded(
        lines.select(
            "l_orderkey",
            "l_linenumber",
            "l_quantity", *[D.henry_coefficient("l_quantity", g).alias(f"h_{g}") for g in GASES]
        ),
        4,
    )


def headspace_gas(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rounded(orders.select("o_orderkey", D.headspace_gas("o_totalprice").alias("cg")), 9)


def dissolved_ug_l(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    gases = {g: D.dissolved_ug_l(F.col("l_extendedprice") / 100, "l_quantity", g) for g in GASES}
    return rounded(
        lines.select(
            "l_orderkey", "l_linenumber", *[c.alias(f"ug_{g}") for g, c in gases.items()]
        ),
        3,
    )


def dissolved_ppm(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ug = F.col("o_totalprice") / 1000
    return rounded(
        orders.select("o_orderkey", *[D.dissolved_ppm(ug, g).alias(f"ppm_{g}") for g in GASES])
    )


def molar_to_mass_flux(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rounded(
        orders.select(
            "o_orderkey", *[D.molar_to_mass_flux("o_totalprice", g).alias(f"mg_{g}") for g in GASES]
        )
    )


def _gas_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    gas = F.when(F.col("o_orderstatus") == "P", "CO2").when(F.col("o_orderstatus") == "F", "CH4")
    return orders.select(
        "o_orderkey", gas.otherwise("N2O").alias("gas"), F.col("o_totalprice").alias("value")
    )


def to_co2_equivalent(spark, sf_dir) -> DataFrame:
    return rounded(S.to_co2_equivalent(_gas_orders(spark, sf_dir), "gas", "value"), 4)


def from_co2_equivalent(spark, sf_dir) -> DataFrame:
    return rounded(S.from_co2_equivalent(_gas_orders(spark, sf_dir), "gas", "value"), 6)


def annual_emission(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(S.annual_emission(customers, "c_mktsegment", ["c_acctbal"], AREAS))


def rescale(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(S.rescale(part, ["p_size", "p_retailprice"], 1000))


def symbol_size(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return rounded(S.symbol_size(suppliers, ["s_acctbal"], 60))


def symbol_size_shared(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(S.symbol_size(part, ["p_size", "p_retailprice"], 100, shared_max=True))


QUERIES = {
    "utm_to_latlon": utm_to_latlon,
    "henry_coefficient": henry_coefficient,
    "headspace_gas": headspace_gas,
    "dissolved_ug_l": dissolved_ug_l,
    "dissolved_ppm": dissolved_ppm,
    "molar_to_mass_flux": molar_to_mass_flux,
    "to_co2_equivalent": to_co2_equivalent,
    "from_co2_equivalent": from_co2_equivalent,
    "annual_emission": annual_emission,
    "rescale": rescale,
    "symbol_size": symbol_size,
    "symbol_size_shared": symbol_size_shared,
}


def henry_sql(temp: str, gas: str) -> str:
    a, b, c, d = K.HENRY[gas]
    tk = f"(({temp}) + 273.15::DOUBLE)"
    return (
        f"(1.0::DOUBLE / exp(({a}::DOUBLE + {b}::DOUBLE / {tk} + {c}::DOUBLE * ln({tk}) "
        f"+ {d}::DOUBLE * {tk}) / 1.98719::DOUBLE))"
    )


def dissolved_sql(ppm: str, temp: str, gas: str) -> str:
    mass = K.AQUEOUS_MOLAR_MASS[gas]
    cg = f"(({ppm}) * 1e-6::DOUBLE * 2)"
    tk = f"(({temp}) + 273.15::DOUBLE)"
    return (
        f"((55.5::DOUBLE * ({cg} / {henry_sql(temp, gas)}) * {mass}::DOUBLE * 1000 "
        f"+ 1.0::DOUBLE * {cg} * ({mass}::DOUBLE / 22.4::DOUBLE) * (273.15::DOUBLE / {tk}) * 1000) * 1000)"
    )


def ppm_sql(ug: str, gas: str) -> str:
    if gas == "CO2":
        return f"(581.68::DOUBLE * ({ug}) / 1000 - 5.2707::DOUBLE)"
    return f"(({ug}) * 24.45::DOUBLE / {K.PPM_MOLAR_MASS[gas]}::DOUBLE)"


# Snyder's series from the footpoint latitude, which shares no formula with the code.
def utm_sql(source: str, key: str, east: str, north: str) -> str:
    return f"""WITH pos AS (SELECT {key}, ({east}) - 500000 AS x, ({north}) - 10000000 AS y FROM {source}),
      c AS (SELECT *, 6378137.0::DOUBLE AS a, 0.0066943799901413165::DOUBLE AS e2,
                   (1 - sqrt(1 - 0.0066943799901413165::DOUBLE)) / (1 + sqrt(1 - 0.0066943799901413165::DOUBLE)) AS e1
            FROM pos),
      m AS (SELECT *, (y / 0.9996::DOUBLE) / (a * (1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256)) AS mu FROM c),
      f AS (SELECT *, mu + (3*e1/2 - 27*e1**3/32) * sin(2*mu) + (21*e1*e1/16 - 55*e1**4/32) * sin(4*mu)
                   + 151*e1**3/96 * sin(6*mu) + 1097*e1**4/512 * sin(8*mu) AS p1, e2 / (1 - e2) AS ep2 FROM m),
      g AS (SELECT *, ep2 * cos(p1)**2 AS c1, tan(p1)**2 AS t1,
                   a / sqrt(1 - e2*sin(p1)**2) AS n1, a*(1 - e2) / (1 - e2*sin(p1)**2)**1.5 AS r1 FROM f),
      h AS (SELECT *, x / (n1 * 0.9996::DOUBLE) AS d FROM g)
      SELECT {key},
        round(degrees(p1 - (n1*tan(p1)/r1) * (d*d/2 - (5 + 3*t1 + 10*c1 - 4*c1*c1 - 9*ep2)*d**4/24
          + (61 + 90*t1 + 298*c1 + 45*t1*t1 - 252*ep2 - 3*c1*c1)*d**6/720)), 6) AS lat,
        round(-81 + degrees((d - (1 + 2*t1 + c1)*d**3/6
          + (5 - 2*c1 + 28*t1 - 3*c1*c1 + 8*ep2 + 24*t1*t1)*d**5/120) / cos(p1)), 6) AS lon
      FROM h"""


_GAS_ORDERS = f"SELECT o_orderkey, {sql_case('o_orderstatus', STATUS_GAS)} AS gas, o_totalprice FROM orders"

ORACLES = {
    "utm_to_latlon": utm_sql(
        "customer",
        "c_custkey",
        "500000.0::DOUBLE + (c_custkey % 1201 - 600) * 100",
        "9600000.0::DOUBLE + (c_custkey % 997) * 150",
    ),
    "henry_coefficient": "SELECT l_orderkey, l_linenumber, l_quantity, "
    + ", ".join(f'round({henry_sql("l_quantity", g)}, 4) AS "h_{g}"' for g in GASES)
    + " FROM lineitem",
    "headspace_gas": "SELECT o_orderkey, round(o_totalprice * 1e-6::DOUBLE * 2, 9) AS cg FROM orders",
    "dissolved_ug_l": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f'round({dissolved_sql("l_extendedprice / 100", "l_quantity", g)}, 3) AS "ug_{g}"'
        for g in GASES
    )
    + " FROM lineitem",
    "dissolved_ppm": "SELECT o_orderkey, "
    + ", ".join(f'round({ppm_sql("o_totalprice / 1000", g)}, 6) AS "ppm_{g}"' for g in GASES)
    + " FROM orders",
    "molar_to_mass_flux": """SELECT o_orderkey, round(o_totalprice * 44 / 1000, 6) AS "mg_CO2",
      round(o_totalprice * 16 / 1000, 6) AS "mg_CH4", round(o_totalprice * 44 / 1000, 6) AS "mg_N2O"
      FROM orders""",
    "to_co2_equivalent": f"""SELECT o_orderkey, gas,
      round(o_totalprice * {sql_case('gas', K.GWP)}, 4) AS value FROM ({_GAS_ORDERS})""",
    "from_co2_equivalent": f"""SELECT o_orderkey, gas,
      round(o_totalprice / {sql_case('gas', K.GWP)}, 6) AS value FROM ({_GAS_ORDERS})""",
    "annual_emission": f"""SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal,
      round(c_acctbal * 365 / 1e6::DOUBLE * {sql_case('c_mktsegment', AREAS)}, 6) AS "c_acctbal_gg_yr"
      FROM customer""",
    "rescale": """SELECT p_partkey, round(p_size / 1000.0::DOUBLE, 6) AS p_size,
      round(p_retailprice / 1000, 6) AS p_retailprice FROM part""",
    "symbol_size": """SELECT s_suppkey, s_acctbal,
      round(CASE WHEN s_acctbal >= 0 THEN 60 * sqrt(s_acctbal)
        / sqrt((SELECT max(s_acctbal) FROM supplier)) END, 6) AS s_acctbal_size FROM supplier""",
    "symbol_size_shared": """WITH m AS (SELECT greatest(max(p_size), max(p_retailprice)) AS top FROM part)
      SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice,
        round(100 * sqrt(p_size) / sqrt(top), 6) AS p_size_size,
        round(100 * sqrt(p_retailprice) / sqrt(top), 6) AS p_retailprice_size FROM part, m""",
}
