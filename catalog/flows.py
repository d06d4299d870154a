"""End-to-end flows on the survey view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.chemistry import dissolved_sql, ppm_sql, utm_sql
from catalog.common import (
    AREAS,
    BANKS,
    DISSOLVED,
    FLUX,
    INDEXES,
    PPM,
    SURVEY,
    rounded,
    sql_case,
    survey,
    table,
)
from catalog.gaps import box_sql
from catalog.statistics import (
    DUNN_COLUMNS,
    _R,
    _TESTED,
    dunn_sql,
    normal_upper_sql,
    pairs_sql,
    rank_groups_sql,
    spearman_sql,
)
from fieldstats import constants as K
from fieldstats.plans import flows as P

NET = ["l_extendedprice", "l_discount", "net", "l_tax"]
FEATURES = {
    "DO": "DO", "NH": "NH4", "NO": "NO2", "COD": "COD",
    "Vel": "Velocity", "Depth": "Depth", "Tw": "t_w",
}


def flow_clean(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    located = customers.select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"),
        (F.lit(500000.0) + (F.col("c_custkey") % 1201 - 600) * 100).alias("x"),
        (F.lit(9600000.0) + (F.col("c_custkey") % 997) * 150).alias("y"),
    )
    return rounded(P.flow_clean(located, "x", "y", drop=["c_name", "x", "y"], keys=["c_custkey"]))


def flow_dissolved(spark, sf_dir) -> DataFrame:
    rows = survey(spark, sf_dir).select("site", "t_w", *PPM.values())
    return rounded(P.flow_dissolved(rows, "t_w", PPM), 3)


def flow_flux_by_river(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_flux_by_river(survey(spark, sf_dir), "river", FLUX, AREAS))


def flow_flux_overall(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_flux_overall(survey(spark, sf_dir), FLUX, AREAS))


def flow_flux_by_index(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_flux_by_index(survey(spark, sf_dir), INDEXES, FLUX))


def flow_flux_by_index_totals(spark, sf_dir) -> DataFrame:
    return rounded(P.index_totals(P.flow_flux_by_index(survey(spark, sf_dir), INDEXES, FLUX)))


def flow_flux_by_landuse(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_flux_by_landuse(survey(spark, sf_dir), BANKS, FLUX))


def flow_flux_by_landuse_totals(spark, sf_dir) -> DataFrame:
    return rounded(P.landuse_totals(P.flow_flux_by_landuse(survey(spark, sf_dir), BANKS, FLUX)))


def flow_emission_share(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_emission_share(survey(spark, sf_dir), "river", FLUX, AREAS), 3)


def flow_correlation(spark, sf_dir) -> DataFrame:
    # Net price and price are dependent, most other pairs are not.
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount"))
    )
    return rounded(P.flow_correlation(lines, NET))


def flow_dissolved_by_river(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_dissolved_by_river(survey(spark, sf_dir), "river", DISSOLVED))


def flow_dissolved_by_index(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_dissolved_by_index(survey(spark, sf_dir), INDEXES, DISSOLVED))


def flow_dissolved_by_index_totals(spark, sf_dir) -> DataFrame:
    summary = P.flow_dissolved_by_index(survey(spark, sf_dir), INDEXES, DISSOLVED)
    return rounded(P.index_totals(summary, divide_by=1000))


def flow_dissolved_by_index_tests(spark, sf_dir) -> DataFrame:
    return rounded(P.dissolved_index_tests(survey(spark, sf_dir), INDEXES, DISSOLVED))


def flow_dissolved_by_index_significant(spark, sf_dir) -> DataFrame:
    return rounded(
        P.dissolved_index_significant(survey(spark, sf_dir), INDEXES, DISSOLVED, alpha=0.5)
    )


def flow_dissolved_by_landuse(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_dissolved_by_landuse(survey(spark, sf_dir), BANKS, DISSOLVED))


def flow_dissolved_by_landuse_totals(spark, sf_dir) -> DataFrame:
    summary = P.flow_dissolved_by_landuse(survey(spark, sf_dir), BANKS, DISSOLVED)
    return rounded(P.landuse_totals(summary, divide_by=1000))


def flow_dissolved_by_landuse_tests(spark, sf_dir) -> DataFrame:
    return rounded(P.dissolved_landuse_tests(survey(spark, sf_dir), BANKS, DISSOLVED))


def flow_oxygen_by_index(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_oxygen_by_index(survey(spark, sf_dir), "DO", INDEXES))


def flow_dissolved_by_index_kruskal(spark, sf_dir) -> DataFrame:
    return rounded(P.dissolved_index_kruskal(survey(spark, sf_dir), INDEXES, DISSOLVED))


def flow_dissolved_by_landuse_kruskal(spark, sf_dir) -> DataFrame:
    return rounded(P.dissolved_landuse_kruskal(survey(spark, sf_dir), BANKS, DISSOLVED))


def _boxes(flow, labels, columns, **options):
    def query(spark, sf_dir) -> DataFrame:
        boxes = flow(survey(spark, sf_dir), labels, columns, **options)
        # Many of these quartiles end in a five at the last digit that is compared.
        stats = ("q1", "median", "q3", "mean", "whisker_low", "whisker_high")
        return rounded(boxes.withColumns({c: F.col(c) + 1e-9 for c in stats}))

    return query


def _features(gas: str):
    def query(spark, sf_dir) -> DataFrame:
        # No site of the demo is next to a factory: that class is recoded to mines.
        uses = {c: F.when(F.col(c) == "Factory", "Mining").otherwise(F.col(c)) for c in ("lb", "rb")}
        rows = survey(spark, sf_dir).withColumns(uses)
        return rounded(P.feature_table(rows, gas, FEATURES, "prati", ["lb", "rb"], DISSOLVED[gas]))

    return query


def flow_landuse_mosaic(spark, sf_dir) -> DataFrame:
    return rounded(P.flow_landuse_mosaic(survey(spark, sf_dir), "river", BANKS))


def _sites(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey",
        "c_mktsegment",
        (-3.0 + (F.col("c_custkey") % 100) / 500).alias("lat"),
        (-79.2 + (F.col("c_custkey") % 100) / 300).alias("lon"),
        F.when(F.col("c_custkey") % 7 != 0, F.abs("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
    )


def site_values(spark, sf_dir) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return rounded(P.site_values(sites, "c_custkey", "lat", "lon", "balance"))


def site_values_tributary(spark, sf_dir) -> DataFrame:
    sites = _sites(spark, sf_dir)
    one = F.col("c_mktsegment") == "BUILDING"
    return rounded(P.site_values(sites, "c_custkey", "lat", "lon", "balance", where=one))


def site_values_many(spark, sf_dir) -> DataFrame:
    return rounded(P.site_values_many(_sites(spark, sf_dir), "c_custkey", "lat", "lon", ["balance", "nation"]))


def site_gwp_values(spark, sf_dir) -> DataFrame:
    gases = {"CO2": "balance", "CH4": "nation"}
    return rounded(P.site_gwp_values(_sites(spark, sf_dir), "c_custkey", "lat", "lon", gases))


def site_gas_values(spark, sf_dir) -> DataFrame:
    gases = {"CO2": "balance", "CH4": "nation"}
    return rounded(
        P.site_gwp_values(
            _sites(spark, sf_dir), "c_custkey", "lat", "lon", gases, k=400, co2_equivalent=False
        )
    )


QUERIES = {
    "flow_clean": flow_clean,
    "flow_dissolved": flow_dissolved,
    "flow_flux_by_river": flow_flux_by_river,
    "flow_flux_overall": flow_flux_overall,
    "flow_flux_by_index": flow_flux_by_index,
    "flow_flux_by_index_totals": flow_flux_by_index_totals,
    "flow_flux_by_landuse": flow_flux_by_landuse,
    "flow_flux_by_landuse_totals": flow_flux_by_landuse_totals,
    "flow_emission_share": flow_emission_share,
    "flow_correlation": flow_correlation,
    "flow_dissolved_by_river": flow_dissolved_by_river,
    "flow_dissolved_by_index": flow_dissolved_by_index,
    "flow_dissolved_by_index_totals": flow_dissolved_by_index_totals,
    "flow_dissolved_by_index_tests": flow_dissolved_by_index_tests,
    "flow_dissolved_by_index_significant": flow_dissolved_by_index_significant,
    "flow_dissolved_by_landuse": flow_dissolved_by_landuse,
    "flow_dissolved_by_landuse_totals": flow_dissolved_by_landuse_totals,
    "flow_dissolved_by_landuse_tests": flow_dissolved_by_landuse_tests,
    "flow_dissolved_by_index_kruskal": flow_dissolved_by_index_kruskal,
    "flow_dissolved_by_landuse_kruskal": flow_dissolved_by_landuse_kruskal,
    "flow_flux_by_river_boxes": _boxes(P.boxes_by_river, "river", FLUX, order=list(AREAS)),
    "flow_flux_by_river_boxes_co2eq": _boxes(
        P.boxes_by_river, "river", FLUX, co2_equivalent=True, order=list(AREAS)
    ),
    "flow_flux_by_index_boxes": _boxes(P.boxes_by_index, INDEXES, FLUX),
    "flow_flux_by_landuse_boxes": _boxes(P.boxes_by_landuse, BANKS, FLUX),
    "flow_flux_by_bank_boxes": _boxes(P.boxes_by_landuse, BANKS, FLUX, by_bank=True),
    "flow_dissolved_by_river_boxes": _boxes(
        P.boxes_by_river, "river", DISSOLVED, dissolved=True, order=list(AREAS)
    ),
    "flow_dissolved_by_index_boxes": _boxes(P.boxes_by_index, INDEXES, DISSOLVED, dissolved=True),
    "flow_dissolved_by_landuse_boxes": _boxes(P.boxes_by_landuse, BANKS, DISSOLVED, dissolved=True),
    "flow_oxygen_by_index": flow_oxygen_by_index,
    "feature_table": _features("CO2"),
    "feature_table_ch4": _features("CH4"),
    "feature_table_n2o": _features("N2O"),
    "flow_landuse_mosaic": flow_landuse_mosaic,
    "site_values": site_values,
    "site_values_tributary": site_values_tributary,
    "site_values_many": site_values_many,
    "site_gwp_values": site_gwp_values,
    "site_gas_values": site_gas_values,
}

_FLUX_MG = {"CO2": "f_co2 * 44 / 1000", "CH4": "f_ch4 * 16 / 1000", "N2O": "f_n2o * 44 / 1000"}
_DISSOLVED = {"CO2": "d_co2 / 1000", "CH4": "d_ch4", "N2O": "d_n2o"}
_GWP = sql_case("gas", K.GWP)
_CLASS = sql_case("label", {**{p: p for p in K.PRATI_LEVELS}, **K.OREGON_TO_PRATI})
_USE = sql_case("label", K.LAND_USE_CLASS)


def _long(measures: dict[str, str], labels: dict[str, str]) -> str:
    """All measures by all labels, one SELECT each."""
    return " UNION ALL ".join(
        f"SELECT '{g}' AS gas, {expr} AS v, '{name}' AS wqi, {col} AS label FROM survey"
        for g, expr in measures.items()
        for name, col in labels.items()
    )


def _summary(keys: str, source: str) -> str:
    return f"""SELECT {keys}, gas, count(v) AS n, avg(v) AS mean,
      CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) END AS sem,
      avg(v) * any_value({_GWP}) AS mean_co2eq,
      CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) END * any_value({_GWP}) AS sem_co2eq
      FROM {source} WHERE v IS NOT NULL GROUP BY {keys}, gas"""


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sem", "mean_co2eq", "sem_co2eq"))


def _by_index(measures) -> str:
    return f"""WITH {SURVEY}, long AS ({_long(measures, INDEXES)}),
      s AS ({_summary("wqi, label", "long")})"""


def _by_use(measures) -> str:
    return f"""WITH {SURVEY}, long AS (SELECT gas, v, {_USE} AS land_use
        FROM ({_long(measures, BANKS)})),
      s AS ({_summary("land_use", "(SELECT * FROM long WHERE land_use IS NOT NULL)")})"""


def _totals(keys: str, k: int) -> str:
    return f"""SELECT {keys}, round(sum(mean_co2eq) / {k}, 6) AS mean,
      round(sum(sem_co2eq) / {k}, 6) AS sem FROM s GROUP BY {keys}"""


_BY_RIVER = f"""WITH {SURVEY}, long AS (
    {" UNION ALL ".join(f"SELECT '{g}' AS gas, {e} AS v, river FROM survey" for g, e in _FLUX_MG.items())}),
  s AS ({_summary("river", "long")})"""
_AREA = sql_case("river", AREAS)
_ALL_AREA = sum(AREAS.values())
_DIS_LONG = " UNION ALL ".join(
    f"SELECT '{g}' AS gas, {e} AS v, river FROM survey" for g, e in _DISSOLVED.items()
)

_SITES = """sites AS (SELECT c_custkey AS site, c_mktsegment,
    -3.0::DOUBLE + (c_custkey % 100) / 500.0::DOUBLE AS latitude,
    -79.2::DOUBLE + (c_custkey % 100) / 300.0::DOUBLE AS longitude,
    CASE WHEN c_custkey % 7 <> 0 THEN abs(c_acctbal) END AS balance,
    c_nationkey::DOUBLE AS nation FROM customer)"""


def _site_values(where: str) -> str:
    return f"""WITH {_SITES}, s AS (SELECT * FROM sites WHERE balance IS NOT NULL AND {where})
      SELECT site, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
        round(balance, 6) AS value,
        round(60 * sqrt(balance) / sqrt((SELECT max(balance) FROM s)), 6) AS size FROM s"""


def _site_gases(k: int, weight: int) -> str:
    return f"""WITH {_SITES}, s AS (SELECT *, nation * {weight} AS ch4 FROM sites),
      m AS (SELECT greatest(max(balance), max(ch4)) AS top FROM s)
      SELECT site, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
        round(balance, 6) AS "CO2", round(ch4, 6) AS "CH4",
        round({k} * sqrt(balance) / sqrt(top), 6) AS "CO2_size",
        round({k} * sqrt(ch4) / sqrt(top), 6) AS "CH4_size" FROM s, m"""


def _feature_sql(gas: str) -> str:
    names = K.FEATURE_COLUMNS[gas]
    cols = ", ".join(f'"{FEATURES[p]}" AS "{p}"' for p in names)
    out = ", ".join(f'round("{p}", 6) AS "{p}"' for p in names)
    wqi = ", ".join(f"('{v}', '{i}')" for i, v in enumerate(K.PRATI_LEVELS, 1))
    land = ", ".join(
        f"('{v}', '{K.LAND_USE_LEVELS.index(c) + 1}')" for v, c in K.LAND_USE_CLASS.items()
    )
    return f"""WITH {SURVEY},
      r AS (SELECT {cols}, {DISSOLVED[gas]} AS target, prati,
              CASE lb WHEN 'Factory' THEN 'Mining' ELSE lb END AS lb,
              CASE rb WHEN 'Factory' THEN 'Mining' ELSE rb END AS rb FROM survey),
      q AS (SELECT r.*, w.wqi FROM r RIGHT JOIN (VALUES {wqi}) w(prati, wqi) ON r.prati = w.prati),
      b AS (SELECT * EXCLUDE (lb, rb), lb AS use FROM q UNION ALL SELECT * EXCLUDE (lb, rb), rb FROM q)
      SELECT {out}, wqi AS "WQI", land AS "Land", round(target, 6) AS "{gas}"
      FROM b RIGHT JOIN (VALUES {land}) l(use, land) ON b.use = l.use"""


_CUSTOMER_UTM = utm_sql(
    "customer",
    "c_custkey",
    "500000.0::DOUBLE + (c_custkey % 1201 - 600) * 100",
    "9600000.0::DOUBLE + (c_custkey % 997) * 150",
)
_FILLED = """filled AS (SELECT site, coalesce(t_w, (SELECT avg(t_w) FROM survey)) AS t_w,
    coalesce(ppm_n2o, (SELECT avg(ppm_n2o) FROM survey)) AS ppm_n2o,
    coalesce(ppm_ch4, (SELECT avg(ppm_ch4) FROM survey)) AS ppm_ch4,
    coalesce(ppm_co2, (SELECT avg(ppm_co2) FROM survey)) AS ppm_co2 FROM survey)"""

def _h_sql(keys: str, source: str, group: str) -> str:
    on = " AND ".join(f"g.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    p = f"""CASE k - 1 WHEN 2 THEN exp(-h / 2) WHEN 4 THEN exp(-h / 2) * (1 + h / 2)
      WHEN 3 THEN 2 * ({normal_upper_sql("sqrt(h)")}) + sqrt(2 * h / pi()) * exp(-h / 2) END"""
    return f"""{rank_groups_sql(source, keys, group, "v")},
      h AS (SELECT {own}, any_value(nn) AS nn, count(*) AS k,
              12 / (any_value(nn) * (any_value(nn) + 1))
                * sum(n * (rs / n - (nn + 1) / 2) * (rs / n - (nn + 1) / 2))
                / (1 - any_value(tie) / (any_value(nn)**3 - any_value(nn))) AS h
            FROM g JOIN m ON {on} GROUP BY {own})
      SELECT {keys}, CAST(nn AS BIGINT) AS n, k, round(h, 6) AS h, k - 1 AS df, round({p}, 6) AS p FROM h"""


def _box_query(keys: str, source: str, ordered: str, levels: list[str]) -> str:
    return f"""WITH {SURVEY}, long AS ({source}), b AS (SELECT * FROM {box_sql("long", f"{keys}, gas", "v", " + 1e-9::DOUBLE")})
      SELECT b.*, CAST(list_position({levels!r}, {ordered}) AS INTEGER) AS ord FROM b"""


_FLUX_GWP = {g: f"({e}) * {K.GWP[g]!r}::DOUBLE" for g, e in _FLUX_MG.items()}
_CLASSES = K.PRATI_LEVELS + K.OREGON_LEVELS


def _river_boxes(measures: dict[str, str]) -> str:
    source = " UNION ALL ".join(f"SELECT '{g}' AS gas, {e} AS v, river FROM survey" for g, e in measures.items())
    return _box_query("river", source, "river", list(AREAS))


def _use_boxes(measures: dict[str, str], keys: str = "land_use") -> str:
    source = f"SELECT gas, v, wqi AS bank, {_USE} AS land_use FROM ({_long(measures, BANKS)})"
    return _box_query(keys, source, "land_use", K.LAND_USE_LEVELS)


ORACLES = {
    "flow_dissolved_by_index_kruskal": f"""WITH {SURVEY}, long AS (
        SELECT gas, v, wqi, {_CLASS} AS class FROM ({_long(_DISSOLVED, INDEXES)})),
      {_h_sql("wqi, gas", "long", "class")}""",
    "flow_dissolved_by_landuse_kruskal": f"""WITH {SURVEY}, long AS (
        SELECT gas, v, {_USE} AS land_use FROM ({_long(_DISSOLVED, BANKS)})),
      {_h_sql("gas", "long", "land_use")}""",
    "flow_flux_by_river_boxes": _river_boxes(_FLUX_MG),
    "flow_flux_by_river_boxes_co2eq": _river_boxes(_FLUX_GWP),
    "flow_flux_by_index_boxes": _box_query("wqi, label", _long(_FLUX_MG, INDEXES), "label", _CLASSES),
    "flow_flux_by_landuse_boxes": _use_boxes(_FLUX_MG),
    "flow_flux_by_bank_boxes": _use_boxes(_FLUX_MG, "bank, land_use"),
    "flow_dissolved_by_river_boxes": _river_boxes(_DISSOLVED),
    "flow_dissolved_by_index_boxes": _box_query("wqi, label", _long(_DISSOLVED, INDEXES), "label", _CLASSES),
    "flow_dissolved_by_landuse_boxes": _use_boxes(_DISSOLVED),
    "flow_clean": f"""SELECT u.c_custkey, round(coalesce(CASE WHEN u.c_custkey % 7 <> 0 THEN c_acctbal END,
        (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 7 <> 0)), 6) AS balance,
      lat AS latitude, lon AS longitude
      FROM ({_CUSTOMER_UTM}) u JOIN customer c ON u.c_custkey = c.c_custkey""",
    "flow_dissolved": f"""WITH {SURVEY}, {_FILLED}
      SELECT site, round(t_w, 3) AS t_w, round(ppm_n2o, 3) AS ppm_n2o, round(ppm_ch4, 3) AS ppm_ch4,
        round(ppm_co2, 3) AS ppm_co2,
        round({dissolved_sql("ppm_n2o", "t_w", "N2O")}, 3) AS "Dis_N2O_cor",
        round({dissolved_sql("ppm_ch4", "t_w", "CH4")}, 3) AS "Dis_CH4_cor",
        round({ppm_sql(dissolved_sql("ppm_co2", "t_w", "CO2"), "CO2")}, 3) AS "Dis_CO2_cor" FROM filled""",
    "flow_flux_by_river": f"""{_BY_RIVER},
      y AS (SELECT *, 365 * {_AREA} / 1000000 AS k FROM s)
      SELECT river, gas, n, {_ROUNDED}, round(mean * k, 6) AS mean_gg_yr, round(sem * k, 6) AS sem_gg_yr,
        round(mean_co2eq * k, 6) AS mean_co2eq_gg_yr, round(sem_co2eq * k, 6) AS sem_co2eq_gg_yr,
        round(mean * k * 100 / sum(mean * k) OVER (PARTITION BY gas), 6) AS mean_gg_yr_pct,
        round(sem * k * 100 / sum(mean * k) OVER (PARTITION BY gas), 6) AS sem_gg_yr_pct FROM y""",
    "flow_flux_overall": f"""WITH {SURVEY}, long AS (
        {" UNION ALL ".join(f"SELECT '{g}' AS gas, 1 AS one, {e} AS v FROM survey" for g, e in _FLUX_MG.items())}),
      s AS ({_summary("one", "long")}), y AS (SELECT *, 365 * {_ALL_AREA!r}::DOUBLE / 1000000 AS k FROM s)
      SELECT gas, n, {_ROUNDED}, round(mean * k, 6) AS mean_gg_yr, round(sem * k, 6) AS sem_gg_yr,
        round(mean_co2eq * k, 6) AS mean_co2eq_gg_yr, round(sem_co2eq * k, 6) AS sem_co2eq_gg_yr FROM y""",
    "flow_flux_by_index": f"""{_by_index(_FLUX_MG)}
      SELECT wqi, label, {_CLASS} AS water_quality, gas, n, {_ROUNDED} FROM s""",
    "flow_flux_by_index_totals": f"{_by_index(_FLUX_MG)} {_totals('wqi, label', 1)}",
    "flow_flux_by_landuse": f"{_by_use(_FLUX_MG)} SELECT land_use, gas, n, {_ROUNDED} FROM s",
    "flow_flux_by_landuse_totals": f"{_by_use(_FLUX_MG)} {_totals('land_use', 1)}",
    "flow_emission_share": f"""WITH {SURVEY}, long AS (
        {" UNION ALL ".join(f"SELECT river, '{g}' AS gas, ({e}) * {K.GWP[g]!r}::DOUBLE AS v FROM survey" for g, e in _FLUX_MG.items())}),
      s AS (SELECT river, gas, sum(v) AS flux_sum, sum(v) * 365 * any_value({_AREA}) AS flux_area
            FROM long GROUP BY river, gas)
      SELECT river, gas, round(flux_sum, 3) AS flux_sum, round(flux_area, 3) AS flux_area,
        round(flux_sum / sum(flux_sum) OVER (PARTITION BY gas), 3) AS fraction,
        round(flux_area * 100 / sum(flux_area) OVER (PARTITION BY gas), 3) AS area_percent FROM s""",
    "flow_correlation": f"""WITH lines AS (
        SELECT l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
      pearson AS ({pairs_sql("lines", _R, NET)}), {_TESTED}, sp AS ({spearman_sql("lines", NET)})
      SELECT var_x, var_y, sp.n, round(sp.r, 6) AS r, round(p, 6) AS p
      FROM sp JOIN tested USING (var_x, var_y) WHERE p <= 0.05""",
    "flow_dissolved_by_river": f"""WITH {SURVEY}, long AS ({_DIS_LONG}),
      s AS ({_summary("river", "long")}),
      w AS (SELECT river, v * {_GWP} AS v FROM long WHERE v IS NOT NULL)
      SELECT river, gas, n, {_ROUNDED} FROM s
      UNION ALL SELECT river, 'all', count(v), NULL, NULL, round(avg(v), 6),
        round(stddev_samp(v) / sqrt(count(v)), 6) FROM w GROUP BY river""",
    "flow_dissolved_by_index": f"""{_by_index(_DISSOLVED)}
      SELECT wqi, label, {_CLASS} AS water_quality, gas, n, {_ROUNDED} FROM s""",
    "flow_dissolved_by_index_totals": f"{_by_index(_DISSOLVED)} {_totals('wqi, label', 1000)}",
    "flow_dissolved_by_index_tests": f"""WITH {SURVEY}, long AS (
        SELECT gas, v, wqi, {_CLASS} AS class FROM ({_long(_DISSOLVED, INDEXES)})),
      {rank_groups_sql("long", "wqi, gas", "class", "v")}, {dunn_sql("wqi, gas")}
      SELECT wqi, gas, {DUNN_COLUMNS} FROM dunn""",
    "flow_dissolved_by_index_significant": f"""WITH {SURVEY}, long AS (
        SELECT gas, v, wqi, {_CLASS} AS class FROM ({_long(_DISSOLVED, INDEXES)})),
      {rank_groups_sql("long", "wqi, gas", "class", "v")}, {dunn_sql("wqi, gas")}
      SELECT wqi, gas, {DUNN_COLUMNS} FROM dunn WHERE least(1.0::DOUBLE, p * tests) <= 0.5""",
    "flow_dissolved_by_landuse": f"{_by_use(_DISSOLVED)} SELECT land_use, gas, n, {_ROUNDED} FROM s",
    "flow_dissolved_by_landuse_totals": f"{_by_use(_DISSOLVED)} {_totals('land_use', 1000)}",
    "flow_dissolved_by_landuse_tests": f"""WITH {SURVEY}, long AS (
        SELECT gas, v, {_USE} AS land_use FROM ({_long(_DISSOLVED, BANKS)})),
      {rank_groups_sql("long", "gas", "land_use", "v")}, {dunn_sql("gas")}
      SELECT gas, {DUNN_COLUMNS} FROM dunn""",
    "flow_oxygen_by_index": f"""WITH {SURVEY}, long AS ({_long({"DO": '"DO"'}, INDEXES)}),
      b AS (SELECT * FROM {box_sql("long", "wqi, label", "v")})
      SELECT b.*, CAST(list_position({K.PRATI_LEVELS + K.OREGON_LEVELS!r}, label) AS INTEGER) AS ord FROM b""",
    "feature_table": _feature_sql("CO2"),
    "feature_table_ch4": _feature_sql("CH4"),
    "feature_table_n2o": _feature_sql("N2O"),
    "flow_landuse_mosaic": f"""WITH {SURVEY}, long AS (
        SELECT river, {sql_case("lb", K.LAND_USE_CLASS)} AS land_use FROM survey
        UNION ALL SELECT river, {sql_case("rb", K.LAND_USE_CLASS)} FROM survey),
      c AS (SELECT river, land_use, count(*) AS n FROM long GROUP BY ALL)
      SELECT river, land_use, n,
        round(n / sum(n) OVER (PARTITION BY river)::DOUBLE, 6) AS share,
        round(sum(n) OVER (PARTITION BY river) / (SELECT count(*) FROM long)::DOUBLE, 6) AS width FROM c""",
    "site_values": _site_values("true"),
    "site_values_tributary": _site_values("c_mktsegment = 'BUILDING'"),
    "site_values_many": f"WITH {_SITES} " + " UNION ALL ".join(
        f"""SELECT site, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, '{v}' AS variable,
          round({v}, 6) AS value, round(60 * sqrt({v}) / sqrt((SELECT max({v}) FROM sites)), 6) AS size
        FROM sites WHERE {v} IS NOT NULL"""
        for v in ("balance", "nation")
    ),
    "site_gwp_values": _site_gases(100, 28),
    "site_gas_values": _site_gases(400, 1),
}
