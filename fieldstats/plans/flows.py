"""The study's analyses, each from a wide survey to a result table.

Columns are passed by name. ``flux`` maps a gas to its molar flux column,
``dissolved`` a gas to its dissolved concentration, ``indexes`` an index name to its
class column, ``banks`` a bank name to its land-use column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats import constants as K
from fieldstats.functions.domain import (
    dissolved_ppm,
    dissolved_ug_l,
    molar_to_mass_flux,
    utm_to_latlon,
)
from fieldstats.kept import kept
from fieldstats.names import any_names
from fieldstats.operators.columns import complete_cases, drop_cols, significant_only
from fieldstats.operators.correlation import corr_significant
from fieldstats.operators.distribution import box_stats
from fieldstats.operators.joins import right_lookup
from fieldstats.operators.missing import impute_mean
from fieldstats.operators.positions import number
from fieldstats.operators.ranks import dunn_test_by_label, kruskal_wallis_by_label
from fieldstats.operators.recoding import order_levels, recode_exact
from fieldstats.operators.reshape import to_long
from fieldstats.operators.summary import (
    add_co2_equivalent,
    annual_emission,
    basin_totals,
    contingency_share,
    emission_share,
    mean_sem_wide,
    pool_summaries,
    share_of_total,
    sum_of_means,
    symbol_size,
)
from fieldstats.sources.io import lookup_table


_CLASS_NAMES = {**{p: p for p in K.PRATI_LEVELS}, **K.OREGON_TO_PRATI}


def _mass(flux: Mapping[str, str]) -> dict[str, Column]:
    return {gas: molar_to_mass_flux(c, gas) for gas, c in flux.items()}


def _concentration(dissolved: Mapping[str, str]) -> dict[str, Column]:
    """Dissolved gases in the units of the summaries: CO2 in matm."""
    return {g: F.col(c) / 1000 if g == "CO2" else F.col(c) for g, c in dissolved.items()}


def _labels_long(
    df: DataFrame, measures: Mapping[str, Column], labels: Mapping[str, str], name: str, value: str
) -> DataFrame:
    """One row per label column, measures still side by side under the gas names."""
    wide = df.select(
        *[c.alias(g) for g, c in measures.items()], *[F.col(c).alias(k) for k, c in labels.items()]
    )
    return to_long(wide, list(measures), list(labels), name, value)


def _folded(
    df: DataFrame, measures: Mapping[str, Column], labels: Mapping[str, str], classes: Mapping[str, str] | None = None
) -> DataFrame:
    """Cells (labels side by side, gas, concentration, n) for rank tests and boxes, kept.

    Equal measurements under equal labels are counted, with partial counts in the map task.
    ``classes`` replaces the labels first.
    """
    wide = df.select(*[c.alias(g) for g, c in measures.items()], *[F.col(c).alias(k) for k, c in labels.items()])
    for k in labels if classes else ():
        wide = recode_exact(wide, k, classes)
    names = [F.col(f"`{k}`") for k in labels]
    long = _gases_long(wide, list(labels), list(measures)).withColumn("concentration", number("concentration"))
    known = long.filter(F.col("concentration").isNotNull() & F.coalesce(*names).isNotNull())
    return kept(known.groupBy(*names, "gas", "concentration").agg(F.count(F.lit(1)).alias("n")))


def _index_test(test, df: DataFrame, indexes: Mapping[str, str], dissolved: Mapping[str, str], **options) -> DataFrame:
    """A rank test between the classes of each index, per gas."""
    cells = _folded(df, _concentration(dissolved), indexes, _CLASS_NAMES)
    sides = {k: [k] for k in indexes}
    return test(cells, ["gas"], sides, "wqi", "water_quality", "concentration", **options)


def _landuse_test(test, df: DataFrame, banks: Mapping[str, str], dissolved: Mapping[str, str], **options) -> DataFrame:
    """A rank test between land-use classes per gas, a site once for each bank."""
    cells = _folded(df, _concentration(dissolved), banks, K.LAND_USE_CLASS)
    sides = {"both": list(banks)}
    return test(cells, ["gas"], sides, "bank", "land_use", "concentration", **options).drop("bank")


def _gases_long(wide: DataFrame, keys: Sequence[str], gases: Sequence[str]) -> DataFrame:
    return to_long(wide, keys, gases, "gas", "concentration")


def _weighted(summary: DataFrame) -> DataFrame:
    return add_co2_equivalent(summary.drop("lower", "upper"), "gas", ["mean", "sem"])


def _class_names(df: DataFrame) -> DataFrame:
    """Add the common class name: Oregon classes under their Prati names."""
    return recode_exact(df, "label", _CLASS_NAMES, into="water_quality")


@any_names
def flow_clean(
    df: DataFrame,
    easting: str,
    northing: str,
    drop: Sequence[str] = (),
    zone: int = 17,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Latitude and longitude from UTM, unused columns dropped, numeric gaps filled.

    ``keys`` are numeric columns that only name a row and stay as they are.
    """
    lat, lon = utm_to_latlon(easting, northing, zone)
    located = df.withColumns({"latitude": lat, "longitude": lon})
    return impute_mean(drop_cols(located, drop), keep=keys)


@any_names
def flow_dissolved(df: DataFrame, temp: str, ppm: Mapping[str, str]) -> DataFrame:
    """Headspace readings to dissolved gas: N2O and CH4 in ug/L, CO2 in ppm."""
    filled = impute_mean(df, [temp, *ppm.values()])
    out = {}
    for gas, c in ppm.items():
        ug = dissolved_ug_l(c, temp, gas)
        out[f"Dis_{gas}_cor"] = dissolved_ppm(ug, gas) if gas == "CO2" else ug
    return filled.withColumns(out)


@any_names
def flow_flux_by_river(
    df: DataFrame, river: str, flux: Mapping[str, str], areas: Mapping[str, float] = K.AREAS
) -> DataFrame:
    """Mean flux with error per river and gas, plain and in CO2-equivalent, per year, in percent.

    The survey is aggregated once, wide; every later step works on the summary.
    """
    summary = _weighted(mean_sem_wide(df, [river], _mass(flux), "gas"))
    yearly = annual_emission(
        summary, river, ["mean", "sem", "mean_co2eq", "sem_co2eq"], areas
    )
    return share_of_total(yearly, ["gas"], "mean_gg_yr", ["sem_gg_yr"])


@any_names
def flow_flux_overall(
    df: DataFrame, flux: Mapping[str, str], areas: Mapping[str, float] = K.AREAS
) -> DataFrame:
    """Mean flux per gas over all sites and the basin's yearly totals."""
    return basin_totals(mean_sem_wide(df, [], _mass(flux), "gas"), "gas", areas)


@any_names
def flow_flux_by_index(
    df: DataFrame, indexes: Mapping[str, str], flux: Mapping[str, str]
) -> DataFrame:
    """Mean flux with error per water-quality index, class and gas."""
    long = _labels_long(df, _mass(flux), indexes, "wqi", "label")
    summary = mean_sem_wide(long, ["wqi", "label"], {g: g for g in flux}, "gas")
    return _class_names(_weighted(summary))


@any_names
def index_totals(summary: DataFrame, divide_by: float = 1.0, zero_for: str = "Oregon Index") -> DataFrame:
    """CO2-equivalent means and errors added over gases, per index and class.

    Classes of the ``zero_for`` index keep a row when no error is known; classes of
    the other indexes do not.
    """
    totals = sum_of_means(
        summary,
        ["wqi", "label"],
        "mean_co2eq",
        "sem_co2eq",
        zero_where=F.col("wqi") == zero_for,
    )
    k = F.lit(float(divide_by))
    return totals.withColumns({"mean": F.col("mean") / k, "sem": F.col("sem") / k})


def _land_use(long: DataFrame) -> DataFrame:
    return recode_exact(long, "land_use", K.LAND_USE_CLASS)


@any_names
def flow_flux_by_landuse(
    df: DataFrame, banks: Mapping[str, str], flux: Mapping[str, str]
) -> DataFrame:
    """Mean flux with error per land-use class and gas; a site counts once per bank."""
    long = _land_use(_labels_long(df, _mass(flux), banks, "bank", "land_use"))
    return _weighted(mean_sem_wide(long, ["land_use"], {g: g for g in flux}, "gas"))


@any_names
def landuse_totals(summary: DataFrame, divide_by: float = 1.0) -> DataFrame:
    """CO2-equivalent means and errors added over gases, per land-use class."""
    k = F.lit(float(divide_by))
    out = sum_of_means(summary, ["land_use"], "mean_co2eq", "sem_co2eq", "omit")
    return out.withColumns({"mean": F.col("mean") / k, "sem": F.col("sem") / k})


@any_names
def flow_emission_share(
    df: DataFrame, river: str, flux: Mapping[str, str], areas: Mapping[str, float] = K.AREAS
) -> DataFrame:
    """Each river's part of the flux and of the area-weighted yearly emission."""
    mass = {g: c * F.lit(K.GWP[g]) for g, c in _mass(flux).items()}
    wide = df.select(F.col(river), *[c.alias(g) for g, c in mass.items()])
    return emission_share(wide, river, list(mass), areas).withColumnRenamed("variable", "gas")


@any_names
def flow_correlation(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """Spearman correlations that pass a Pearson significance test."""
    return corr_significant(df, cols, method="spearman", p_method="pearson", **options)


@any_names
def flow_dissolved_by_river(df: DataFrame, river: str, dissolved: Mapping[str, str]) -> DataFrame:
    """Mean dissolved gas with error per gas and river, and over all gases.

    The ``all`` rows average the CO2-equivalents of the three gases. They are pooled
    from the other rows, so the survey is read once.
    """
    by_gas = _weighted(mean_sem_wide(df, [river], _concentration(dissolved), "gas"))
    # One small exchange that both users of the summary share.
    by_gas = by_gas.repartition(river)
    together = pool_summaries(by_gas, [river], "mean_co2eq", "sem_co2eq").select(
        river,
        F.lit("all").alias("gas"),
        "n",
        F.col("mean").alias("mean_co2eq"),
        F.col("sem").alias("sem_co2eq"),
    )
    return by_gas.unionByName(together, allowMissingColumns=True)


@any_names
def flow_dissolved_by_index(
    df: DataFrame, indexes: Mapping[str, str], dissolved: Mapping[str, str]
) -> DataFrame:
    """Mean dissolved gas with error per index, class and gas."""
    long = _labels_long(df, _concentration(dissolved), indexes, "wqi", "label")
    summary = mean_sem_wide(long, ["wqi", "label"], {g: g for g in dissolved}, "gas")
    return _class_names(_weighted(summary))


@any_names
def dissolved_index_tests(
    df: DataFrame, indexes: Mapping[str, str], dissolved: Mapping[str, str], **options
) -> DataFrame:
    """Dunn's test between the classes of each index, per gas."""
    return _index_test(dunn_test_by_label, df, indexes, dissolved, **options)


@any_names
def dissolved_index_significant(
    df: DataFrame,
    indexes: Mapping[str, str],
    dissolved: Mapping[str, str],
    alpha: float = 0.05,
    **options,
) -> DataFrame:
    """The class pairs that differ after adjustment."""
    return significant_only(
        dissolved_index_tests(df, indexes, dissolved, **options), alpha=alpha
    )


@any_names
def flow_dissolved_by_landuse(
    df: DataFrame, banks: Mapping[str, str], dissolved: Mapping[str, str]
) -> DataFrame:
    """Mean dissolved gas with error per land-use class and gas."""
    long = _land_use(_labels_long(df, _concentration(dissolved), banks, "bank", "land_use"))
    return _weighted(mean_sem_wide(long, ["land_use"], {g: g for g in dissolved}, "gas"))


@any_names
def dissolved_landuse_tests(
    df: DataFrame, banks: Mapping[str, str], dissolved: Mapping[str, str], **options
) -> DataFrame:
    """Dunn's test between land-use classes per gas, both banks together."""
    return _landuse_test(dunn_test_by_label, df, banks, dissolved, **options)


@any_names
def dissolved_index_kruskal(
    df: DataFrame, indexes: Mapping[str, str], dissolved: Mapping[str, str], **options
) -> DataFrame:
    """Kruskal-Wallis test over the classes of each index, per gas."""
    return _index_test(kruskal_wallis_by_label, df, indexes, dissolved, **options)


@any_names
def dissolved_landuse_kruskal(
    df: DataFrame, banks: Mapping[str, str], dissolved: Mapping[str, str], **options
) -> DataFrame:
    """Kruskal-Wallis test over land-use classes per gas, both banks together."""
    return _landuse_test(kruskal_wallis_by_label, df, banks, dissolved, **options)


def _boxes(long: DataFrame, keys: Sequence[str], gases: Sequence[str], co2_equivalent: bool, **options) -> DataFrame:
    """Box statistics per key and gas of measures that stand side by side."""
    if co2_equivalent:
        long = long.withColumns({g: F.col(g) * F.lit(K.GWP[g]) for g in gases})
    return box_stats(_gases_long(long, keys, gases), [*keys, "gas"], "concentration", **options)


def _side_boxes(
    df: DataFrame,
    measures: Mapping[str, Column],
    labels: Mapping[str, str],
    name: str,
    label: str,
    keys: Sequence[str],
    co2_equivalent: bool,
    classes: Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """Box statistics per key and gas for label columns that stand side by side."""
    if co2_equivalent:
        measures = {g: c * F.lit(K.GWP[g]) for g, c in measures.items()}
    if options.get("approx"):
        long = _labels_long(df, measures, labels, name, label)
        long = recode_exact(long, label, classes) if classes else long
        return _boxes(long, keys, list(measures), False, **options)
    cells = _folded(df, measures, labels, classes)
    long = to_long(cells, ["gas", "concentration", "n"], list(labels), name, label)
    return box_stats(long, [*keys, "gas"], "concentration", weight="n", folded=True, **options)


def _measures(columns: Mapping[str, str], dissolved: bool) -> dict[str, Column]:
    return _concentration(columns) if dissolved else _mass(columns)


@any_names
def boxes_by_river(
    df: DataFrame,
    river: str,
    columns: Mapping[str, str],
    dissolved: bool = False,
    co2_equivalent: bool = False,
    order: Sequence[str] = K.TRIBUTARY_ORDER,
    **options,
) -> DataFrame:
    """Boxes of the fluxes (or dissolved gases) per river and gas, rivers in order."""
    measures = _measures(columns, dissolved)
    wide = df.select(F.col(f"`{river}`").alias("river"), *[c.alias(g) for g, c in measures.items()])
    return order_levels(_boxes(wide, ["river"], list(columns), co2_equivalent, **options), "river", order)


@any_names
def boxes_by_index(
    df: DataFrame,
    indexes: Mapping[str, str],
    columns: Mapping[str, str],
    dissolved: bool = False,
    co2_equivalent: bool = False,
    **options,
) -> DataFrame:
    """Boxes per index, class and gas, classes in order."""
    measures = _measures(columns, dissolved)
    boxes = _side_boxes(df, measures, indexes, "wqi", "label", ["wqi", "label"], co2_equivalent, **options)
    return order_levels(boxes, "label", K.PRATI_LEVELS + K.OREGON_LEVELS)


@any_names
def boxes_by_landuse(
    df: DataFrame,
    banks: Mapping[str, str],
    columns: Mapping[str, str],
    dissolved: bool = False,
    co2_equivalent: bool = False,
    by_bank: bool = False,
    **options,
) -> DataFrame:
    """Boxes per land-use class and gas, classes in order; ``by_bank`` for each bank apart."""
    measures = _measures(columns, dissolved)
    keys = ["bank", "land_use"] if by_bank else ["land_use"]
    boxes = _side_boxes(df, measures, banks, "bank", "land_use", keys, co2_equivalent, K.LAND_USE_CLASS, **options)
    return order_levels(boxes, "land_use", K.LAND_USE_LEVELS)


@any_names
def flow_oxygen_by_index(df: DataFrame, oxygen: str, indexes: Mapping[str, str], **options) -> DataFrame:
    """Box statistics of dissolved oxygen per index and class, classes in order."""
    long = _labels_long(df, {"DO": F.col(oxygen)}, indexes, "wqi", "label")
    boxes = box_stats(long, ["wqi", "label"], "DO", **options)
    return order_levels(boxes, "label", K.PRATI_LEVELS + K.OREGON_LEVELS)


@any_names
def feature_table(
    df: DataFrame,
    gas: str,
    columns: Mapping[str, str],
    index: str,
    banks: Sequence[str],
    target: str,
) -> DataFrame:
    """Model input for one gas: predictors, WQI, Land, target; one row per bank.

    ``columns`` maps the short predictor names to the survey's. Two right joins to the
    class tables: a land use that no site has still gets a row. A quality class that
    no site has would get one too, but it has no bank, so the second join drops it;
    the first is therefore an inner join.
    """
    spark = df.sparkSession
    predictors = K.FEATURE_COLUMNS[gas]
    wqi = lookup_table(
        spark, [(v, str(i)) for i, v in enumerate(K.PRATI_LEVELS, 1)], "_index string, WQI string"
    )
    land = lookup_table(
        spark,
        [(v, str(K.LAND_USE_LEVELS.index(c) + 1)) for v, c in K.LAND_USE_CLASS.items()],
        "_use string, Land string",
    )
    picked = df.select(
        *[F.col(f"`{columns[p]}`").alias(p) for p in predictors],
        F.col(f"`{target}`").alias(gas),
        F.col(f"`{index}`").alias("_index"),
        *[F.col(f"`{b}`").alias(f"_bank{i}") for i, b in enumerate(banks)],
    )
    indexed = picked.join(wqi, "_index", "inner")
    keep = [*predictors, "WQI", gas]
    long = to_long(indexed, keep, [f"_bank{i}" for i in range(len(banks))], "_bank", "_use")
    return right_lookup(long, land, "_use").select(*predictors, "WQI", "Land", gas)


@any_names
def flow_landuse_mosaic(df: DataFrame, river: str, banks: Mapping[str, str]) -> DataFrame:
    """Land-use classes of both banks per river, with shares."""
    long = _labels_long(df, {"river": F.col(river)}, banks, "bank", "land_use")
    return contingency_share(_land_use(long), "river", "land_use")


@any_names
def site_values(
    df: DataFrame,
    site: str,
    lat: str,
    lon: str,
    variable: str,
    k: float = 60.0,
    where: Column | None = None,
) -> DataFrame:
    """Map feed of one variable: position, value and marker size of complete sites.

    ``where`` restricts the map, to one tributary for instance; sizes are relative
    to the largest value shown.
    """
    rows = df if where is None else df.filter(where)
    feed = rows.select(
        F.col(f"`{site}`").alias("site"),
        F.col(f"`{lat}`").alias("latitude"),
        F.col(f"`{lon}`").alias("longitude"),
        F.col(f"`{variable}`").alias("value"),
    )
    return symbol_size(complete_cases(feed, ["value"]), ["value"], k, suffix="_size").withColumnRenamed(
        "value_size", "size"
    )


@any_names
def site_values_many(
    df: DataFrame, site: str, lat: str, lon: str, variables: Sequence[str], k: float = 60.0
) -> DataFrame:
    """:func:`site_values` of several variables in one job, each on its own scale."""
    places = {"site": site, "latitude": lat, "longitude": lon}
    sized = symbol_size(df, variables, k)
    lines = [
        F.struct(
            F.lit(v).alias("variable"),
            number(v).alias("value"),
            F.col(f"`{v}_size`").alias("size"),
        )
        for v in variables
    ]
    feed = sized.select(*[F.col(f"`{c}`").alias(n) for n, c in places.items()], F.inline(F.array(*lines)))
    return feed.filter(F.col("value").isNotNull())


@any_names
def site_gwp_values(
    df: DataFrame,
    site: str,
    lat: str,
    lon: str,
    gases: Mapping[str, str],
    k: float = 100.0,
    co2_equivalent: bool = True,
) -> DataFrame:
    """Map feed of several gases on one scale, by default in CO2-equivalent."""
    feed = df.select(
        F.col(f"`{site}`").alias("site"),
        F.col(f"`{lat}`").alias("latitude"),
        F.col(f"`{lon}`").alias("longitude"),
        *[
            (F.col(f"`{c}`") * F.lit(K.GWP[g] if co2_equivalent else 1.0)).alias(g)
            for g, c in gases.items()
        ],
    )
    return symbol_size(feed, list(gases), k, shared_max=True)
