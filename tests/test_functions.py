"""Formulas, projections, recodes and tail probabilities."""

import math

import pytest
from pyspark.sql import functions as F

from fieldstats import constants as K
from fieldstats.functions import domain as D
from fieldstats.functions.recode import replace_sequence
from fieldstats.functions.tails import chi_square_upper, normal_upper, student_two_sided
from fieldstats.operators.recoding import order_levels, recode_exact
from fieldstats.operators.summary import from_co2_equivalent, to_co2_equivalent


def forward_utm(lat, lon, zone=17, south=True):
    """Transverse Mercator by direct integration-free series in e'^2 (Snyder 8-9 to 8-15)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, dl = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2
    big_a = dl * math.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi)
        - (35 * e2**3 / 3072) * math.sin(6 * phi)
    )
    x = 0.9996 * n * (
        big_a
        + (1 - t + c) * big_a**3 / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * big_a**5 / 120
    )
    y = 0.9996 * (
        m
        + n
        * math.tan(phi)
        * (
            big_a**2 / 2
            + (5 - t + 9 * c + 4 * c * c) * big_a**4 / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * big_a**6 / 720
        )
    )
    return x + 500000.0, y + (1e7 if south else 0.0)


def test_utm_inverts_the_forward_projection(spark):
    points = [(-2.98863, -79.07146), (-2.8124, -78.8772), (-2.9, -81.0), (-0.01, -83.5), (-60.0, -79.5)]
    rows = [(lat, lon, *forward_utm(lat, lon)) for lat, lon in points]
    df = spark.createDataFrame(rows, "lat double, lon double, x double, y double")
    lat, lon = D.utm_to_latlon("x", "y")
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("o")).collect():
        assert (r["a"], r["o"]) == pytest.approx((r["lat"], r["lon"]), abs=1e-7)
    north = [(10.0, -80.0, *forward_utm(10.0, -80.0, south=False))]
    df = spark.createDataFrame(north, "lat double, lon double, x double, y double")
    lat, lon = D.utm_to_latlon("x", "y", south=False)
    [r] = df.select(lat.alias("a"), lon.alias("o")).collect()
    assert (r["a"], r["o"]) == pytest.approx((10.0, -80.0), abs=1e-7)


def test_dissolved_gas_against_plain_python(spark):
    temp, ppm = 16.5, 900.0
    df = spark.createDataFrame([(ppm, temp)], "ppm double, t double")
    for gas in ("N2O", "CH4", "CO2"):
        a, b, c, d = K.HENRY[gas]
        tk = temp + 273.15
        h = 1 / math.exp((a + b / tk + c * math.log(tk) + d * tk) / 1.98719)
        cg = ppm * 1e-6 * 2
        m = {"N2O": 44, "CH4": 16, "CO2": 44}[gas]
        want = (55.5 * cg / h * m * 1e3 + cg * m / 22.4 * 273.15 / tk * 1e3) * 1e3
        [r] = df.select(D.dissolved_ug_l("ppm", "t", gas).alias("ug")).collect()
        assert r["ug"] == pytest.approx(want, rel=1e-12)


def test_mass_flux_and_ppm(spark):
    df = spark.createDataFrame([(1000.0,)], "v double")
    [r] = df.select(
        D.molar_to_mass_flux("v", "CH4").alias("a"),
        D.dissolved_ppm("v", "N2O").alias("b"),
        D.dissolved_ppm("v", "CO2").alias("c"),
        D.per_year("v", 2.0).alias("d"),
    ).collect()
    assert tuple(r) == pytest.approx((16.0, 24450 / 44.013, 581.68 - 5.2707, 0.73))


def test_co2_equivalent_round_trip(spark):
    df = spark.createDataFrame(
        [("CO2", 3.0), ("CH4", 5.5), ("N2O", 0.25), ("SF6", 1.0)], "gas string, v double"
    )
    there = to_co2_equivalent(df, "gas", "v")
    assert {r["gas"]: r["v"] for r in there.collect()} == {
        "CO2": 3.0, "CH4": 154.0, "N2O": 66.25, "SF6": None,
    }
    back = {r["gas"]: r["v"] for r in from_co2_equivalent(there, "gas", "v").collect()}
    assert back == {"CO2": 3.0, "CH4": 5.5, "N2O": 0.25, "SF6": None}


def test_sequential_replacement_keeps_its_trap(spark):
    df = spark.createDataFrame([(v,) for v in K.PRATI_LEVELS], "v string")
    reverse = [(new, old) for old, new in K.OREGON_REPLACEMENTS]
    got = [r[0] for r in df.select(replace_sequence("v", reverse)).collect()]
    assert got == ["Good Quality", "Good", "Fair", "Heavily Fair", "Very Heavily Fair"]
    exact = recode_exact(df, "v", {new: old for old, new in K.OREGON_REPLACEMENTS}, keep_unmatched=True)
    assert sorted(r[0] for r in exact.collect()) == ["Fair", "Good", "Good Quality", "Poor", "Very Poor"]


def test_forward_replacement(spark):
    df = spark.createDataFrame([(v,) for v in K.OREGON_LEVELS], "v string")
    got = [r[0] for r in df.select(replace_sequence("v", K.OREGON_REPLACEMENTS)).collect()]
    assert got == [K.OREGON_TO_PRATI[v] for v in K.OREGON_LEVELS]


def test_levels_outside_the_list_become_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string")
    got = {(r["v"], r["ord"]) for r in order_levels(df, "v", ["b", "a"], ["B", "A"]).collect()}
    assert got == {("A", 2), ("B", 1), (None, None)}


def test_normal_tail(spark):
    zs = [-3.0, -0.5, 0.0, 0.3, 1.0, 1.96, 3.5, 8.0, 20.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal_upper(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-10)


def test_chi_square_tail(spark):
    rows = [(x, float(df)) for x in (0.0, 0.1, 1.0, 4.0, 25.0, 200.0) for df in (2, 4, 10, 400)]
    df = spark.createDataFrame(rows, "x double, df double")
    for r in df.select("x", "df", chi_square_upper(F.col("x"), F.col("df")).alias("p")).collect():
        half, term, total = r["x"] / 2, 1.0, 0.0
        for i in range(int(r["df"]) // 2):
            total += term
            term *= half / (i + 1)
        assert r["p"] == pytest.approx(math.exp(-half) * total, rel=1e-9, abs=1e-300)


def _student(t, df, steps=200_000):
    """Simpson's rule over theta = atan(t / sqrt(df))."""
    top = math.atan(abs(t) / math.sqrt(df))
    h = top / steps
    s = sum(
        (1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(i * h) ** (df - 1)
        for i in range(steps + 1)
    )
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 1 - 2 * norm * s * h / 3


def test_student_tail(spark):
    rows = [(t, float(df)) for t in (0.0, 0.4, -2.2, 6.0) for df in (1, 3, 34, 998)]
    df = spark.createDataFrame(rows, "t double, df double")
    for r in df.select("t", "df", student_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r["p"] == pytest.approx(_student(r["t"], r["df"], 2000), rel=1e-7, abs=1e-12)


def test_student_tail_is_continuous_where_the_method_changes(spark):
    rows = [(t, d) for t in (0.5, 2.0, 5.0) for d in (100000.0, 100001.0)]
    df = spark.createDataFrame(rows, "t double, df double")
    got = {}
    for r in df.select("t", "df", student_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        got.setdefault(r["t"], []).append(r["p"])
    for a, b in got.values():
        assert a == pytest.approx(b, rel=1e-6)
