"""Gas chemistry, unit conversion and map projection as Column expressions.

All functions return native expressions, so a whole chain of them runs inside one
generated stage without leaving the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstats import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_key(key: Column | str, values: Mapping[str, float]) -> Column:
    """The constant that belongs to ``key``; null for a key that is not listed."""
    key = _col(key)
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(key == F.lit(name), F.lit(float(value))).otherwise(out)
    return out


def henry_coefficient(temp_c: Column | str, gas: str) -> Column:
    """Henry's law coefficient of ``gas`` at a water temperature in degrees Celsius."""
    a, b, c, d = K.HENRY[gas]
    kelvin = _col(temp_c) + F.lit(K.KELVIN)
    exponent = F.lit(a) + F.lit(b) / kelvin + F.lit(c) * F.log(kelvin) + F.lit(d) * kelvin
    return F.lit(1.0) / F.exp(exponent / F.lit(K.GAS_CONSTANT_CAL))


def headspace_gas(ppm: Column | str, pressure: float = 2.0) -> Column:
    """Gas volume per sample volume in the headspace."""
    return _col(ppm) * F.lit(1e-6) * F.lit(float(pressure))


def dissolved_ug_l(
    ppm: Column | str,
    temp_c: Column | str,
    gas: str,
    v_head: float = 6.0,
    v_aq: float = 6.0,
    pressure: float = 2.0,
) -> Column:
    """Dissolved gas (ug per litre) before the headspace was added.

    Sum of what stayed in the water and what moved to the headspace.
    """
    mass = K.AQUEOUS_MOLAR_MASS[gas]
    head = headspace_gas(ppm, pressure)
    kelvin = _col(temp_c) + F.lit(K.KELVIN)
    in_water = F.lit(K.WATER_MOLARITY) * (head / henry_coefficient(temp_c, gas)) * F.lit(mass * 1e3)
    in_head = (
        F.lit(v_head / v_aq)
        * head
        * F.lit(mass / K.MOLAR_VOLUME_STP)
        * (F.lit(K.KELVIN) / kelvin)
        * F.lit(1e3)
    )
    return (in_water + in_head) * F.lit(1e3)


def dissolved_ppm(ug_l: Column | str, gas: str) -> Column:
    """Dissolved gas in ppm from ug per litre."""
    if gas == "CO2":
        slope, intercept = K.PPM_CO2_LINE
        return F.lit(slope) * _col(ug_l) / F.lit(1000.0) + F.lit(intercept)
    return _col(ug_l) * F.lit(K.MOLAR_VOLUME_25C) / F.lit(K.PPM_MOLAR_MASS[gas])


def molar_to_mass_flux(flux_umol: Column | str, gas: str) -> Column:
    """Flux in mg from a flux in umol."""
    return _col(flux_umol) * F.lit(K.FLUX_MOLAR_MASS[gas]) / F.lit(1000.0)


def co2_equivalent(value: Column | str, gas: Column | str, gwp: Mapping[str, float] = K.GWP) -> Column:
    """``value`` weighted by the warming potential of the gas named in ``gas``."""
    return _col(value) * by_key(gas, gwp)


def undo_co2_equivalent(
    value: Column | str, gas: Column | str, gwp: Mapping[str, float] = K.GWP
) -> Column:
    """Inverse of :func:`co2_equivalent`."""
    return _col(value) / by_key(gas, gwp)


def per_year(value: Column | str, area_km2: Column | float) -> Column:
    """Gg per year from mg per m2 and day over an area in km2."""
    area = F.lit(float(area_km2)) if isinstance(area_km2, (int, float)) else area_km2
    return _col(value) * F.lit(K.DAYS_PER_YEAR) / F.lit(1e6) * area


def utm_to_latlon(
    easting: Column | str, northing: Column | str, zone: int = 17, south: bool = True
) -> tuple[Column, Column]:
    """Latitude and longitude (degrees, WGS84) of a UTM position.

    Krueger's series in the third flattening, fourth order: well below a
    millimetre inside a zone.
    """
    a, flat = 6378137.0, 1 / 298.257223563
    n = flat / (2 - flat)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    false_north = 1e7 if south else 0.0
    xi = (_col(northing) - F.lit(false_north)) / F.lit(0.9996 * radius)
    eta = (_col(easting) - F.lit(500000.0)) / F.lit(0.9996 * radius)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta_p = eta_p - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    # Conformal latitude to geodetic latitude.
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    phi = chi
    for j, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    central = math.radians(zone * 6 - 183)
    lam = F.lit(central) + F.atan2(F.sinh(eta_p), F.cos(xi_p))
    return F.degrees(phi), F.degrees(lam)
