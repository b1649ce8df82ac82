"""Physical parameters of a whole catalog in one projection (ID I1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.models import a_over_r
from fluxloom.operators.spectra import seismic_columns

EARTH_IN_SUN = 0.0091577  # fixed values from here on
EARTH_MASS_SUN = 3.00348e-6
SOLAR_RADIUS_AU = 0.00465047


def c(name: str) -> Column:
    return F.col(name)


def derive_parameters(catalog: DataFrame) -> DataFrame:
    """Add durations, limb darkening, orbit, signal-size and check columns.

    A row outside a formula's domain gets NULL there and a ``reason``.
    """
    positive = (c("period") > 0) & (c("r_star") > 0) & (c("m_star") > 0) & (c("r_planet") > 0) & (c("m_planet") > 0) & (c("a_au") > 0) & (c("distance_pc") > 0) & (c("t_eq") > 0)
    orbit = (c("e") >= 0) & (c("e") < 1)
    reason = F.when(~positive, "non-positive physical input").when(~orbit, "eccentricity outside [0, 1)").when(c("b") < 0, "negative impact parameter")
    ok = c("reason").isNull()
    safe = lambda v: F.when(ok, c(v))
    sin_w = F.sin(F.radians("omega_deg"))
    e2 = 1 - c("e") * c("e")
    low = 1 + c("e") * sin_w
    sqrt_q1 = F.when(c("q1").between(0, 1) & c("q2").between(0, 1), F.sqrt(F.when(c("q1") >= 0, c("q1"))))
    gravity = c("m_planet") * (6.67430e-11 * 5.9722e24) / F.pow(c("r_planet") * 6.3710e6, F.lit(2.0))
    both = F.hypot("sigma_odd", "sigma_even")
    good = ok & (c("m_star_err") > 0) & (c("r_star_err") > 0)
    part = lambda v, s, f: F.pow(c(s) * f / F.when(good, c(v)), F.lit(2.0))
    seismic = seismic_columns(c("numax_uhz"), c("dnu_uhz"), c("teff_k"), c("m_star"), c("r_star"))
    # a few wide projections: each level only uses columns of the levels before it
    x = catalog.withColumn("reason", reason).withColumns({
        "k": F.when(ok, c("r_planet") * EARTH_IN_SUN / c("r_star")),
        "rho_solar": F.when(ok, c("m_star") / (c("r_star") * c("r_star") * c("r_star"))),
        "stretch": F.when(ok, F.sqrt(F.when(ok, e2)) / low),
        "u1": sqrt_q1 * 2 * c("q2"), "u2": sqrt_q1 * (1 - c("q2") * 2),
        "astrometric_uas": F.when(ok, c("m_planet") * EARTH_MASS_SUN / c("m_star") * c("a_au") / c("distance_pc") * 1e6),
        "scale_height_km": F.when(ok, c("t_eq") * 1.380649e-23 / (gravity * (2.3 * 1.673557e-27)) / 1000.0),
        "centroid_z": F.when(c("sigma_arcsec") > 0, F.hypot(c("ra_offset") * F.cos(F.radians("dec")), c("dec_offset")) / F.when(c("sigma_arcsec") > 0, c("sigma_arcsec"))),
        "odd_even_z": F.when((c("sigma_odd") > 0) & (c("sigma_even") > 0), F.abs(c("depth_odd") - c("depth_even")) / F.when(both > 0, both)),
        "habitable_zone": F.when(c("insolation") > 0, c("insolation").between(0.32, 1.11)),
        "log10_density_sigma": F.sqrt(part("m_star", "m_star_err", 1.0) + part("r_star", "r_star_err", 3.0)) / math.log(10.0),
        **{f"seismic_{n}": v for n, v in seismic.items()},
    })
    chord = lambda s: F.sqrt(F.greatest((1 + s * c("k")) * (1 + s * c("k")) - c("b") * c("b"), F.lit(0.0)))
    hours = lambda s: c("period") * 24.0 / math.pi / c("a_rs") * chord(s) * c("stretch")
    x = x.withColumns({
        "a_rs": a_over_r(c("rho_solar"), c("period")), "grazing": c("b") > 1 - c("k"),
        "transmission_ppm": c("r_planet") * 6371.0 * 10.0 * c("scale_height_km") / F.pow(c("r_star") * 695700.0, F.lit(2.0)) * 1e6,
        "centroid_p": F.exp(c("centroid_z") * c("centroid_z") * -0.5), "centroid_pass": c("centroid_z") < 3.0, "odd_even_pass": c("odd_even_z") < 3.0,
    })
    x = x.withColumns({
        "t14_hours": F.when(c("b") >= 1 + c("k"), F.when(ok, 0.0)).otherwise(hours(1.0)),
        "t23_hours": F.when(c("grazing"), 0.0).otherwise(hours(-1.0)),
        "distance_rs": F.when(ok & (low > 0), c("a_rs") * e2 / F.when(low > 0, low)),
    })
    cos_i = c("b") / c("distance_rs")
    inside = (cos_i >= 0) & (cos_i < 1)
    x = x.withColumns({"t12_hours": (c("t14_hours") - c("t23_hours")) * 0.5, "inclination_deg": F.when(inside, F.degrees(F.acos(F.when(inside, cos_i))))})
    sin_i = F.sin(F.radians("inclination_deg"))
    ratio = c("r_star") * SOLAR_RADIUS_AU / c("a_au")
    x = x.withColumns({
        "rv_semi_amplitude": c("m_planet") * sin_i * 0.0895 * F.pow(safe("m_star"), F.lit(-2.0 / 3.0)) * F.pow(safe("period"), F.lit(-1.0 / 3.0)) / F.sqrt(F.when(ok, e2)),
        "ellipsoidal_ppm": F.when(ok, c("m_planet") * EARTH_MASS_SUN / c("m_star") * ratio * ratio * ratio * sin_i * sin_i * 1.2e6),
    })
    return x.withColumn("ellipsoidal_pass", c("ellipsoidal_ppm") < 100.0).drop("stretch")
