"""Satellite orbits and clocks from broadcast elements (IS-GPS-200), as Spark columns; seconds, metres and radians.

Elements are a struct with the fields of `sources.rinex.ELEMENTS` and `satellite`, `toe`, `toc`, both in seconds since
the start of GPS time. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geometry import let

#: Speed of light, rate of the earth's rotation, gravitation for GPS and for BeiDou, relativistic constant, seconds a week.
LIGHT, EARTH_RATE, GM, GM_BEIDOU, RELATIVITY, WEEK = 299792458.0, 7.2921151467e-5, 3.986005e14, 3.986004418e14, -4.442807633e-10, 604800.0
#: Steps of Newton's method for Kepler's equation, which doubles its digits each time.
KEPLER_STEPS = 10
#: BeiDou time lags GPS time by so many seconds; its geostationary satellites need another frame and are left out.
BEIDOU_LAG, BEIDOU_STILL = 14.0, r"^C(0[1-5]|59|6[0-9])$"


def gps_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 6 January 1980 of a calendar time of the same scale, so without leap seconds; null if there is no such day."""
    day_no = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")) - 3657
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), day_no * 86400.0 + hour * 3600.0 + minute * 60.0 + second)


def eccentric_anomaly(mean: Column, e: Column) -> Column:
    """E with E - e sin E = mean."""
    better = lambda v, _: v - (v - e * F.sin(v) - mean) / (1 - e * F.cos(v))
    return F.aggregate(F.sequence(F.lit(1), F.lit(KEPLER_STEPS)), mean, better)


def _anomaly(el: Column, age: Column) -> Column:
    gravitation = F.when(el["satellite"].startswith("C"), GM_BEIDOU).otherwise(GM)
    a = el["sqrt_a"] * el["sqrt_a"]
    return eccentric_anomaly(el["m0"] + (F.sqrt(gravitation / (a * a * a)) + el["delta_n"]) * age, el["e"])


def position(elements: Column, t: Column) -> Column:
    """(x, y, z) at time t in the earth-fixed frame of that time."""

    def placed(v: Column) -> Column:
        el, age, ea = v["el"], v["age"], v["ea"]
        phi = F.atan2(F.sqrt(1 - el["e"] * el["e"]) * F.sin(ea), F.cos(ea) - el["e"]) + el["omega"]
        lag = F.when(el["satellite"].startswith("C"), BEIDOU_LAG).otherwise(0.0)
        node = el["omega0"] + (el["omega_dot"] - EARTH_RATE) * age - EARTH_RATE * F.pmod(el["toe"] - lag, F.lit(WEEK))
        return let(F.struct(el.alias("el"), age.alias("age"), ea.alias("ea"), phi.alias("phi"), node.alias("node")), corrected)

    def corrected(w: Column) -> Column:
        el = w["el"]
        radius = el["sqrt_a"] * el["sqrt_a"] * (1 - el["e"] * F.cos(w["ea"])) + _wave(w, "crs", "crc")
        tilt = el["i0"] + el["idot"] * w["age"] + _wave(w, "cis", "cic")
        return let(F.struct((w["phi"] + _wave(w, "cus", "cuc")).alias("u"), radius.alias("r"), tilt.alias("i"), w["node"].alias("node")), _fixed)

    age = t - elements["toe"]
    start = F.struct(elements.alias("el"), age.alias("age"), _anomaly(elements, age).alias("ea"))
    return F.when(t.isNotNull() & ~elements["satellite"].rlike(BEIDOU_STILL), let(start, placed))


def _wave(w: Column, sine: str, cosine: str) -> Column:
    """A correction of second order in the argument of latitude."""
    return w["el"][sine] * F.sin(2 * w["phi"]) + w["el"][cosine] * F.cos(2 * w["phi"])


def _fixed(o: Column) -> Column:
    """From the orbit's plane to the earth-fixed frame."""
    x, y = o["r"] * F.cos(o["u"]), o["r"] * F.sin(o["u"])
    return F.struct(
        (x * F.cos(o["node"]) - y * F.cos(o["i"]) * F.sin(o["node"])).alias("x"),
        (x * F.sin(o["node"]) + y * F.cos(o["i"]) * F.cos(o["node"])).alias("y"),
        (y * F.sin(o["i"])).alias("z"),
    )


def clock(elements: Column, t: Column) -> Column:
    """Seconds by which the satellite's clock is ahead at time t, with the relativistic part and the group delay."""
    age = t - elements["toc"]
    drift = elements["af0"] + elements["af1"] * age + elements["af2"] * age * age
    return drift + RELATIVITY * elements["e"] * elements["sqrt_a"] * F.sin(_anomaly(elements, t - elements["toe"])) - elements["tgd"]


def turned_by_travel(p: Column, receiver: Column) -> Column:
    """A position of the time of sending in the frame of the time of receipt: the earth has turned meanwhile."""
    squared = (p["x"] - receiver["x"]) * (p["x"] - receiver["x"]) + (p["y"] - receiver["y"]) * (p["y"] - receiver["y"]) + (p["z"] - receiver["z"]) * (p["z"] - receiver["z"])

    def turned(v: Column) -> Column:
        s, c = F.sin(v["angle"]), F.cos(v["angle"])
        return F.struct((c * v["p"]["x"] + s * v["p"]["y"]).alias("x"), (c * v["p"]["y"] - s * v["p"]["x"]).alias("y"), v["p"]["z"].alias("z"))

    return let(F.struct(p.alias("p"), (EARTH_RATE * F.sqrt(squared) / LIGHT).alias("angle")), turned)
