"""Geodetic and error-model formulas as Spark columns (published closed forms)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius and metres in a degree, WGS-84 axes, bounds of the GCJ-02 datum, K of the
# protection level.
EARTH_RADIUS, METRES_PER_DEGREE = 6_371_000.0, 111_320.0
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
GCJ_AXIS, GCJ_ECCENTRICITY = 6_378_245.0, 0.00669342162296594323
PROTECTION_K = 3.72

ECCENTRICITY = FLATTENING * (2 - FLATTENING)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def is_projected(x: Column, y: Column) -> Column:
    """Coordinates beyond degrees are taken as projected."""
    return (F.abs(x) > 180) | (F.abs(y) > 90)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; -1 outside latitudes (-80, 84)."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))
    return F.when((lat <= -80) | (lat >= 84), F.lit(-1)).otherwise(F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone)


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the forward and inverse coefficients of the transverse Mercator series, third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ahead = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, ahead, back


def utm_forward(lon: Column, lat: Column, central: Column) -> Column:
    """(x, y) in metres of the transverse Mercator projection with the given central meridian (north, scale 0.9996)."""
    radius, ahead, _ = _series()
    e = math.sqrt(ECCENTRICITY)
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ahead, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000 + 0.9996 * radius * x).alias("x"), (0.9996 * radius * y).alias("y"))


def utm_inverse(x: Column, y: Column, central: Column) -> Column:
    """(lon, lat) of projected coordinates."""
    radius, _, back = _series()
    xi0, eta0 = y / (0.9996 * radius), (x - 500_000) / (0.9996 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(back, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    e2 = ECCENTRICITY
    terms = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12, 7 * e2**2 / 48 + 29 * e2**3 / 240, 7 * e2**3 / 120)
    lat = chi
    for j, c in enumerate(terms, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.struct((central + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"), F.degrees(lat).alias("lat"))


def projected_covariance(lon: Column, lat: Column, central: Column, see: Column, snn: Column, sen: Column, step: float = 1e-6) -> Column:
    """(vee, vnn, ven, scale): covariance in metres by the numerical Jacobian of the projection, and its larger column norm."""
    base, east, north = utm_forward(lon, lat, central), utm_forward(lon + step, lat, central), utm_forward(lon, lat + step, central)
    a, c = (east["x"] - base["x"]) / step, (east["y"] - base["y"]) / step
    b, d = (north["x"] - base["x"]) / step, (north["y"] - base["y"]) / step
    return F.struct(
        (a * a * see + 2 * a * b * sen + b * b * snn).alias("vee"),
        (c * c * see + 2 * c * d * sen + d * d * snn).alias("vnn"),
        (a * c * see + (a * d + b * c) * sen + b * d * snn).alias("ven"),
        F.greatest(F.sqrt(a * a + c * c), F.sqrt(b * b + d * d)).alias("scale"),
    )


#: Bounds within which the datum shifts (fixed values).
GCJ_LON, GCJ_LAT = (73.66, 135.05), (3.86, 53.55)


def gcj02_to_wgs84(lon: Column, lat: Column) -> Column:
    """(lon, lat); unchanged outside the bounds of the datum."""
    x, y, pi = lon - 105.0, lat - 35.0, math.pi
    wave = lambda v, parts: sum((w * F.sin(v * k * pi) for w, k in parts), F.lit(0.0))
    shared = wave(x, ((20.0, 6.0), (20.0, 2.0))) * 2.0 / 3.0
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + shared
    dlat = dlat + wave(y, ((20.0, 1.0), (40.0, 1 / 3.0))) * 2.0 / 3.0 + wave(y, ((160.0, 1 / 12.0), (320.0, 1 / 30.0))) * 2.0 / 3.0
    dlon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + shared
    dlon = dlon + wave(x, ((20.0, 1.0), (40.0, 1 / 3.0))) * 2.0 / 3.0 + wave(x, ((150.0, 1 / 12.0), (300.0, 1 / 30.0))) * 2.0 / 3.0
    rad = F.radians(lat)
    magic = 1 - GCJ_ECCENTRICITY * F.pow(F.sin(rad), 2)
    dlat = dlat * 180.0 / (GCJ_AXIS * (1 - GCJ_ECCENTRICITY) / (magic * F.sqrt(magic)) * pi)
    dlon = dlon * 180.0 / (GCJ_AXIS / F.sqrt(magic) * F.cos(rad) * pi)
    inside = lon.between(*GCJ_LON) & lat.between(*GCJ_LAT)
    return F.struct(F.when(inside, lon - dlon).otherwise(lon).alias("lon"), F.when(inside, lat - dlat).otherwise(lat).alias("lat"))


def lla_to_ecef(lon: Column, lat: Column, height: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    normal = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY * F.pow(F.sin(phi), 2))
    return F.struct(
        ((normal + height) * F.cos(phi) * F.cos(lam)).alias("x"),
        ((normal + height) * F.cos(phi) * F.sin(lam)).alias("y"),
        ((normal * (1 - ECCENTRICITY) + height) * F.sin(phi)).alias("z"),
    )


def ecef_to_lla(x: Column, y: Column, z: Column) -> Column:
    """(lon, lat, height) by Bowring's formula; within a nanodegree and a millimetre for heights from -10 to 1000 km."""
    minor = SEMI_MAJOR * (1 - FLATTENING)
    level = F.sqrt(x * x + y * y)
    reduced = F.atan2(z * SEMI_MAJOR, level * minor)
    second = ECCENTRICITY / (1 - ECCENTRICITY)
    phi = F.atan2(z + second * minor * F.pow(F.sin(reduced), 3), level - ECCENTRICITY * SEMI_MAJOR * F.pow(F.cos(reduced), 3))
    height = level * F.cos(phi) + z * F.sin(phi) - SEMI_MAJOR * F.sqrt(1 - ECCENTRICITY * F.pow(F.sin(phi), 2))
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(phi).alias("lat"), height.alias("height"))


def ecef_to_enu(dx: Column, dy: Column, dz: Column, lon: Column, lat: Column) -> Column:
    """(east, north, up) of an ECEF difference seen from (lon, lat)."""
    phi, lam = F.radians(lat), F.radians(lon)
    flat = F.cos(lam) * dx + F.sin(lam) * dy
    return F.struct(
        (-F.sin(lam) * dx + F.cos(lam) * dy).alias("east"),
        (-F.sin(phi) * flat + F.cos(phi) * dz).alias("north"),
        (F.cos(phi) * flat + F.sin(phi) * dz).alias("up"),
    )


def azimuth_elevation(enu: Column) -> Column:
    level = F.sqrt(enu["east"] * enu["east"] + enu["north"] * enu["north"])
    return F.struct(F.degrees(F.atan2(enu["east"], enu["north"])).alias("azimuth"), F.degrees(F.atan2(enu["up"], level)).alias("elevation"))


def ellipse_to_covariance(major: Column, minor: Column, bearing: Column) -> Column:
    """(sigma_e, sigma_n, cov_en) of an error ellipse; the bearing is in degrees from north."""
    t = F.radians(bearing)
    east = F.pow(major * F.sin(t), 2) + F.pow(minor * F.cos(t), 2)
    north = F.pow(major * F.cos(t), 2) + F.pow(minor * F.sin(t), 2)
    return F.struct(F.sqrt(east).alias("sigma_e"), F.sqrt(north).alias("sigma_n"), ((major * major - minor * minor) * F.sin(t) * F.cos(t)).alias("cov_en"))


def sigma_to_degrees(sigma_e: Column, sigma_n: Column, lat: Column) -> Column:
    """(lon, lat) standard deviations in degrees on the WGS-84 ellipsoid."""
    phi = F.radians(lat)
    w = 1 - ECCENTRICITY * F.pow(F.sin(phi), 2)
    normal, meridian = SEMI_MAJOR / F.sqrt(w), SEMI_MAJOR * (1 - ECCENTRICITY) / F.pow(w, 1.5)
    return F.struct(F.degrees(sigma_e / (normal * F.cos(phi))).alias("lon"), F.degrees(sigma_n / meridian).alias("lat"))


def largest_eigenvalue(a: Column, b: Column, c: Column) -> Column:
    """Of the symmetric matrix ((a, c), (c, b))."""
    return (a + b) / 2 + F.sqrt((a - b) * (a - b) / 4 + c * c)


def protection_level(a: Column, b: Column, c: Column, k: float = PROTECTION_K) -> Column:
    return k * F.sqrt(largest_eigenvalue(a, b, c))


def chi_square_quantile(k: Column, z: float) -> Column:
    """Wilson-Hilferty approximation of the chi-square quantile with k degrees; z is the normal quantile."""
    return k * F.pow(1 - 2 / (9 * k) + z * F.sqrt(2 / (9 * k)), 3)


def mahalanobis_squared(dx: Column, dy: Column, see: Column, snn: Column, sen: Column) -> Column:
    """dx, dy under the inverse of ((see, sen), (sen, snn)); a singular matrix gives 0."""
    det = see * snn - sen * sen
    return F.when(det == 0, F.lit(0.0)).otherwise((snn * dx * dx - 2 * sen * dx * dy + see * dy * dy) / det)


def whitened(dx: Column, dy: Column, see: Column, snn: Column, sen: Column) -> Column:
    """(u, v): the error under the inverse Cholesky factor of its covariance."""
    l11 = F.sqrt(see)
    l21 = sen / l11
    u = dx / l11
    return F.struct(u.alias("u"), ((dy - l21 * u) / F.sqrt(snn - l21 * l21)).alias("v"))


def rayleigh_cdf(r: Column, sigma: Column) -> Column:
    return 1 - F.exp(-r * r / (2 * sigma * sigma))
