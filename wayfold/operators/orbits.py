"""Observations joined with the broadcast elements that hold for them, up to rows for position fixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geodesy as D
from wayfold.functions import orbits

#: Elements hold for less than so many seconds before and after their reference time.
AGE = 7200.0
#: Codes of pseudoranges by system, the one to take first in front (fixed values).
RANGES = {"G": ("C1C", "C1W", "C1L"), "C": ("C2I", "C1I"), "E": ("C1C", "C1B"), "J": ("C1C", "C1L")}


def spans(ephemerides: DataFrame, age: float = AGE) -> DataFrame:
    """(satellite, since, until, el): elements by the time for which no others of their satellite are nearer.

    Of several messages for one reference time the one of the latest clock time counts, and among those the largest.
    """
    names = ["toc", *(c for c in ephemerides.columns if c not in ("satellite", "toe", "toc"))]
    one = ephemerides.groupBy("satellite", "toe").agg(F.max(F.struct(*names)).alias("rest"))
    w = Window.partitionBy("satellite").orderBy("toe")
    before, after = (F.lag("toe").over(w) + F.col("toe")) / 2, (F.lead("toe").over(w) + F.col("toe")) / 2
    el = F.struct("satellite", "toe", *(F.col("rest")[n].alias(n) for n in names))
    return one.select("satellite", F.greatest(F.col("toe") - age, before).alias("since"), F.least(F.col("toe") + age, after).alias("until"), el.alias("el"))


def with_elements(rows: DataFrame, ephemerides: DataFrame, age: float = AGE, time: str = "time") -> DataFrame:
    """Adds `el`, the nearest elements of the row's satellite, to rows (satellite, time); rows without any are left out.

    An equi-join on satellite and slot of time: elements' spans don't overlap and touch three slots at most, so a
    row meets its own elements and few others, whatever the number of rows.
    """
    slot = lambda t: F.floor(t / age)
    e = spans(ephemerides, age).withColumn("slot", F.explode(F.sequence(slot(F.col("since")), slot(F.col("until")))))
    at = F.col(f"rows.{time}")
    r = rows.withColumn("slot", slot(F.col(time))).alias("rows")
    met = r.join(e.alias("e"), (F.col("rows.satellite") == F.col("e.satellite")) & (F.col("rows.slot") == F.col("e.slot")) & (at >= F.col("e.since")) & (at < F.col("e.until")))
    return met.select(*(F.col(f"rows.{c}") for c in rows.columns), "e.el")


def pseudoranges(observations: DataFrame, codes: dict[str, tuple[str, ...]] = RANGES) -> DataFrame:
    """(file, time, satellite, range): of each satellite and epoch the first of its system's codes that was received."""
    ranks = [(s, c, i) for s, cs in codes.items() for i, c in enumerate(cs)]
    rank = F.coalesce(*(F.when(F.col("satellite").startswith(s) & (F.col("code") == c), i) for s, c, i in ranks))
    d = observations.withColumn("rank", rank).filter("rank IS NOT NULL")
    return d.groupBy("file", "time", "satellite").agg(F.min(F.struct("rank", "value")).alias("best")).select("file", "time", "satellite", F.col("best.value").alias("range"))


def _length(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"]))


def fix_rows(ranges: DataFrame, ephemerides: DataFrame, receivers: DataFrame, noise: float = 3.0, mask: float = 10.0, age: float = AGE) -> DataFrame:
    """(file, time, epoch, satellite, azimuth, elevation, residual, sigma) for `integrity.position_fixes`.

    `receivers` tells each file's approximate place (x, y, z). A satellite is placed where it was when it sent, and the
    frame turned by the time of travel. Satellites marked as unhealthy or not above the mask (degrees) are left out; sigma
    is the noise (metres) over the sine of the elevation. `epoch` is a key of file and time (milliseconds).
    """
    d = with_elements(ranges, ephemerides, age).filter("el.health = 0").join(receivers.select("file", F.struct("x", "y", "z").alias("here")), "file")
    d = d.withColumn("sent", F.col("time") - F.col("range") / orbits.LIGHT).withColumn("ahead", orbits.clock(F.col("el"), F.col("sent")))
    d = d.withColumn("there", orbits.turned_by_travel(orbits.position(F.col("el"), F.col("sent") - F.col("ahead")), F.col("here"))).filter("there IS NOT NULL")
    at = D.ecef_to_lla(F.col("here.x"), F.col("here.y"), F.col("here.z"))
    d = d.withColumn("at", at)
    seen = D.azimuth_elevation(D.ecef_to_enu(*(F.col(f"there.{c}") - F.col(f"here.{c}") for c in "xyz"), F.col("at.lon"), F.col("at.lat")))
    d = d.withColumn("seen", seen).filter(F.col("seen.elevation") > mask)
    residual = F.col("range") + orbits.LIGHT * F.col("ahead") - _length(F.col("there"), F.col("here"))
    epoch = F.xxhash64("file", F.round(F.col("time") * 1000).cast("long"))
    return d.select("file", "time", epoch.alias("epoch"), "satellite", F.pmod(F.col("seen.azimuth"), F.lit(360.0)).alias("azimuth"), F.col("seen.elevation").alias("elevation"), residual.alias("residual"), (noise / F.sin(F.col("seen.elevation") * (math.pi / 180))).alias("sigma"))
