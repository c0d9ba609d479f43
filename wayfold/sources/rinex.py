"""RINEX 3 observation and navigation files as tables.

A record of several lines is one row of Spark's text source: files are split between records (the separator is a line
break with the record's first letter), so a large file is read by many tasks and nothing is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.orbits import BEIDOU_LAG, WEEK, gps_seconds

#: Widths of the format (fixed values): a value with its two marks, the value alone, a field of a navigation record.
FIELD, VALUE, NUMBER = 16, 14, 19
#: Broadcast elements by line and field of a navigation record (fixed places of the format).
ELEMENTS = {
    "af0": (0, 1), "af1": (0, 2), "af2": (0, 3),
    "crs": (1, 1), "delta_n": (1, 2), "m0": (1, 3),
    "cuc": (2, 0), "e": (2, 1), "cus": (2, 2), "sqrt_a": (2, 3),
    "toe_of_week": (3, 0), "cic": (3, 1), "omega0": (3, 2), "cis": (3, 3),
    "i0": (4, 0), "crc": (4, 1), "omega": (4, 2), "omega_dot": (4, 3),
    "idot": (5, 0), "health": (6, 1), "tgd": (6, 2),
}
#: Systems whose records hold orbital elements: GPS, BeiDou, Galileo, QZSS.
SYSTEMS = ("G", "C", "E", "J")


def records(spark: SparkSession, path: str, first: str) -> DataFrame:
    """(file, lines): records that start with a letter, which is left out; what stands before the first one is a row, too."""
    d = spark.read.text(path, lineSep="\n" + first)
    return d.select(F.col("_metadata.file_path").alias("file"), F.transform(F.split("value", "\n"), lambda v: F.rtrim(v, F.lit(" \r"))).alias("lines"))


def _lines(line: Column, label: str) -> Column:
    return F.trim(F.substring(line, 61, 20)) == label


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line) of the headers of observation files."""
    d = records(spark, path, ">").filter(F.exists("lines", lambda v: _lines(v, "END OF HEADER")))
    return d.select("file", F.posexplode("lines").alias("no", "line"))


def observation_types(spark: SparkSession, path: str) -> DataFrame:
    """(file, system, codes): the codes of a satellite system's values in their order, continued lines included."""
    own = F.nullif(F.trim(F.substring("line", 1, 1)), F.lit(""))
    system = F.last(own, ignorenulls=True).over(Window.partitionBy("file").orderBy("no"))
    d = header_lines(spark, path).filter(_lines(F.col("line"), "SYS / # / OBS TYPES")).withColumn("system", system)
    codes = F.filter(F.split(F.substring("line", 7, 54), " +"), lambda c: c != "")
    parts = F.array_sort(F.collect_list(F.struct("no", codes.alias("codes"))))
    return d.groupBy("file", "system").agg(F.flatten(F.transform(parts, lambda p: p["codes"])).alias("codes"))


def approximate_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, z) of headers that name the receiver's place."""
    v = F.transform(F.split(F.trim(F.substring("line", 1, 60)), " +"), lambda t: t.try_cast("double"))
    d = header_lines(spark, path).filter(_lines(F.col("line"), "APPROX POSITION XYZ")).select("file", v.alias("v")).filter((F.size("v") >= 3) & (F.get("v", F.lit(0)) != 0))
    return d.groupBy("file").agg(F.first("v").alias("v")).select("file", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate("xyz")))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(file, time, satellite, code, value): one row per value; time in seconds of GPS time.

    Zero or blank values stand for none. Of event records (flags from 2 on) there are no rows, nor of epochs and
    satellites whose lines can't be read or whose system the header doesn't name.
    """
    parts = F.transform(F.split(F.trim(F.get("lines", F.lit(0))), " +"), lambda t: t.try_cast("double"))
    part = lambda i: F.get("parts", F.lit(i))
    whole = lambda i: part(i).cast("int")
    time = gps_seconds(whole(0), whole(1), whole(2), part(3), part(4), part(5))
    epochs = records(spark, path, ">").filter(~F.exists("lines", lambda v: _lines(v, "END OF HEADER"))).withColumn("parts", parts)
    epochs = epochs.filter((part(6) < 2) & (part(7) > 0)).withColumn("time", time).filter("time IS NOT NULL")
    told = F.slice("lines", F.lit(2), whole(7))
    rows = epochs.select("file", "time", F.explode(told).alias("line")).withColumn("satellite", F.replace(F.substring("line", 1, 3), F.lit(" "), F.lit("0")))
    rows = rows.withColumn("system", F.substring("satellite", 1, 1)).join(observation_types(spark, path), ["file", "system"])
    rows = rows.select("file", "time", "satellite", "line", F.posexplode("codes").alias("place", "code"))
    value = F.trim(F.substring("line", F.col("place") * FIELD + 4, F.lit(VALUE))).try_cast("double")
    return rows.select("file", "time", "satellite", "code", value.alias("value")).filter("value <> 0")


def read_ephemerides(spark: SparkSession, path: str, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """(satellite, toe, toc, the fields of ELEMENTS) of navigation files; times in seconds of GPS time.

    A blank field is zero. Records without a calendar time, or whose ellipse can't be one, are left out. Each system
    asked for is a scan of its own.
    """
    found = [_elements(records(spark, path, s), s) for s in systems]
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made


def _elements(rows: DataFrame, system: str) -> DataFrame:
    first = F.concat(F.lit(system), F.get("lines", F.lit(0)))
    rows = rows.filter(first.rlike(rf"^{system}[ 0-9][0-9] +[0-9]{{4}} ")).withColumn("parts", F.split(F.trim(F.substring(first, 5, 19)), " +"))
    part = lambda i: F.get("parts", F.lit(i)).try_cast("int")
    own = gps_seconds(part(0), part(1), part(2), *(F.get("parts", F.lit(i)).try_cast("double") for i in (3, 4, 5)))
    lines = F.concat(F.array(first), F.slice("lines", 2, 7))

    def number(line: int, field: int) -> Column:
        text = F.trim(F.substring(F.get("all", F.lit(line)), 5 + NUMBER * field, NUMBER))
        return F.coalesce(F.translate(text, "Dd", "EE").try_cast("double"), F.lit(0.0))

    values = rows.withColumn("all", lines).withColumn("own", own).filter("own IS NOT NULL")
    values = values.select(F.replace(F.substring(F.get("all", F.lit(0)), 1, 3), F.lit(" "), F.lit("0")).alias("satellite"), "own", *(number(*at).alias(n) for n, at in ELEMENTS.items()))
    lag = BEIDOU_LAG if system == "C" else 0.0
    # the record tells its reference time within the week; it lies within half a week of the clock's
    toe = F.col("own") + F.pmod(F.col("toe_of_week") - F.col("own") + WEEK / 2, F.lit(WEEK)) - WEEK / 2
    good = values.filter("sqrt_a > 0 AND e >= 0 AND e < 1")
    return good.select("satellite", (toe + lag).alias("toe"), (F.col("own") + lag).alias("toc"), *ELEMENTS)
