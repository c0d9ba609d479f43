"""NMEA sentences as columns: positions, error ellipses, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _field(line: Column, i: int) -> Column:
    return F.nullif(F.get(F.split(F.substring_index(line, "*", 1), ","), F.lit(i)), F.lit(""))


def degrees(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm (or dddmm.mmmm) with N, S, E or W as decimal degrees."""
    v = value.try_cast("double")
    whole = F.floor(v / 100)
    plain = whole + (v - whole * 100) / 60
    return F.when(hemisphere.isin("S", "W"), -plain).otherwise(plain)


def seconds_of_day(value: Column) -> Column:
    """hhmmss.ss as seconds."""
    return F.substring(value, 1, 2).try_cast("double") * 3600 + F.substring(value, 3, 2).try_cast("double") * 60 + F.substring(value, 5, 20).try_cast("double")


def gga(line: Column | str) -> Column:
    """(seconds, lon, lat, quality, satellites, hdop, height) of a GGA sentence; null for others."""
    line = F.col(line) if isinstance(line, str) else line
    number = lambda i: _field(line, i).try_cast("double")
    made = F.struct(
        seconds_of_day(_field(line, 1)).alias("seconds"), degrees(_field(line, 4), _field(line, 5)).alias("lon"), degrees(_field(line, 2), _field(line, 3)).alias("lat"),
        number(6).alias("quality"), number(7).alias("satellites"), number(8).alias("hdop"), number(9).alias("height"),
    )
    return F.when(line.rlike(r"^\$..GGA,"), made)


def gst(line: Column | str) -> Column:
    """(seconds, major, minor, bearing, sigma_lat, sigma_lon, sigma_height) of a GST sentence; null for others."""
    line = F.col(line) if isinstance(line, str) else line
    names = ("rms", "major", "minor", "bearing", "sigma_lat", "sigma_lon", "sigma_height")
    made = F.struct(seconds_of_day(_field(line, 1)).alias("seconds"), *(_field(line, i).try_cast("double").alias(n) for i, n in enumerate(names, 2)))
    return F.when(line.rlike(r"^\$..GST,"), made)


def date(line: Column | str) -> Column:
    """The date of an RMC (ddmmyy) or ZDA (dd,mm,yyyy) sentence; null for others."""
    line = F.col(line) if isinstance(line, str) else line
    short = _field(line, 9)  # two-digit years from 80 are of the last century
    century = F.when(F.substring(short, 5, 2) >= "80", F.lit("19")).otherwise(F.lit("20"))
    rmc = F.try_to_timestamp(F.concat(F.substring(short, 1, 4), century, F.substring(short, 5, 2)), F.lit("ddMMyyyy")).cast("date")
    zda = F.try_to_timestamp(F.concat(_field(line, 2), _field(line, 3), _field(line, 4)), F.lit("ddMMyyyy")).cast("date")
    return F.when(line.rlike(r"^\$..RMC,"), rmc).when(line.rlike(r"^\$..ZDA,"), zda)


def carried_forward(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Fills nulls with the last value before them in the key's order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
