"""Observation and navigation files that the tests write, read back; orbits against NumPy; a fix from files alone."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import orbits as O
from wayfold.operators import integrity
from wayfold.operators.orbits import fix_rows, pseudoranges, with_elements
from wayfold.sources import rinex as R

#: 2 January 2024, midnight: 1 h into the time of the elements below.
DAY = (2024, 1, 2)
START = 16067 * 86400.0
#: Satellites, the ninth of them unhealthy.
LAST = 30
HERE = np.array([4075580.0, 931853.0, 4801568.0])
CODES = ["C1C", "L1C", "D1C", "S1C", "C2W", "L2W", "D2W", "S2W", "C5Q", "L5Q", "D5Q", "S5Q", "C1L", "L1L"]


def elements(n):
    """Plausible elements of satellite n."""
    zero = dict.fromkeys(R.ELEMENTS, 0.0)
    return zero | {
        "af0": 1e-5 * (n - 8), "af1": 1e-12 * n, "crs": 20.0 + n, "delta_n": 4.5e-9, "m0": -3 + 1.2 * (n // 6) + 0.4 * (n % 6), "cuc": 1e-6, "e": 0.0005 * n, "cus": 5e-6, "sqrt_a": 5153.6,
        "toe_of_week": START % O.WEEK + 3600.0, "cic": 3e-8, "omega0": -3 + (n % 6) * math.pi / 3, "cis": -5e-8, "i0": 0.96, "crc": 250.0, "omega": 0.5, "omega_dot": -8e-9, "idot": 1e-10, "health": 1.0 if n == 9 else 0.0, "tgd": 5e-9,
    }


def place(el, t):
    """The published formulas, step by step."""
    age = t - (START + 3600)
    a = el["sqrt_a"] ** 2
    mean = el["m0"] + (math.sqrt(O.GM / a**3) + el["delta_n"]) * age
    ea = mean
    for _ in range(60):
        ea = mean + el["e"] * math.sin(ea)
    nu = math.atan2(math.sqrt(1 - el["e"] ** 2) * math.sin(ea), math.cos(ea) - el["e"])
    phi = nu + el["omega"]
    c, s = math.cos(2 * phi), math.sin(2 * phi)
    u, r = phi + el["cus"] * s + el["cuc"] * c, a * (1 - el["e"] * math.cos(ea)) + el["crs"] * s + el["crc"] * c
    i = el["i0"] + el["idot"] * age + el["cis"] * s + el["cic"] * c
    om = el["omega0"] + (el["omega_dot"] - O.EARTH_RATE) * age - O.EARTH_RATE * el["toe_of_week"]
    flat = np.array([r * math.cos(u), r * math.sin(u) * math.cos(i)])
    clock = el["af0"] + el["af1"] * age + O.RELATIVITY * el["e"] * el["sqrt_a"] * math.sin(ea) - el["tgd"]
    return np.array([flat[0] * math.cos(om) - flat[1] * math.sin(om), flat[0] * math.sin(om) + flat[1] * math.cos(om), r * math.sin(u) * math.sin(i)]), clock


def received(el, t, true):
    """The pseudorange at the true place and time."""
    travel = 0.07
    for _ in range(8):
        p, clock = place(el, t - travel)
        angle = O.EARTH_RATE * travel
        turned = np.array([math.cos(angle) * p[0] + math.sin(angle) * p[1], math.cos(angle) * p[1] - math.sin(angle) * p[0], p[2]])
        travel = np.linalg.norm(turned - true) / O.LIGHT
    return travel * O.LIGHT - O.LIGHT * clock


def labelled(text, label):
    return f"{text:<60}{label}"


def number(v):
    return f"{v:19.12E}".replace("E", "D")


def nav_record(name, el):
    rows = [[0.0] * 4 for _ in range(8)]
    for key, (line, field) in R.ELEMENTS.items():
        rows[line][field] = el[key]
    first = f"{name} 2024 01 02 01 00 00" + "".join(number(v) for v in rows[0][1:])
    return [first, *("    " + "".join(number(v) for v in row) for row in rows[1:])]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rinex")
    nav = [labelled("     3.04           N: GNSS NAV DATA    M: MIXED", "RINEX VERSION / TYPE"), labelled("GPSA   1.1D-08", "IONOSPHERIC CORR"), labelled("", "END OF HEADER")]
    for n in range(1, LAST + 1):
        nav += nav_record(f"G{n:02d}", elements(n))
        if n == 3:
            nav += ["R01 2024 01 02 00 15 00" + number(0.0) * 3, *["    " + number(1.0) * 4] * 3]
            nav += nav_record("C11", elements(n))
    (folder / "a.nav").write_text("\n".join(nav) + "\n")
    bad = nav_record("G32", elements(1) | {"e": 1.5}) + ["G33 2024 13 45 00 00 00" + number(0.0) * 3]
    (folder / "bad.nav").write_text("\n".join(nav[:3] + bad) + "\n")

    true = HERE + [12.0, -7.0, 4.0]
    obs = [
        labelled("     3.04           OBSERVATION DATA    M", "RINEX VERSION / TYPE"),
        labelled(f"{HERE[0]:14.4f}{HERE[1]:14.4f}{HERE[2]:14.4f}", "APPROX POSITION XYZ"),
        labelled("G   14 " + " ".join(CODES[:13]), "SYS / # / OBS TYPES"), labelled("       " + CODES[13], "SYS / # / OBS TYPES"),
        labelled("R    1 C1C", "SYS / # / OBS TYPES"), labelled("", "END OF HEADER"),
    ]
    for k in range(20):
        t = START + 30 * k + 0.5
        seen = [f"G{n:02d}" for n in range(1, LAST + 1)]
        obs.append(f"> 2024 01 02 00 {k // 2:02d} {30 * (k % 2) + 0.5:10.7f}  0 {len(seen) + 1:2d}")
        for n, name in enumerate(seen, 1):
            values = [received(elements(n), t, true) + 30.0, 0.0, None] + [1000.0 + n] * 11
            obs.append(name.replace("G0", "G " if k == 3 else "G0") + "".join(" " * 16 if v is None else f"{v:14.3f} 7" for v in values))
        obs.append("R05" + f"{2e7 + k:14.3f}")
        if k == 5:
            obs += ["> 2024 01 02 00 02 45.0000000  4  1", labelled("a remark", "COMMENT"), "> broken"]
    (folder / "a.obs").write_bytes("\r\n".join(obs).encode())
    (folder / "empty.obs").write_text("")
    return folder, true


def test_observations(spark, files):
    got = R.read_observations(spark, f"{files[0]}/a.obs")
    rows = got.filter("satellite = 'G03'").collect()
    assert len(rows) == 20 * 12 and {r.code for r in rows} == set(CODES) - {"L1C", "D1C"}
    assert {r.value for r in rows if r.code == "L1L"} == {1003.0}
    assert sorted({r.time for r in rows}) == [START + 30 * k + 0.5 for k in range(20)]
    assert [r.value for r in got.filter("satellite = 'R05'").orderBy("time").collect()] == [2e7 + k for k in range(20)]
    assert R.read_observations(spark, f"{files[0]}/empty.obs").count() == 0


def test_split_files_give_the_same_rows(spark, files):
    """Parts of 512 bytes: every record is read once, wherever the parts end."""
    whole = sorted(R.read_observations(spark, f"{files[0]}/a.obs").collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        d = R.records(spark, f"{files[0]}/a.obs", ">")
        assert d.rdd.getNumPartitions() > 10
        assert sorted(R.read_observations(spark, f"{files[0]}/a.obs").collect()) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_elements_and_orbits(spark, files):
    d = R.read_ephemerides(spark, f"{files[0]}/*.nav")
    rows = {r.satellite: r for r in d.collect()}
    assert set(rows) == {f"G{n:02d}" for n in range(1, LAST + 1)} | {"C11"}
    for n in range(1, LAST + 1):
        assert rows[f"G{n:02d}"].toe == rows[f"G{n:02d}"].toc == START + 3600
        assert all(math.isclose(rows[f"G{n:02d}"][k], v, rel_tol=1e-11) for k, v in elements(n).items())
    assert rows["C11"].toc == START + 3600 + O.BEIDOU_LAG
    t = F.lit(START + 1234.5)
    el = F.struct(*d.columns)
    for r in d.filter("satellite LIKE 'G%'").select("satellite", O.position(el, t).alias("p"), O.clock(el, t).alias("c")).collect():
        p, c = place(elements(int(r.satellite[1:])), START + 1234.5)
        assert np.abs(np.array(r.p) - p).max() < 1e-3 and abs(r.c - c) < 1e-13
    still = d.withColumn("satellite", F.lit("C03")).select(O.position(F.struct(F.lit("C03").alias("satellite"), *(c for c in d.columns if c != "satellite")), t).alias("p"))
    assert still.filter("p IS NOT NULL").count() == 0


def test_nearest_elements(spark):
    e = spark.createDataFrame([("G01", 0.0, 0.0, 1), ("G01", 7200.0, 7200.0, 2), ("G01", 7200.0, 7100.0, 3), ("G01", 36000.0, 36000.0, 4), ("G02", 0.0, 0.0, 5)], "satellite string, toe double, toc double, no int")
    rows = spark.createDataFrame([("G01", t) for t in (-7200.0, -7200.5, 3599.0, 3600.0, 14399.0, 14400.0, 28800.0, 43199.0, 43200.0)] + [("G02", 7199.0), ("G03", 0.0), (None, 0.0), ("G01", None)], "satellite string, time double")
    got = {(r.satellite, r.time): r.el.no for r in with_elements(rows, e).collect()}
    assert got == {("G01", -7200.0): 1, ("G01", 3599.0): 1, ("G01", 3600.0): 2, ("G01", 14399.0): 2, ("G01", 28800.0): 4, ("G01", 43199.0): 4, ("G02", 7199.0): 5}


def test_fix_from_files(spark, files):
    """The receiver's true place comes out of the files, whose header is some 14 m off; clocks differ by 30 m."""
    folder, true = files
    ranges = pseudoranges(R.read_observations(spark, f"{folder}/a.obs"))
    rows = fix_rows(ranges, R.read_ephemerides(spark, f"{folder}/a.nav"), R.approximate_positions(spark, f"{folder}/a.obs"))
    seen = {r.satellite for r in rows.collect()}
    assert len(seen) >= 5 and "G09" not in seen and rows.filter("elevation <= 10").count() == 0
    fixes = integrity.position_fixes(rows.select("epoch", "azimuth", "elevation", "residual", "sigma")).collect()
    assert len(fixes) == 20
    lon, lat = math.atan2(HERE[1], HERE[0]), math.atan2(HERE[2], math.hypot(HERE[0], HERE[1]) * (1 - 0.00669438))
    d = HERE - true
    flat = math.cos(lon) * d[0] + math.sin(lon) * d[1]
    want = (-math.sin(lon) * d[0] + math.cos(lon) * d[1], -math.sin(lat) * flat + math.cos(lat) * d[2], math.cos(lat) * flat + math.sin(lat) * d[2])
    for f in fixes:
        assert f.passed and np.allclose((f.east, f.north, f.up, f.clock), (*want, 30.0), atol=0.05)
