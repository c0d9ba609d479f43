"""Readers and writers round trip through files."""

from pyspark.sql import functions as F

from wayfold.operators import network
from wayfold.sources import nmea, text_tables


def test_network_and_od_files(spark, tmp_path):
    (tmp_path / "net.csv").write_text("id;source;target;geom;oneway\n1;0;1;LINESTRING(0 0,1 0);T\n2;1;0;LINESTRING(1 0,0 0);\n3;1;2;POINT(1 1);\n")
    rows = text_tables.read_network(spark, str(tmp_path / "net.csv")).orderBy("edge_id").collect()
    assert [(r.edge_id, r.length, r.oneway) for r in rows] == [(1, 1.0, True), (2, 1.0, False)]
    assert network.node_table(text_tables.read_network(spark, str(tmp_path / "net.csv"))).count() == 2
    (tmp_path / "bad.csv").write_text("id;from;target;geom\n1;0;1;LINESTRING(0 0,1 0)\n")
    try:
        text_tables.read_network(spark, str(tmp_path / "bad.csv"))
        raise AssertionError
    except ValueError as e:
        assert "source" in str(e)
    (tmp_path / "net.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":5,"source":1,"target":2},"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}}]}')
    assert text_tables.read_geojson_network(spark, str(tmp_path / "net.json")).first().length == 5.0
    od = spark.createDataFrame([(1, 2, 2, 1, 7, 1.5), (0, 2, 1, 1, 3, 2.5)], "source long, target long, next_n long, prev_n long, next_e long, distance double")
    text_tables.write_od(od, str(tmp_path / "od"))
    assert spark.read.parquet(str(tmp_path / "od")).count() == 2
    od.write.csv(str(tmp_path / "od.csv"), sep=";", header=True)
    assert sorted(map(tuple, text_tables.read_od(spark, str(tmp_path / "od.csv")).collect())) == sorted(map(tuple, od.collect()))


def test_point_and_trajectory_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id;x;y;timestamp\n1;0;0;5\n1;1;0;6\n2;0;1;7\n1;2;0;8\n1;3;x;9\n")
    rows = text_tables.read_points(spark, str(tmp_path / "p.csv")).orderBy("row").collect()
    assert [(r.id, r.seq) for r in rows] == [(1, 0), (1, 1), (2, 0), (1, 0), (1, 1)]
    assert len({(r.id, r.run) for r in rows}) == 3 and rows[-1].y is None
    (tmp_path / "t.csv").write_text("id;geom;timestamp\n1;LINESTRING(0 0,1 2);3,4\n2;nothing;1\n")
    t = text_tables.read_trajectories(spark, str(tmp_path / "t.csv"))
    assert [(r.seq, r.x, r.t) for r in text_tables.exploded(t).orderBy("seq").collect()] == [(0, 0.0, 3.0), (1, 1.0, 4.0)]
    (tmp_path / "c.csv").write_text("ID;geom;Timestamps;covariance_json;pl\n1;LINESTRING(0 0,1 2);[1,2];[[1,2,3,4,5,6],[1,2,3,4,5,6]];[0.5,0.5]\n2;LINESTRING(0 0,1 2);[1,2];[[1,2]];[0.5,0.5]\n")
    c = text_tables.read_covariance_trajectories(spark, str(tmp_path / "c.csv"))
    assert {r.traj_id: r.valid for r in c.collect()} == {1: True, 2: False}
    (tmp_path / "q.csv").write_text("id;timestamp;x;y;sdn;sde;protection_level;sdne\n1;1;0;0;0.1;0.2;3;0.01\n")
    assert (text_tables.read_covariance_points(spark, str(tmp_path / "q.csv")).first().sde, text_tables.read_covariance_points(spark, str(tmp_path / "q.csv"), False).first().sde) == (0.1, 0.2)


def test_match_files(spark, tmp_path):
    d = spark.createDataFrame([(2, [3, 4], [(0.0, 0.0), (1.0, 1.0)]), (1, [], [(0.5, 0.0)])], "traj_id long, cpath array<long>, mgeom array<struct<x:double,y:double>>")
    text_tables.write_matches(d, str(tmp_path / "m"))
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "m"), sep=";", header=True).collect()]
    assert sorted(rows) == [("1", None, "LINESTRING(0.5 0.0)"), ("2", "3,4", "LINESTRING(0.0 0.0,1.0 1.0)")]


def test_nmea_sentences(spark):
    lines = ["$GPGST,024603.00,3.2,6.6,4.7,47.3,5.8,5.6,22.0*58", "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A", "$GNZDA,201530.00,04,07,2002,00,00*60", "noise"]
    d = spark.createDataFrame([(x,) for x in lines], "line string").select(nmea.gst("line")["bearing"].alias("bearing"), nmea.date("line").cast("string").alias("day"), nmea.gga("line").alias("gga"))
    assert [(r.bearing, r.day, r.gga) for r in d.collect()] == [(47.3, None, None), (None, "1994-03-23", None), (None, "2002-07-04", None), (None, None, None)]
    assert spark.range(1).select(F.lit(1)).count() == 1
