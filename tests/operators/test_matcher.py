"""One call from texts and files to results, on a street of edges 1 -> 2 -> 3 of length 1 (and back as 11, 12)."""

import pytest

from wayfold import matcher
from wayfold.operators.counts import Counts
from wayfold.operators.covariance import CovarianceConfig
from wayfold.operators.matching import MatchConfig
from wayfold.sources import files, text_tables

CONFIG = MatchConfig(k=4, radius=0.4, gps_error=0.5)
WKT = "LINESTRING(0.2 0.1,1.1 0.1,2.7 -0.1)"


@pytest.fixture(scope="module")
def network_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("net") / "net.csv"
    rows = [f"{i};{i};{i + 1};LINESTRING({i - 1} 0,{i} 0)" for i in (1, 2, 3)] + [f"{10 + i};{i + 1};{i};LINESTRING({i} 0.05,{i - 1} 0.05)" for i in (1, 2)]
    path.write_text("id;source;target;geom\n" + "\n".join(rows) + "\n")
    return str(path)


def test_texts(spark, network_file):
    net = matcher.Network.of(files.read_any_network(spark, network_file), 5.0)
    rows = {r.traj_id: r for r in matcher.match_wkt([WKT, "nothing", "LINESTRING(9 9,10 9)"], net, CONFIG).collect()}
    assert list(rows) == [0]
    r = rows[0]
    assert (r.opath, r.cpath, r.indices, r.tpath) == ([1, 2, 3], [1, 2, 3], [0, 1, 2], "1,2|2,3")
    assert [(p.x, p.y) for p in r.mgeom] == [(0.2, 0.0), (1.0, 0.0), (2.0, 0.0), (2.7, 0.0)]
    assert r.offset == pytest.approx([0.2, 0.1, 0.7]) and r.error == pytest.approx([0.1, 0.1, 0.1]) and r.spdist == pytest.approx([0, 0.9, 1.6])
    assert [(p.x, p.y) for p in r.pgeom] == [pytest.approx(v) for v in ((0.2, 0), (1.1, 0), (2.7, 0))]


def test_files_by_extension(spark, network_file, tmp_path):
    (tmp_path / "t.csv").write_text(f"id;geom\n5;{WKT}\n6;LINESTRING(9 9,10 9)\n")
    (tmp_path / "p.txt").write_text("id;x;y;timestamp\n" + "\n".join(f"5;{x};{y};{i}" for i, (x, y) in enumerate(((0.2, 0.1), (1.1, 0.1), (2.7, -0.1)))) + "\n")
    coordinates = "[[0.2,0.1],[1.1,0.1],[2.7,-0.1]]"
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"5"},"geometry":{"type":"LineString","coordinates":%s}}]}' % coordinates)
    net = matcher.Network.of(files.read_any_network(spark, network_file), 5.0)
    for name, points in (("t.csv", False), ("p.txt", True), ("g.geojson", False)):
        counts = Counts()
        done = matcher.match_file(spark, str(tmp_path / name), net, str(tmp_path / f"out-{name}"), CONFIG, points=points, fields="all", counts=counts)
        assert counts.all() == {"points": 5 if name == "t.csv" else 3, "trajectories": 1, "broken": 0, "matched": 3}
        assert [r.cpath for r in done.collect()] == [[1, 2, 3]]
        written = spark.read.csv(str(tmp_path / f"out-{name}"), sep=";", header=True)
        assert written.columns == ["traj_id", *matcher.FIELDS] and written.first().cpath == "1,2,3"
    for bad in (lambda: files.read_gps(spark, "x.xls"), lambda: files.read_any_network(spark, "x"), lambda: matcher.fields_of("cpath,nonsense")):
        with pytest.raises(ValueError):
            bad()
    assert matcher.fields_of(None) == ("traj_id", "cpath", "mgeom") and matcher.fields_of("mgeom, opath") == ("traj_id", "opath", "mgeom")


def test_matching_without_a_path_table(spark, network_file, tmp_path):
    edges = files.read_any_network(spark, network_file)
    rows = matcher.match_wkt_on_the_fly([WKT, "LINESTRING(9 9,10 9)"], edges, CONFIG, 0.5).collect()
    assert [(r.traj_id, r.opath, r.cpath, r.indices) for r in rows] == [(0, [1, 2, 3], [1, 2, 3], [0, 1, 2])]
    assert rows[0].spdist == pytest.approx([0, 0.9, 1.6])
    (tmp_path / "p.csv").write_text("id;x;y;timestamp\n" + "\n".join(f"5;{x};{y};{i}" for i, (x, y) in enumerate(((0.2, 0.1), (1.1, 0.1), (2.7, -0.1)))) + "\n")
    done = matcher.match_file(spark, str(tmp_path / "p.csv"), network_file, str(tmp_path / "out"), CONFIG, 0.5, points=True, on_the_fly=True)
    assert [r.cpath for r in done.collect()] == [[1, 2, 3]]
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).first().cpath == "1,2,3"


def test_covariance_files(spark, network_file, tmp_path):
    """Both forms of files give the same matches; rows of a trajectory keep the order of the file."""
    at = [(0.2, -0.1), (1.1, -0.1), (1.6, -0.1), (2.7, -0.1)]  # nearer to the street ahead than to the one back
    fields = [(i * 10.0, x, y, 0.1, 0.1, 0.5) for i, (x, y) in enumerate(at)]
    head = "id,timestamp,x,y,sdn,sde,protection_level\n"
    points = "".join(f"{t},{','.join(map(str, f))}\n" for f in fields for t in (7, 3))
    (tmp_path / "points.csv").write_text(head + points)
    line = ",".join(f"{x} {y}" for x, y in at)
    cov = "[" + ",".join("[0.1,0.1,0,0,0,0]" for _ in at) + "]"
    whole = "".join(f"{t};LINESTRING({line});{[f[0] for f in fields]};{cov};{[f[5] for f in fields]}\n" for t in (7, 3))
    (tmp_path / "whole.csv").write_text("id;geom;timestamps;covariances;protection_levels\n" + whole + f"9;LINESTRING({line});[1];{cov};[1]\n")
    read = text_tables.read_covariance_points(spark, str(tmp_path / "points.csv"))
    assert [(r.traj_id, r.seq, r.x) for r in read.orderBy("traj_id", "seq").collect()] == [(t, i, x) for t in (3, 7) for i, (x, _) in enumerate(at)]
    net = matcher.Network.of(files.read_any_network(spark, network_file), 5.0)
    config = CovarianceConfig(k=4, min_candidates=1, min_sigma=0.01, map_sigma=0.02)
    got = {}
    for name in ("points", "whole"):
        counts = Counts()
        done = matcher.match_covariance_file(spark, str(tmp_path / f"{name}.csv"), net, str(tmp_path / f"out-{name}"), config, 1.0, counts=counts)
        assert counts.all() == {"points": 8, "matched": 8, "failed": 0} | ({"rows_read": 3, "rows_rejected": 1} if name == "whole" else {})
        got[name] = sorted((r.traj_id, r.seq, r.status, r.edge_id, round(r.trust, 9)) for r in done.collect())
        written = spark.read.csv(str(tmp_path / f"out-{name}"), sep=";", header=True)
        assert written.columns == list(matcher.POINT_FIELDS) and written.count() == len(got[name])
    assert got["points"] == got["whole"]
    assert [r[:4] for r in got["whole"]] == [(t, i, "SUCCESS", e) for t in (3, 7) for i, e in enumerate((1, 2, 2, 3))]
    sure = matcher.match_covariance_file(spark, str(tmp_path / "whole.csv"), net, str(tmp_path / "out-sure"), config, 1.0, threshold=2.0)
    assert {r.status for r in sure.collect()} == {"FAILED_NO_CANDIDATE"}


def test_routes_of_any_length_between_steps(spark):
    from wayfold.operators import paths, routing

    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(30)], "edge_id long, source long, target long, length double")
    chosen = spark.createDataFrame([(1, 0, 0, 0, 1, 1.0, 0.5), (1, 1, 25, 25, 26, 1.0, 0.5), (2, 0, 7, 7, 8, 1.0, 0.5), (2, 1, 2, 2, 3, 1.0, 0.5)], "traj_id long, seq long, edge_id long, source long, target long, length double, offset double")
    got = {r.traj_id: r.cpath for r in paths.complete_paths(paths.routed_steps(chosen, edges, 2.0)).collect()}
    assert got == {1: list(range(26)), 2: []}
    assert routing.routed_pairs(edges, chosen.select("source", "target").filter("false"), 1.0).count() == 0
