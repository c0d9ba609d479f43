"""Line files that the tests write themselves, read back by planned partitions."""

import math
import sqlite3
import struct

import pytest

from wayfold.sources import files, shapefile

#: id, source, target, name, oneway, parts of points.
ROWS = [
    (7, 1, 2, "Main", "T", [[(0.0, 0.0), (1.0, 0.5), (2.0, 0.0)]]),
    (-8, 2, 3, "Été", "F", [[(2.0, 0.0), (5.0, 0.0)], [(9.0, 9.0), (8.0, 8.0)]]),
    (9, 3, 1, "", "", [[(5.0, 0.0), (5.0, 4.0), (0.0, 0.0)]]),
    (10, 4, 5, "far", "1", [[(100.0, 100.0), (101.0, 100.0)]]),
]


def boxed(parts):
    xs, ys = zip(*[p for part in parts for p in part], strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def write_shp(path, rows, fields, kind=3, deleted=()):
    """rows: (values, parts); fields: (name, type, size, decimals)."""
    body, index, at = b"", b"", 100
    for _, parts in rows:
        if parts is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for part in parts for p in part]
            starts = [sum(len(p) for p in parts[:i]) for i in range(len(parts))]
            content = struct.pack("<i4d2i", kind, *boxed(parts), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
            if kind == 13:
                content += struct.pack("<2d", 0, 1) + struct.pack(f"<{len(points)}d", *range(len(points)))
        index += struct.pack(">2i", at // 2, len(content) // 2)
        body += struct.pack(">2i", len(index) // 8, len(content) // 2) + content
        at += 8 + len(content)
    for name, data in (("shp", body), ("shx", index)):
        head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
        path.with_suffix(f".{name}").write_bytes(head + data)
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), size, dec) for n, t, size, dec in fields) + b"\r"
    text = lambda v, f: (str(v).rjust(f[2]) if f[1] in "NF" else str(v)).encode().ljust(f[2])[: f[2]]
    path.with_suffix(".dbf").write_bytes(head + b"".join((b"*" if i in deleted else b" ") + b"".join(text(v, f) for v, f in zip(values, fields, strict=True)) for i, (values, _) in enumerate(rows)))
    path.with_suffix(".cpg").write_text("UTF-8")
    return str(path.with_suffix(".shp"))


FIELDS = [("id", "N", 10, 0), ("source", "N", 10, 0), ("target", "N", 10, 0), ("name", "C", 12, 0), ("oneway", "C", 5, 0), ("width", "N", 8, 2)]


def shp(tmp_path, **more):
    return write_shp(tmp_path / "net", [((*r[:5], 2.5), r[5]) for r in ROWS], FIELDS, **more)


def write_gpkg(path, rows, tree=True):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 'MULTILINESTRING')")
    db.execute('CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, id INTEGER, source MEDIUMINT, target INTEGER, name TEXT, oneway TEXT, toll BOOLEAN)')
    if tree:
        db.execute("CREATE VIRTUAL TABLE rtree_roads_geom USING rtree(id, minx, maxx, miny, maxy)")
    for i, r in enumerate(rows):
        lines = [struct.pack("<BII", 1, 2, len(p)) + b"".join(struct.pack("<2d", *q) for q in p) for p in r[5]]
        wkb = lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)
        x1, y1, x2, y2 = boxed(r[5])
        blob = b"GP" + struct.pack("<BBi", 0, 1 | 1 << 1, 4326) + struct.pack("<4d", x1, x2, y1, y2) + wkb
        db.execute("INSERT INTO roads VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (i * 3 + 1, blob, *r[:5], i % 2))
        if tree:
            db.execute("INSERT INTO rtree_roads_geom VALUES (?, ?, ?, ?, ?)", (i * 3 + 1, x1, x2, y1, y2))
    db.commit()
    db.close()
    return str(path)


def rows_of(edges):
    return sorted((r.edge_id, r.source, r.target, tuple((p.x, p.y) for p in r.line), r.oneway) for r in edges.collect())


WANT = sorted((r[0], r[1], r[2], tuple(r[5][0]), r[4] in ("T", "1")) for r in ROWS)


@pytest.mark.parametrize("kind", ["shp", "shp heights", "gpkg", "gpkg without index"])
def test_networks_come_back(spark, tmp_path, kind):
    path = shp(tmp_path, kind=13 if "heights" in kind else 3) if "shp" in kind else write_gpkg(tmp_path / "net.gpkg", ROWS, tree=kind == "gpkg")
    assert rows_of(files.read_any_network(spark, path)) == WANT
    assert rows_of(shapefile.read_network(spark, "file://" + path, rows=1)) == WANT
    length = {r.edge_id: r.length for r in shapefile.read_network(spark, path).collect()}
    assert length[7] == pytest.approx(2 * math.hypot(1, 0.5))
    box = (4.5, -1.0, 6.0, 3.0)
    in_box = shapefile.read_lines(spark, path, box).collect()
    assert 9 in {r.id for r in in_box} and {r.id for r in in_box} <= {-8, 9}
    assert shapefile.read_lines(spark, path, (50.0, 50.0, 60.0, 60.0)).count() == 0


def test_partitions_and_types(spark, tmp_path):
    d = shapefile.read_lines(spark, shp(tmp_path), rows=3)
    assert d.rdd.getNumPartitions() == 2
    assert dict(d.dtypes)["width"] == "double" and dict(d.dtypes)["id"] == "bigint"
    assert {r.id: (r.name, r.width) for r in d.collect()} == {7: ("Main", 2.5), -8: ("Été", 2.5), 9: (None, 2.5), 10: ("far", 2.5)}
    g = shapefile.read_lines(spark, write_gpkg(tmp_path / "a.gpkg", ROWS))
    assert dict(g.dtypes)["toll"] == "boolean" and {r.id: r.toll for r in g.collect()} == {7: False, -8: True, 9: False, 10: True}


def test_deleted_and_empty_records(spark, tmp_path):
    rows = [((1, 1, 2, "a", "", 1), [[(0.0, 0.0), (1.0, 1.0)]]), ((2, 1, 2, "b", "", 1), None), ((3, 1, 2, "c", "", "x"), [[(0.0, 0.0), (1.0, 1.0)]])]
    path = write_shp(tmp_path / "odd", rows, FIELDS, deleted=(0,))
    assert [(r.id, r.width) for r in shapefile.read_lines(spark, path).collect()] == [(3, None)]
    none = write_shp(tmp_path / "none", [], FIELDS)
    assert shapefile.read_lines(spark, none).count() == 0


def test_wrong_files_are_reported(spark, tmp_path):
    with pytest.raises(ValueError, match="no field target"):
        shapefile.read_network(spark, write_shp(tmp_path / "x", [], FIELDS[:2]))
    with pytest.raises(Exception, match="no lines"):
        shapefile.read_lines(spark, shp(tmp_path, kind=5)).collect()
    with pytest.raises(ValueError, match="no field nr"):
        shapefile.read_trajectories(spark, shp(tmp_path), "nr")


def test_trajectories(spark, tmp_path):
    got = sorted((r.traj_id, r.seq, r.x, r.y) for r in files.read_gps(spark, write_gpkg(tmp_path / "t.gpkg", ROWS[:2])).collect())
    assert got == [(-8, 0, 2.0, 0.0), (-8, 1, 5.0, 0.0), (7, 0, 0.0, 0.0), (7, 1, 1.0, 0.5), (7, 2, 2.0, 0.0)]
