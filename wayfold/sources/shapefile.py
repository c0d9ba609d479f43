"""Shapefiles and GeoPackages of lines as Python data sources: planned partitions, box filter from record headers.

`spark.read.format("lines_shp").option("path", ...)`, or `lines_gpkg`; both give the attribute fields and `line`
(array of x, y; the first part of lines of several). Option `box` ("min_x,min_y,max_x,max_y") keeps records whose
bounding box meets it, without parsing the others; `rows` is the number of records of a partition. Paths are local
ones or URIs of a store that pyarrow opens; every task opens the file by itself and reads its own records: in a
shapefile the index tells their bytes, in a GeoPackage a range of row numbers.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from wayfold.operators.network import edge_table, truthy
from wayfold.operators.shared import ROOT

LINE = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
ARROW_LINE = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Fixed values of the formats: shape types of lines (plain, with heights, with measures), bytes of headers.
LINE_SHAPES, SHP_HEADER, SHX_RECORD = (3, 13, 23), 100, 8
#: Records of a partition, and of a batch.
ROWS, BATCH = 100_000, 2048


def opened(path: str) -> pa.NativeFile:
    """A file with random access, in any store that pyarrow knows."""
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        store, inner = fs.LocalFileSystem(), path
    return store.open_input_file(inner)


def piece(path: str, start: int, length: int) -> bytes:
    with opened(path) as f:
        f.seek(start)
        return f.read(length)


def box_of(options: dict) -> tuple[float, ...] | None:
    text = options.get("box")
    box = tuple(map(float, text.split(","))) if text else None
    if box is not None and len(box) != 4:
        raise ValueError(f"box takes four numbers: {text}")
    return box


def meets(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


class Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def ranges(first: int, end: int, rows: int) -> list[Range]:
    return [Range(a, min(a + rows, end)) for a in range(first, end, rows)]


class LineReader(DataSourceReader):
    """Turns records into Arrow batches; kinds of file say how records are found."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.box, self.rows = schema.names, options["path"], box_of(options), int(options.get("rows", ROWS))
        self.types = [{LongType(): pa.int64(), DoubleType(): pa.float64(), BooleanType(): pa.bool_(), StringType(): pa.string()}.get(f.dataType, ARROW_LINE) for f in schema]

    def records(self, part: Range) -> Iterator[tuple[list, np.ndarray]]:
        raise NotImplementedError

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        values, lines = [], []
        for v, line in self.records(partition) if partition else ():  # a file without records has no partition
            values.append(v)
            lines.append(line)
            if len(lines) == BATCH:
                yield self.batch(values, lines)
                values, lines = [], []
        if lines:
            yield self.batch(values, lines)

    def batch(self, values: list[list], lines: list[np.ndarray]) -> pa.RecordBatch:
        xy = np.concatenate(lines)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
        line = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["x", "y"]))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*values, strict=True), self.types, strict=False)), line.cast(ARROW_LINE)], self.names)


class Dbf:
    """The attribute table's header: fields of fixed width."""

    def __init__(self, path: str):
        self.path = path
        head = piece(path, 0, 32)
        self.count, self.header, self.width = struct.unpack("<IHH", head[4:12])
        raw, self.fields, at = piece(path, 32, self.header - 32), [], 1  # each record begins with its deletion mark
        for i in range(0, len(raw) - 31, 32):
            if raw[i] == 0x0D:
                break
            name, kind, size, decimals = raw[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(raw[i + 11]), raw[i + 16], raw[i + 17]
            self.fields.append((name, kind, at, size, decimals))
            at += size

    def types(self) -> list[StructField]:
        kinds = {"N": lambda size, dec: LongType() if dec == 0 and size <= 18 else DoubleType(), "F": lambda *_: DoubleType(), "L": lambda *_: BooleanType()}
        return [StructField(name, kinds.get(kind, lambda *_: StringType())(size, dec)) for name, kind, _, size, dec in self.fields]

    @staticmethod
    def value(raw: bytes, kind: str, whole: bool, encoding: str):
        text = raw.decode(encoding, "replace").strip(" \0")
        if kind == "L":
            return {"T": True, "t": True, "Y": True, "y": True, "F": False, "f": False, "N": False, "n": False}.get(text)
        if kind in "NF":
            try:
                return int(text) if whole else float(text)
            except ValueError:
                return None
        return text or None


def beside(path: str, extension: str) -> str:
    return path[: -len(path.rsplit(".", 1)[-1])] + extension


class ShpReader(LineReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.dbf = Dbf(beside(self.path, "dbf"))
        self.whole = [isinstance(f.dataType, LongType) for f in self.dbf.types()]
        try:
            self.encoding = piece(beside(self.path, "cpg"), 0, 40).decode().strip() or "latin-1"
        except OSError:
            self.encoding = "latin-1"

    def partitions(self) -> list[Range]:
        words = struct.unpack(">i", piece(beside(self.path, "shx"), 24, 4))[0]
        return ranges(0, (2 * words - SHP_HEADER) // SHX_RECORD, self.rows)

    def records(self, part: Range) -> Iterator[tuple[list, np.ndarray]]:
        n, dbf = part.end - part.first, self.dbf
        index = np.frombuffer(piece(beside(self.path, "shx"), SHP_HEADER + SHX_RECORD * part.first, SHX_RECORD * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows = piece(dbf.path, dbf.header + dbf.width * part.first, dbf.width * n)
        with opened(self.path) as shp:
            for i, (start, length) in enumerate(index.tolist()):
                row = rows[i * dbf.width : (i + 1) * dbf.width]
                if row[:1] == b"*":
                    continue
                shp.seek(start + 8)
                head = shp.read(min(44, length))
                kind = struct.unpack("<i", head[:4])[0]
                if kind == 0:
                    continue
                if kind not in LINE_SHAPES:
                    raise ValueError(f"{self.path} holds shapes of type {kind}, which are no lines")
                *box, parts, points = struct.unpack("<4d2i", head[4:])
                if self.box is not None and not meets(tuple(box), self.box):
                    continue
                body = shp.read(4 * parts + 16 * points)
                end = struct.unpack("<i", body[4:8])[0] if parts > 1 else points
                xy = np.frombuffer(body, "<f8", 2 * end, 4 * parts).reshape(-1, 2)
                yield [Dbf.value(row[a : a + size], k, w, self.encoding) for (_, k, a, size, _), w in zip(dbf.fields, self.whole, strict=True)], xy


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines_shp"

    def schema(self) -> StructType:
        return StructType([*Dbf(beside(self.options["path"], "dbf")).types(), StructField("line", LINE)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShpReader(schema, dict(self.options))


def wkb_line(b: bytes) -> np.ndarray | None:
    """Points of a line, or of the first one of several; None for other geometries."""
    order = "<" if b[0] == 1 else ">"
    kind = struct.unpack(f"{order}I", b[1:5])[0]
    if kind % 1000 == 5 and struct.unpack(f"{order}I", b[5:9])[0]:
        return wkb_line(b[9:])
    if kind % 1000 != 2:
        return None
    width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    n = struct.unpack(f"{order}I", b[5:9])[0]
    return np.frombuffer(b, f"{order}f8", width * n, 9).reshape(-1, width)[:, :2].astype(np.float64)


def gpkg_line(blob: bytes) -> np.ndarray | None:
    """The line of a GeoPackage geometry, behind its header and envelope."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 16:  # no geometry, or an empty one
        return None
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return wkb_line(blob[8 + envelope :])


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Gpkg:
    """The first table of lines in a file."""

    def __init__(self, path: str):
        self.path = path
        with self.connected() as db:
            found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE upper(geometry_type_name) IN ('LINESTRING', 'MULTILINESTRING', 'GEOMETRY') ORDER BY table_name").fetchone()
            if found is None:
                raise ValueError(f"{path} has no table of lines")
            self.table, self.column = found
            kinds = {"INT": LongType(), "REA": DoubleType(), "DOU": DoubleType(), "FLO": DoubleType(), "BOO": BooleanType(), "MED": LongType(), "TIN": LongType(), "SMA": LongType()}
            self.fields = [(r[1], kinds.get(r[2].upper()[:3], StringType())) for r in db.execute(f"PRAGMA table_info({quoted(self.table)})") if r[1] != self.column]
            self.first, self.last = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted(self.table)}").fetchone()
            self.tree = f"rtree_{self.table}_{self.column}"
            self.indexed = db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (self.tree,)).fetchone()[0] > 0

    def connected(self) -> sqlite3.Connection:
        """Reads a local file in place, another one through memory."""
        local = self.path.removeprefix("file://").removeprefix("file:")
        if "://" not in local:
            return sqlite3.connect(f"file:{local}?mode=ro", uri=True)
        db = sqlite3.connect(":memory:")
        with opened(self.path) as f:
            db.deserialize(f.read())
        return db


class GpkgReader(LineReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.gpkg = Gpkg(self.path)

    def partitions(self) -> list[Range]:
        return ranges(self.gpkg.first, self.gpkg.last + 1, self.rows)

    def records(self, part: Range) -> Iterator[tuple[list, np.ndarray]]:
        g = self.gpkg
        columns = ", ".join(["t." + quoted(g.column), *("t." + quoted(n) for n, _ in g.fields)])
        where, values = "t.rowid >= ? AND t.rowid < ?", [part.first, part.end]
        if self.box is not None and g.indexed:
            where += f" AND t.rowid IN (SELECT id FROM {quoted(g.tree)} WHERE minx <= ? AND maxx >= ? AND miny <= ? AND maxy >= ?)"
            values += [self.box[2], self.box[0], self.box[3], self.box[1]]
        with g.connected() as db:
            for blob, *row in db.execute(f"SELECT {columns} FROM {quoted(g.table)} t WHERE {where} ORDER BY t.rowid", values):
                line = gpkg_line(blob)
                if line is None or not len(line) or self.box is not None and not meets((*line.min(0), *line.max(0)), self.box):
                    continue
                yield [None if v is None else bool(v) if isinstance(t, BooleanType) else str(v) if isinstance(t, StringType) else v for v, (_, t) in zip(row, g.fields, strict=True)], line


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines_gpkg"

    def schema(self) -> StructType:
        return StructType([*(StructField(n, t) for n, t in Gpkg(self.options["path"]).fields), StructField("line", LINE)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return GpkgReader(schema, dict(self.options))


def read_lines(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, rows: int = ROWS) -> DataFrame:
    """Fields and lines of a .shp or .gpkg file."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    for source in (Shapefile, GeoPackage):
        spark.dataSource.register(source)
    reader = spark.read.format("lines_gpkg" if path.lower().endswith(".gpkg") else "lines_shp").option("path", path).option("rows", rows)
    if box is not None:
        reader = reader.option("box", ",".join(map(repr, map(float, box))))
    return reader.load()


def read_network(spark: SparkSession, path: str, names: tuple[str, str, str] = ("id", "source", "target"), box: tuple[float, float, float, float] | None = None, rows: int = ROWS) -> DataFrame:
    """Edges (edge_id, source, target, line, length, oneway) of a .shp or .gpkg file; names are those of the fields."""
    d = read_lines(spark, path, box, rows)
    lacking = [n for n in names if n not in d.columns]
    if lacking:
        raise ValueError(f"{path} has no field {', '.join(lacking)}; its fields are {', '.join(d.columns[:-1])}")
    oneway = truthy(F.col("oneway")) if "oneway" in d.columns else F.lit(False)
    return edge_table(d.select(*(F.col(n).cast("long").alias(to) for n, to in zip(names, ("edge_id", "source", "target"), strict=True)), "line", oneway.alias("oneway")))


def read_trajectories(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """(traj_id, line, times) of a .shp or .gpkg file; these formats hold no times."""
    d = read_lines(spark, path)
    if id_column not in d.columns:
        raise ValueError(f"{path} has no field {id_column}; its fields are {', '.join(d.columns[:-1])}")
    return d.select(F.col(id_column).cast("long").alias("traj_id"), "line", F.lit(None).cast("array<double>").alias("times")).filter("traj_id IS NOT NULL")
