"""Planar geometry as Spark columns. A line is array<struct<x double, y double>>; all functions stay in the JVM.

Lines of fewer than two points have length 0 and no segments; null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinates closer than this are one point (fixed value).
SAME_POINT = 1e-6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x: Column | str, y: Column | str) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def once(c: Column) -> Column:
    """A column that is worked out once for each row, however often what follows uses it (filters included)."""
    return F.explode(F.array(c))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def point_distance(p: Column, q: Column) -> Column:
    return distance(p["x"], p["y"], q["x"], q["y"])


def _all_but_last(line: Column) -> Column:
    return F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))


def _all_but_first(line: Column) -> Column:
    return F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))


def segments(line: Column | str) -> Column:
    """Array of (a, b, length) of successive points."""
    line = _col(line)
    return F.zip_with(_all_but_last(line), _all_but_first(line), lambda a, b: F.struct(a.alias("a"), b.alias("b"), point_distance(a, b).alias("length")))


def segment_lengths(line: Column | str) -> Column:
    return F.transform(segments(line), lambda s: s["length"])


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def length(line: Column | str) -> Column:
    return array_sum(segment_lengths(line))


def appended(line: Column, more: Column, skip: int = 0) -> Column:
    """line, then more without its first `skip` points."""
    return F.concat(line, F.slice(more, skip + 1, 1_000_000_000))


def bounding_box(line: Column | str) -> Column:
    line = _col(line)
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def lengths_to_end(line: Column | str) -> Column:
    """For each point the length of the rest of the line."""
    line = _col(line)
    rest = let(measured(line), lambda m: F.transform(m, lambda s: F.element_at(m, -1)["to"] - s["from"]))
    return F.when(F.size(line) > 1, F.concat(rest, F.array(F.lit(0.0)))).otherwise(F.transform(line, lambda p: F.lit(0.0)))


def closest_on_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    """(x, y, dist, offset) of the point of segment a-b nearest to (px, py); a zero-length segment gives a."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    share = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / square)))
    x, y = a["x"] + share * dx, a["y"] + share * dy
    return F.struct(x.alias("x"), y.alias("y"), distance(px, py, x, y).alias("dist"), (share * F.sqrt(square)).alias("offset"))


def linear_reference(line: Column | str, px: Column | str, py: Column | str) -> Column:
    """(dist, offset) of the line's nearest point; the first segment wins ties.

    A line of one segment is worked out directly, which stays in generated code.
    """
    px, py = _col(px), _col(py)
    only = closest_on_segment(px, py, F.element_at(_col(line), 1), F.element_at(_col(line), 2))
    start = F.struct(F.lit(float("inf")).alias("dist"), F.lit(0.0).alias("offset"), F.lit(0.0).alias("passed"))
    # each segment's nearest point is worked out once, before the fold compares them
    near = F.transform(segments(line), lambda s: F.struct(closest_on_segment(px, py, s["a"], s["b"]).alias("n"), s["length"].alias("length")))

    def step(best: Column, s: Column) -> Column:
        better = s["n"]["dist"] < best["dist"]
        return F.struct(
            F.when(better, s["n"]["dist"]).otherwise(best["dist"]).alias("dist"),
            F.when(better, best["passed"] + s["n"]["offset"]).otherwise(best["offset"]).alias("offset"),
            (best["passed"] + s["length"]).alias("passed"),
        )

    fold = F.aggregate(near, start, step, lambda b: F.struct(b["dist"].alias("dist"), b["offset"].alias("offset")))
    return F.when(F.size(_col(line)) == 2, F.struct(only["dist"].alias("dist"), only["offset"].alias("offset"))).otherwise(fold)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements of a block in a scan: a long array is folded block by block, so that what it has given so far isn't copied for each element.
BLOCK = 128


def scanned(values: Column, start: Column, step) -> Column:
    """Array of step(... step(step(start, v1), v2) ..., vi) for each i."""
    none = F.filter(F.array(start), lambda v: F.lit(False))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))

    def one(done: Column, v: Column) -> Column:
        return let(step(done["last"], v), lambda x: F.struct(x.alias("last"), F.concat(done["out"], F.array(x)).alias("out")))

    def block(done: Column, vs: Column) -> Column:
        own = F.aggregate(vs, F.struct(done["last"].alias("last"), none.alias("out")), one)
        return let(own, lambda x: F.struct(x["last"].alias("last"), F.concat(done["out"], F.array(x["out"])).alias("out")))

    return F.flatten(F.aggregate(blocks, F.struct(start.alias("last"), F.filter(F.array(none), lambda v: F.lit(False)).alias("out")), block)["out"])


def measured(line: Column | str) -> Column:
    """Array of (a, b, from, to): segments with their start and end along the line."""
    ends = scanned(segment_lengths(line), F.lit(0.0), lambda at, v: at + v)
    spans = let(ends, lambda e: F.zip_with(F.slice(F.concat(F.array(F.lit(0.0)), e), F.lit(1), F.size(e)), e, lambda x, y: F.struct(x.alias("from"), y.alias("to"))))
    return F.zip_with(segments(line), spans, lambda s, d: F.struct(s["a"].alias("a"), s["b"].alias("b"), d["from"].alias("from"), d["to"].alias("to")))


def first_beyond(parts: Column, beyond) -> Column:
    """Number (from 1) of the first part that is beyond, one more than there are if none is; by halving."""
    n = F.size(parts)

    def halved(r: Column, _: Column) -> Column:
        middle = F.shiftright(r["lo"] + r["hi"], 1)
        hit = F.coalesce(beyond(F.get(parts, middle - 1)), F.lit(True))
        return F.struct(F.when(hit | (r["lo"] >= r["hi"]), r["lo"]).otherwise(middle + 1).alias("lo"), F.when(hit & (r["lo"] < r["hi"]), middle).otherwise(r["hi"]).alias("hi"))

    steps = F.array_repeat(F.lit(0), F.ceil(F.log2(n + 1)).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(1).alias("lo"), (n + 1).alias("hi")), halved)["lo"]


def _within(s: Column, at: Column) -> Column:
    share = F.when(s["to"] > s["from"], (at - s["from"]) / (s["to"] - s["from"])).otherwise(F.lit(0.0))
    return let(share, lambda f: point(s["a"]["x"] + f * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + f * (s["b"]["y"] - s["a"]["y"])))


def _at(line: Column, parts: Column, offset: Column) -> Column:
    """The point at an offset along a line whose measured segments are given."""
    hit = F.get(parts, first_beyond(parts, lambda s: s["to"] >= offset) - 1)
    return F.when(offset <= 0, F.element_at(line, 1)).when(offset >= F.element_at(parts, -1)["to"], F.element_at(line, -1)).otherwise(let(hit, lambda s: _within(s, offset)))


def locate(line: Column | str, offset: Column | str) -> Column:
    """The point at an offset along the line, which is clamped to the line's ends."""
    line, offset = _col(line), _col(offset)
    return F.when(F.size(line) > 1, let(measured(line), lambda m: _at(line, m, offset))).otherwise(F.element_at(line, 1))


def _part(line: Column, parts: Column, start: Column, stop: Column) -> Column:
    after, upto = first_beyond(parts, lambda s: s["to"] > start), first_beyond(parts, lambda s: s["to"] >= stop)
    inner = let(after, lambda a: F.slice(line, a + 1, F.greatest(upto - a, F.lit(0))))  # a part's end is the vertex of the next number
    return F.concat(F.array(_at(line, parts, start)), inner, F.array(_at(line, parts, stop)))


def substring(line: Column | str, start: Column | str, stop: Column | str) -> Column:
    """The part of the line between two offsets (start before stop; both are clamped)."""
    line, start, stop = _col(line), _col(start), _col(stop)
    return F.when(F.size(line) > 1, let(measured(line), lambda m: _part(line, m, start, stop))).otherwise(F.concat(line, line))


def points_at(line: Column | str, distances: Column | str) -> Column:
    """Points at the given distances: those within the line, then its end if the last distance lies beyond."""
    line, distances = _col(line), _col(distances)

    def found(m: Column) -> Column:
        whole = F.element_at(m, -1)["to"]
        inside = F.transform(F.filter(distances, lambda d: d < whole), lambda d: _at(line, m, d))
        return F.when(F.element_at(distances, -1) >= whole, F.concat(inside, F.array(F.element_at(line, -1)))).otherwise(inside)

    return F.when(F.size(line) > 1, let(measured(line), found)).otherwise(F.slice(line, 1, 1))


def points_every(line: Column | str, step: Column) -> Column:
    """Points at 0, step, 2 step, ... and the end."""
    count = F.ceil(length(line) / step).cast("int")
    return points_at(line, F.transform(F.sequence(F.lit(0), count), lambda i: i * step))


def split_every(line: Column | str, step: Column) -> Column:
    """Pieces of the given length; the last one is shorter."""
    line = _col(line)

    def cut(m: Column) -> Column:
        whole = F.element_at(m, -1)["to"]
        pieces = F.greatest(F.ceil(whole / step).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: _part(line, m, i * step, F.least((i + 1) * step, whole)))

    return F.when(F.size(line) > 1, let(measured(line), cut)).otherwise(F.array(F.concat(line, line)))


def densified(line: Column | str, step: Column) -> Column:
    """The line with points added evenly on each segment so that none is longer than step."""
    line = _col(line)

    def filled(s: Column) -> Column:
        n = F.greatest(F.ceil(s["length"] / step).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: point(s["a"]["x"] + i / n * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + i / n * (s["b"]["y"] - s["a"]["y"])))

    return F.concat(F.slice(line, 1, 1), F.flatten(F.transform(segments(line), filled)))


def without_repeats(line: Column | str, tolerance: float = SAME_POINT) -> Column:
    """Drops points that lie within the tolerance of the last point that was kept."""
    state = lambda p, kept: F.struct(point(p["x"], p["y"]).alias("p"), kept.alias("kept"))
    far = lambda last, p: point_distance(last["p"], p) > tolerance
    start = state(point(F.lit(float("inf")), F.lit(float("inf"))), F.lit(False))  # farther than any
    steps = scanned(_col(line), start, lambda last, p: F.when(far(last, p), state(p, F.lit(True))).otherwise(state(last["p"], F.lit(False))))
    return F.transform(F.filter(steps, lambda s: s["kept"]), lambda s: s["p"])


def same_line(a: Column, b: Column, tolerance: float = SAME_POINT) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda p, q: point_distance(p, q) <= tolerance), lambda ok: ok)


def to_wkt(line: Column | str) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(_col(line), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def from_wkt(text: Column | str) -> Column:
    """A LINESTRING's points; null if the text is no line of numbers."""
    text = F.trim(_col(text))
    body = F.regexp_extract(text, r"(?i)^LINESTRING\s*\(([^()]*)\)$", 1)
    pairs = F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+"))
    line = F.transform(pairs, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.when(F.forall(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), line)


def point_from_wkt(text: Column | str) -> Column:
    """(x, y) of a POINT, in either case; null if it is none."""
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    found = F.regexp_extract(_col(text), rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$", 1)
    second = F.regexp_extract(_col(text), rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$", 2)
    return F.when(found != "", point(found.try_cast("double"), second.try_cast("double")))


def to_geojson(line: Column | str) -> Column:
    pairs = F.transform(_col(line), lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]")))
    return F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(pairs, ","), F.lit("]}"))


def random_points(line: Column | str, k: int, seed: int) -> Column:
    """k points at uniformly random distances along the line."""
    at = F.array_sort(F.array(*(F.rand(seed + i) for i in range(k))))
    return F.transform(F.transform(at, lambda v: v * length(line)), lambda d: locate(line, d))
