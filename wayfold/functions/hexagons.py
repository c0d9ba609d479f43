"""Hexagonal cells of the plane as Spark columns, which all stay in the JVM.

A cell is struct<q bigint, r bigint>: its place on the two axes, 60 degrees apart, of a grid of pointed-topped hexagons;
(0, 0) lies around the origin. Seven cells, one and the six around it, make a cell of the next level, whose grid is
sqrt(7) times as wide and turned by some 19 degrees. With cells as complex numbers q + r * exp(i pi / 3), going a level
down is a product with 2 + exp(i pi / 3), and going up divides by it and rounds, never with a tie. Null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geometry import let, point

#: The six cells around a cell.
AROUND = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
#: Bits of an axis in a cell's number; axes reach from -2^28 to 2^28 - 1, levels to 30.
BITS = 29
#: Added to places on a line between cells, so that none lies on a border.
NUDGE = (1e-6, 2e-6)


def cell(q: Column, r: Column) -> Column:
    made = F.struct(q.cast("long").alias("q"), r.cast("long").alias("r"))
    return F.when(q.isNotNull() & r.isNotNull(), made)


def _nearest(q: Column, r: Column) -> Column:
    """The cell whose centre is nearest to a place between cells: the axis that rounding moves most follows from the others."""

    def settled(v: Column) -> Column:
        a, b, c = v["a"], v["b"], v["c"]
        da, db, dc = F.abs(a - v["q"]), F.abs(b - v["r"]), F.abs(c + v["q"] + v["r"])
        first, second = (da > db) & (da > dc), db > dc
        return cell(F.when(first, -b - c).otherwise(a), F.when(first, b).when(second, -a - c).otherwise(b))

    whole = lambda v: F.floor(v + 0.5)
    return let(F.struct(q.alias("q"), r.alias("r"), whole(q).alias("a"), whole(r).alias("b"), whole(-q - r).alias("c")), settled)


def at(x: Column, y: Column, size: float, level: int = 0) -> Column:
    """The cell of a point; `size` is the side of a cell of level 0."""
    c = _nearest((x * math.sqrt(3) / 3 - y / 3) / size, y * 2 / 3 / size)
    return ancestor(c, level)


def parent(c: Column) -> Column:
    up = lambda n: F.floor((2 * n + 7) / 14)
    return let(c, lambda v: cell(up(3 * v["q"] + v["r"]), up(2 * v["r"] - v["q"])))


def ancestor(c: Column, levels: int) -> Column:
    for _ in range(levels):
        c = parent(c)
    return c


def middle_child(c: Column) -> Column:
    return let(c, lambda v: cell(2 * v["q"] - v["r"], v["q"] + 3 * v["r"]))


def neighbours(c: Column) -> Column:
    """The six cells around a cell, counter-clockwise from the right."""
    return let(c, lambda v: F.when(v.isNotNull(), F.array(*(cell(v["q"] + q, v["r"] + r) for q, r in AROUND))))


def children(c: Column) -> Column:
    """The seven cells of the level below, the middle one first."""
    return let(middle_child(c), lambda v: F.when(v.isNotNull(), F.array(v, *(cell(v["q"] + q, v["r"] + r) for q, r in AROUND))))


def steps(a: Column, b: Column) -> Column:
    """Steps from a cell to another of the same level."""
    q, r = b["q"] - a["q"], b["r"] - a["r"]
    return ((F.abs(q) + F.abs(r) + F.abs(q + r)) / 2).cast("long")


def path(a: Column, b: Column) -> Column:
    """The cells on the straight line from a cell to another, both included."""

    def walk(v: Column) -> Column:
        a, b, n = v["a"], v["b"], v["n"]
        share = lambda i: i / F.greatest(n, F.lit(1))
        place = lambda axis, i, nudge: a[axis] + (b[axis] - a[axis]) * share(i) + nudge
        return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: _nearest(place("q", i, NUDGE[0]), place("r", i, NUDGE[1])))

    return let(F.struct(a.alias("a"), b.alias("b"), steps(a, b).alias("n")), walk)


def disk(c: Column, k: int) -> Column:
    """All cells within k steps, by their axes."""
    near = [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, k - q) + 1)]
    return let(c, lambda v: F.when(v.isNotNull(), F.array(*(cell(v["q"] + q, v["r"] + r) for q, r in near))))


def number(c: Column, level: int = 0) -> Column:
    """Level and cell as one number, for keys and files; null where an axis is out of range."""
    half = 1 << (BITS - 1)
    inside = lambda axis: (axis >= -half) & (axis < half)
    made = lambda v: F.lit(level << (2 * BITS)) + F.shiftleft(v["q"] + half, BITS) + v["r"] + half
    return let(c, lambda v: F.when(inside(v["q"]) & inside(v["r"]), made(v)))


def level_of(n: Column) -> Column:
    return F.shiftright(n, 2 * BITS).cast("int")


def from_number(n: Column) -> Column:
    half, mask = 1 << (BITS - 1), (1 << BITS) - 1
    return cell(F.shiftright(n, BITS).bitwiseAND(F.lit(mask)) - half, n.bitwiseAND(F.lit(mask)) - half)


def middle(c: Column, size: float, level: int = 0) -> Column:
    """The centre of a cell."""
    for _ in range(level):
        c = middle_child(c)
    return let(c, lambda v: F.when(v.isNotNull(), point(size * math.sqrt(3) * (v["q"] + v["r"] / 2), size * 1.5 * v["r"])))


def outline(c: Column, size: float, level: int = 0) -> Column:
    """The border as a closed line of seven points, counter-clockwise."""
    far, turn = size * 7 ** (level / 2), level * math.atan2(math.sqrt(3) / 2, 2.5)
    angles = [turn + math.pi / 6 + k % 6 * math.pi / 3 for k in range(7)]
    return let(middle(c, size, level), lambda m: F.when(m.isNotNull(), F.array(*(point(m["x"] + far * math.cos(a), m["y"] + far * math.sin(a)) for a in angles))))


def to_wkt(cells: Column, size: float, level: int = 0) -> Column:
    """An array of cells as a MULTIPOLYGON."""
    ring = lambda c: F.concat(F.lit("(("), F.array_join(F.transform(outline(c, size, level), lambda p: F.concat_ws(" ", p["x"], p["y"])), ","), F.lit("))"))
    return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(cells, ring), ","), F.lit(")"))
