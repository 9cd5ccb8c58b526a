"""Array and text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once: an expression that names it often stays small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_starts(size: Column, patch: int, stride: int) -> Column:
    """Starts of windows over ``size``: every stride, and a last one flush with the end."""
    if patch <= 0 or stride <= 0 or stride > patch:
        raise ValueError("a patch and its stride are positive, and the stride is no longer than the patch")
    last = F.greatest(size - patch, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def shoelace(ring: Column) -> Column:
    """Signed area of a ring of points (x, y): positive if counter-clockwise with y upwards."""

    def area(r: Column) -> Column:
        after = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, F.lit(1), F.lit(1)))
        return F.aggregate(F.zip_with(r, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, b: a + b) / 2

    return let(ring, area)


def dedupe_consecutive(ring: Column) -> Column:
    """The points that differ from the one before."""
    return let(ring, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))


def canonical_ring(ring: Column) -> Column:
    """Counter-clockwise, without the closing point, starting at the smallest (x, y)."""

    def opened(r: Column) -> Column:
        closed = (F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1))
        return F.when(closed, F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)

    def rotated(r: Column) -> Column:
        return let(F.array_position(r, F.array_min(r)).cast("int"), lambda at: F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1)))

    return let(let(let(ring, opened), lambda r: F.when(shoelace(r) < 0, F.reverse(r)).otherwise(r)), rotated)


def oriented_ring(ring: Column) -> Column:
    """Counter-clockwise and without the closing point, from the same point on."""
    opened = lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    back = lambda r: F.concat(F.slice(r, F.lit(1), F.lit(1)), F.reverse(F.slice(r, F.lit(2), F.size(r))))
    return let(let(ring, opened), lambda r: F.when(shoelace(r) < 0, back(r)).otherwise(r))


def line_length(line: Column) -> Column:
    """The length of a line of points."""
    step = lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2)))
    steps = let(line, lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), step))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def flat_ring(ring: Column) -> Column:
    """[x1, y1, x2, y2, ...]"""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring cut by the four half-planes of a box; exact for convex rings, right in area for all."""

    none = F.array().cast("array<struct<x:double,y:double>>")

    def half(points: Column, inside, cross) -> Column:
        def cut(r: Column) -> Column:
            after = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, F.lit(1), F.lit(1)))
            step = lambda p, q: F.concat(F.when(inside(p), F.array(p)).otherwise(none), F.when(inside(p) != inside(q), F.array(cross(p, q))).otherwise(none))
            return F.flatten(F.zip_with(r, after, step))

        return let(points, cut)

    def at_x(x: Column):
        return lambda p, q: F.struct(x.alias("x"), (p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))).alias("y"))

    def at_y(y: Column):
        return lambda p, q: F.struct((p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))).alias("x"), y.alias("y"))

    for inside, cross in ((lambda p: p["x"] >= x0, at_x(x0)), (lambda p: p["x"] <= x1, at_x(x1)), (lambda p: p["y"] >= y0, at_y(y0)), (lambda p: p["y"] <= y1, at_y(y1))):
        ring = half(ring, inside, cross)
    return dedupe_consecutive(ring)


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring of a box, counter-clockwise with y upwards."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def decimal_text(value: Column) -> Column:
    """Six decimals without trailing zeros, but with one decimal at least."""
    text = F.format_string("%.6f", value)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def clean_label(label: Column) -> Column:
    """Letters, digits and + - _ stay, all else is an underscore; outer underscores go; nothing left is 'model'."""
    text = F.regexp_replace(F.regexp_replace(label, r"[^0-9A-Za-z+\-_]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("model"))


def clean_key(name: Column) -> Column:
    """Runs of other characters than letters, digits and underscores are one underscore."""
    return F.regexp_replace(name, "[^0-9A-Za-z_]+", "_")
