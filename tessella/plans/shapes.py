"""Queries over polygons with holes, lines and rings of any kind."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.operators import clip, polygons, raster, runs, spatial
from tessella.plans import bindings as B
from tessella.plans.registry import query
from tessella.plans.tiling import PATCHES, WITH, patches

K = B.KEYS
RASTER = f"WITH {B.RASTER}, "
#: Boxes with a hole one pixel inside, if they are wide enough.
HOLES = "hb AS (SELECT sample_id, label, x0, y0, x1, y1, CASE WHEN x1 - x0 > 2 AND y1 - y0 > 2 THEN 1 ELSE 0 END AS holed FROM tb WHERE x1 > x0 AND y1 > y0)"


def _holed(s, d):
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    outer = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    hole = F.reverse(arrays.box_ring(F.col("x0") + 1, F.col("y0") + 1, F.col("x1") - 1, F.col("y1") - 1))
    wide = (F.col("x1") - F.col("x0") > 2) & (F.col("y1") - F.col("y0") > 2)
    return b.select(*K, "label", "x0", "y0", "x1", "y1", F.when(wide, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


def _part(a: str, b: str, low: str, high: str) -> str:
    return f"greatest(least({b}, {high}) - greatest({a}, {low}), 0)"


@query("geo_02", f"{WITH} {PATCHES}, {HOLES} SELECT pt.sample_id, py0, px0, label, 'grain ' || label AS name, ({_part('x0', 'x1', 'px0', 'px1')} * {_part('y0', 'y1', 'py0', 'py1')} - holed * {_part('x0 + 1', 'x1 - 1', 'px0', 'px1')} * {_part('y0 + 1', 'y1 - 1', 'py0', 'py1')})::DOUBLE AS area FROM pt JOIN hb ON hb.sample_id = pt.sample_id AND x0 < px1 AND px0 < x1 AND y0 < py1 AND py0 < y1")
def geo_02(s, d):
    """Polygons with holes cut by the patches they meet; properties stay, and what has no outer ring left is dropped."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / B.TILE), F.floor((F.col(high) - 1) / B.TILE))
    cells = _holed(s, d).withColumn("ty", F.explode(span("y0", "y1"))).withColumn("tx", F.explode(span("x0", "x1")))
    p = patches(s, d).withColumn("ty", F.floor(F.col("py0") / B.TILE)).withColumn("tx", F.floor(F.col("px0") / B.TILE))
    met = p.join(cells, [*K, "ty", "tx"]).select(*K, "py0", "px0", "label", F.concat(F.lit("grain "), F.col("label").cast("string")).alias("name"), "rings", *[F.col(c).cast("double").alias(f"c{c}") for c in ("px0", "py0", "px1", "py1")])
    cut = clip.clip_polygons(met, "rings", ["cpx0", "cpy0", "cpx1", "cpy1"])
    areas = F.transform("rings", arrays.shoelace)
    area = F.get(areas, F.lit(0)) - F.aggregate(F.slice(areas, F.lit(2), F.size(areas)), F.lit(0.0), lambda a, x: a + x)
    return cut.select(*K, "py0", "px0", "label", "name", area.alias("area"))


#: Squares on a corner: as far from the middle in steps along the axes as half the shorter side.
CORNERED = "dm AS (SELECT sample_id, label, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, least(x1 - x0, y1 - y0) / 2.0::DOUBLE AS r, x0, y0, x1, y1 FROM tb WHERE x1 > x0 AND y1 > y0)"


def _cornered(s, d):
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    r = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return b.select(*K, "label", "x0", "y0", "x1", "y1", F.array(corner(cx + r, cy), corner(cx, cy + r), corner(cx - r, cy), corner(cx, cy - r)).alias("ring"))


@query("join_07", f"{WITH} {CORNERED} SELECT a.sample_id, a.label AS i, b.label AS j FROM dm a JOIN dm b ON a.sample_id = b.sample_id AND a.label < b.label AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE abs(a.cx - b.cx) + abs(a.cy - b.cy) < a.r + b.r")
def join_07(s, d):
    """Pairs of polygons that truly intersect, of those whose bounds meet."""
    c = _cornered(s, d)
    near = spatial.meeting_boxes(c.select(*K, F.col("label").alias("id"), "x0", "y0", "x1", "y1"), K).select(*K, "i", "j")
    ring = lambda n: c.select(*K, F.col("label").alias(n), F.col("ring").alias(f"ring_{n}"))
    both = near.join(ring("i"), [*K, "i"]).join(ring("j"), [*K, "j"])

    def refined(batches):
        for batch in batches:
            points = lambda r: [(p["x"], p["y"]) for p in r]
            yield batch[[polygons.intersects(points(a), points(b)) for a, b in zip(batch["ring_i"], batch["ring_j"], strict=True)]][[*K, "i", "j"]]

    return both.mapInPandas(refined, near.schema)


@query("prj_15", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, CASE label % 4 WHEN 0 THEN concat_ws(' ', x0, y1, x0, y0, x1, y0, x1, y1) WHEN 1 THEN concat_ws(' ', x1, y1, x0, y1, x0, y0, x1, y0) WHEN 2 THEN concat_ws(' ', x1, y0, x1, y1, x0, y1, x0, y0) ELSE concat_ws(' ', x0, y0, x1, y0, x1, y1, x0, y1) END AS flat FROM tb WHERE x1 > x0 AND y1 > y0")
def prj_15(s, d):
    """Rings given clockwise and closed as flat lists: counter-clockwise from the same point on, not closed."""
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    ring = F.reverse(arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    k = (F.col("label") % 4).cast("int")
    turned = F.concat(F.slice(ring, k + 1, 4), F.slice(ring, F.lit(1), k))
    flat = arrays.flat_ring(arrays.oriented_ring(F.concat(turned, F.slice(turned, 1, 1))))
    return b.select(*K, "label", F.array_join(F.transform(flat, lambda v: v.cast("int").cast("string")), " ").alias("flat"))


@query("prj_20", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, 'area=' || ((x1 - x0) * (y1 - y0)) || ',predicted_iou=' || (label % 7) || ',tile_x=' || x0 AS kept FROM tb")
def prj_20(s, d):
    """Annotations with the keys on the list only."""
    c = F.col
    text = lambda v: v.cast("string")
    m = F.create_map(F.lit("tile_x"), text(c("x0")), F.lit("logits"), F.lit("x"), F.lit("area"), text((c("x1") - c("x0")) * (c("y1") - c("y0"))), F.lit("segmentation"), F.lit("y"), F.lit("predicted_iou"), text(c("label") % 7))
    kept = F.map_filter(m, lambda k, v: k.isin("rle", "area", "bbox", "predicted_iou", "stability_score", "tile_x", "tile_y"))
    pairs = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), kept[k]))
    return B.boxes(s, d).select(*K, "label", F.array_join(pairs, ",").alias("kept"))


@query("flt_06", f"{WITH} x AS (SELECT 1) SELECT sample_id, label FROM tb WHERE x1 > x0 AND y1 > y0 AND label % 5 <> 0")
def flt_06(s, d):
    """Polygons that are valid (no edges cross) and have three distinct points or more; every fifth ring crosses itself."""
    ring = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    at = lambda i: F.get(ring, F.lit(i))
    b = B.boxes(s, d).select(*K, "label", F.when(F.col("label") % 5 == 0, F.array(at(0), at(2), at(1), at(3))).otherwise(ring).alias("ring"))
    b = b.where((F.size(F.array_distinct("ring")) >= 3) & (F.abs(arrays.shoelace(F.col("ring"))) >= 0))
    return polygons.by_ring(b, "ring", lambda r: (polygons.is_simple(r),), "valid boolean").where("valid").select(*K, "label")


@query("flt_07", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, 4 AS points FROM tb WHERE x1 > x0 AND y1 > y0")
def flt_07(s, d):
    """Contours with a point more on each edge, simplified; those of fewer than three points are dropped, as boxes without an inside are."""
    ring = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    half = lambda p, q: F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))
    more = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(ring, i), half(F.get(ring, i), F.get(ring, (i + 1) % 4)))))
    b = B.boxes(s, d).select(*K, "label", more.alias("ring"))
    found = polygons.by_ring(b, "ring", lambda r: (len(set(polygons.simplify([*r, r[0]], 0.001))),), "points int")
    return found.where("points >= 3").select(*K, "label", "points")


@query("flt_09", f"{WITH} x AS (SELECT 1) SELECT sample_id, label FROM tb WHERE label % 4 >= 2 AND x1 > x0 AND y1 > y0")
def flt_09(s, d):
    """Features that have a geometry, which isn't empty and is a polygon."""
    ring = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    rings = F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.array(ring)).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    kind = F.when(F.col("label") % 4 == 1, "LineString").otherwise("Polygon")
    b = B.boxes(s, d).select(*K, "label", F.when(F.col("label") % 4 > 0, F.struct(kind.alias("type"), rings.alias("rings"))).alias("geometry"))
    return b.where("geometry is not null and geometry.type = 'Polygon' and size(geometry.rings) > 0").select(*K, "label")


@query("win_06", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, CASE WHEN x1 > x0 AND y1 > y0 THEN 4 WHEN x1 > x0 THEN 3 WHEN y1 > y0 THEN 3 ELSE 1 END AS points FROM tb")
def win_06(s, d):
    """Rings in which points follow themselves once to three times, without repeats; boxes without a width or height have fewer points."""
    ring = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    more = F.flatten(F.transform(ring, lambda p: F.array_repeat(p, (F.col("label") % 3 + 1).cast("int"))))
    return B.boxes(s, d).select(*K, "label", F.size(arrays.dedupe_consecutive(more)).alias("points"))


@query("geo_13", f"""{WITH} {HOLES}, axis2 AS (SELECT unnest(range(64)) AS v), draws AS (
SELECT sample_id, label, 0 AS pass, 0 AS part, 2 AS cls, x0, y0, x1, y1 FROM hb UNION ALL SELECT sample_id, label, 0, 1, 0, x0 + 1, y0 + 1, x1 - 1, y1 - 1 FROM hb WHERE holed = 1
UNION ALL SELECT sample_id, label, 1, 0, 1, x0 + 1, y0 + 1, x1 - 1, y1 - 1 FROM hb WHERE holed = 0 AND x1 - x0 > 2 AND y1 - y0 > 2)
SELECT sample_id, y.v::INTEGER AS y, x.v::INTEGER AS x, arg_max(cls, (pass * 1000000 + label) * 2 + part) AS cls FROM draws JOIN axis2 y ON y.v >= y0 AND y.v < y1 JOIN axis2 x ON x.v >= x0 AND x.v < x1 GROUP BY ALL""")
def geo_13(s, d):
    """Polygons with holes drawn in two passes: all as boundary with their holes empty, then each shrunk by a pixel as interior (rings with a hole a pixel inside have no interior left); later draws win."""
    h = _holed(s, d)
    outer, hole = h.withColumn("rings", F.slice("rings", 1, 1)), h.where("size(rings) > 1").withColumn("rings", F.slice("rings", 2, 1))
    plain = h.where("size(rings) = 1").select(*K, "label", F.get("rings", F.lit(0)).alias("ring"))
    small = polygons.by_ring(plain, "ring", lambda r: ([[{"x": x, "y": y} for x, y in polygons.shrink_convex(r, 1.0)]],), "rings array<array<struct<x: double, y: double>>>")
    draws = [(outer, 0, 0, 2), (hole, 0, 1, 0), (small.where("size(rings[0]) > 0"), 1, 0, 1)]
    rows = None
    for rings, done, part, cls in draws:
        one = polygons.filled(rings, [*K, "label"], "rings", B.SIDE, B.SIDE).select("*", F.lit(done).alias("pass"), F.lit(part).alias("part"), F.lit(cls).alias("cls"))
        rows = one if rows is None else rows.unionByName(one)
    return runs.to_pixels(rows).groupBy(*K, "y", "x").agg(F.max_by("cls", F.struct("pass", "label", "part")).alias("cls"))


@query("geo_14", f"{WITH} {HOLES} SELECT sample_id, label, ((x1 - x0) * (y1 - y0) - holed * (x1 - x0 - 2) * (y1 - y0 - 2))::BIGINT AS area, (y0 * 64 + x0)::BIGINT AS first_run FROM hb")
def geo_14(s, d):
    """Features with holes drawn to masks and kept as run lengths; empty masks are dropped."""
    spans = polygons.filled(_holed(s, d), [*K, "label"], "rings", B.SIDE, B.SIDE)
    start, length = (F.col("y") * B.SIDE + F.col("x0")).cast("long"), (F.col("x1") - F.col("x0")).cast("long")
    return spans.groupBy(*K, "label").agg(F.sum(length).alias("area"), F.min(start).alias("first_run"))


COMPS = """px AS (SELECT sample_id, y, x, y * 64 + x AS id FROM sem WHERE cls = 1),
reach(sample_id, a, b) AS (SELECT sample_id, id, id FROM px UNION SELECT r.sample_id, r.a, n.id FROM reach r JOIN px p ON p.sample_id = r.sample_id AND p.id = r.b JOIN px n ON n.sample_id = p.sample_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1),
comp AS (SELECT sample_id, a AS id, min(b) AS root FROM reach GROUP BY ALL)"""


def _components(s, d):
    interior = runs.to_runs(B.semantic(s, d).where("cls = 1").select(*K, "y", "x", F.lit(1).alias("label")), K)
    return runs.to_pixels(runs.connected_components(interior, K, True)).select(*K, "comp", "y", "x")


@query("geo_16", f"WITH RECURSIVE {B.SQL}, {B.SEM}, {COMPS} SELECT px.sample_id, dense_rank() OVER (PARTITION BY px.sample_id ORDER BY root)::INTEGER AS comp, count(*) AS pixel_area, count(*)::DOUBLE AS area, min(x)::DOUBLE AS minx, -max(y)::DOUBLE - 1 AS miny, max(x)::DOUBLE + 1 AS maxx, -min(y)::DOUBLE AS maxy FROM px JOIN comp ON comp.sample_id = px.sample_id AND comp.id = px.id GROUP BY px.sample_id, root")
def geo_16(s, d):
    """Components as polygons along their pixels' edges, y upwards: the area of the rings is the number of pixels."""
    t = polygons.trace(_components(s, d), [*K, "comp"])
    flat = F.flatten("rings")
    side = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    return t.select(*K, "comp", "pixel_area", "area", side(F.array_min, "x").alias("minx"), (-side(F.array_max, "y")).alias("miny"), side(F.array_max, "x").alias("maxx"), (-side(F.array_min, "y")).alias("maxy"))


@query("geo_15")
def geo_15(s, d):
    """Outer contours of the components, simplified by a thousandth of their length, moved to the canvas and y turned. No SQL: tracing and simplifying are sequential."""
    return polygons.contour_rows(_components(s, d), [*K, "comp"])


@query("geo_18", f"{WITH} {CORNERED} SELECT sample_id, label, CASE WHEN label % 2 = 0 THEN (greatest(x1 - x0 - 2, 0) * greatest(y1 - y0 - 2, 0))::DOUBLE ELSE round(2 * power(greatest(r - sqrt(2::DOUBLE), 0), 2), 6) END AS area FROM dm")
def geo_18(s, d):
    """Convex polygons with their edges moved inwards by a pixel: boxes, and squares on a corner."""
    c = _cornered(s, d)
    own = F.when(F.col("label") % 2 == 0, arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).otherwise(F.col("ring"))
    found = polygons.by_ring(c.select(*K, "label", own.alias("ring")), "ring", lambda r: (round(abs(polygons.area(polygons.shrink_convex(r, 1.0))), 6),), "area double")
    return found.select(*K, "label", "area")


@query("geo_19", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, CASE WHEN x1 > x0 AND y1 > y0 THEN 4 WHEN x1 > x0 OR y1 > y0 THEN 2 ELSE 1 END AS points, x1 > x0 AND y1 > y0 AND label % 5 <> 0 AS valid FROM tb")
def geo_19(s, d):
    """Rings whose points lie beside the precision grid and follow each other within it: snapped points, and whether the ring is valid."""
    ring = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    at = lambda i: F.get(ring, F.lit(i))
    own = F.when(F.col("label") % 5 == 0, F.array(at(0), at(2), at(1), at(3))).otherwise(ring)
    beside = lambda p, by: F.struct((p["x"] + by).alias("x"), (p["y"] - by).alias("y"))
    twice = F.flatten(F.transform(own, lambda p: F.array(beside(p, 1e-7), beside(p, -1e-7))))

    def snapped(r):
        points = polygons.snap(r)
        return len(set(points)), len(set(points)) >= 3 and polygons.is_simple(points)

    return polygons.by_ring(B.boxes(s, d).select(*K, "label", twice.alias("ring")), "ring", snapped, "points int, valid boolean").select(*K, "label", "points", "valid")


@query("lim_09", f"{WITH} x AS (SELECT 1) SELECT sample_id, arg_max(label, (x1 - x0 + y1 - y0) * 1000000000 - label) AS longest, max(x1 - x0 + y1 - y0)::DOUBLE AS length FROM tb GROUP BY ALL")
def lim_09(s, d):
    """The longest of each sample's lines, of equal ones the first; lines go along two sides of a box."""
    line = F.slice(arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 1, 3)
    b = B.boxes(s, d).select(*K, "label", arrays.line_length(line).alias("length"))
    return b.groupBy(*K).agg(F.max_by("label", F.struct("length", -F.col("label"))).alias("longest"), F.max("length").alias("length"))


STARTS = "st AS (SELECT unnest([0, 3, 4]) AS o)"


@query("stm_03", f"{RASTER} {STARTS} SELECT vec_id, a.o AS py, b.o AS px, min(u) AS low, max(u) AS high FROM rast, st a, st b WHERE y >= a.o AND y < a.o + 4 AND x >= b.o AND x < b.o + 4 GROUP BY ALL")
def stm_03(s, d):
    """Windows that slide over space, not time: starts by stride and one flush with the end, for images of one size."""
    starts = arrays.window_starts(F.lit(8), 4, 3)
    of = lambda c: F.filter(starts, lambda o: (F.col(c) >= o) & (F.col(c) < o + 4))
    p = B.raster(s, d).select("vec_id", "u", F.explode(of("y")).alias("py"), "x").withColumn("px", F.explode(of("x")))
    return p.groupBy("vec_id", "py", "px").agg(F.min("u").alias("low"), F.max("u").alias("high"))


@query("ml_07", f"{RASTER} x AS (SELECT 1) SELECT vec_id, y, x, CASE WHEN u <= 84 THEN 0 WHEN u <= 170 THEN 1 ELSE 2 END AS cls FROM rast")
def ml_07(s, d):
    """Whole images predicted by overlapping patches; the model is a function of a batch of patches."""
    i = B.raster(s, d).select("vec_id", "y", "x", (F.col("u") / 255.0).alias("v"))

    def model(v):
        return np.stack([1 - v, 1.01 - np.abs(2 * v - 1), v], -1)

    return raster.predict_tiled(i, ["vec_id"], 8, 4, 2, model)
