"""Queries over tiles, patches, coverage, splits and box geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.operators import clip, grid
from tessella.plans import bindings as B
from tessella.plans.registry import query

K = B.KEYS
WITH = f"WITH {B.SQL}, "
N = B.SIDE // B.TILE
STARTS = sorted({*range(0, B.TILE - B.PATCH + 1, B.STRIDE), B.TILE - B.PATCH})
ST = f"st AS (SELECT unnest({STARTS}) AS o)"
TILES = f"tl AS (SELECT sample_id, (ty * {B.TILE})::INTEGER AS y0, ((ty + 1) * {B.TILE})::INTEGER AS y1, (tx * {B.TILE})::INTEGER AS x0, ((tx + 1) * {B.TILE})::INTEGER AS x1 FROM samples, range({N}) a(ty), range({N}) b(tx))"
PATCHES = f"{TILES}, {ST}, pt AS (SELECT sample_id, y0 + a.o AS py0, y0 + a.o + {B.PATCH} AS py1, x0 + b.o AS px0, x0 + b.o + {B.PATCH} AS px1 FROM tl, st a, st b)"


def tiles(s, d):
    return grid.tiles(B.samples(s, d), B.TILE).select(*K, "y0", "y1", "x0", "x1")


def patches(s, d):
    return grid.patches(tiles(s, d), B.PATCH, B.STRIDE).select(*K, "py0", "py1", "px0", "px1")


@query("gen_01", f"WITH s AS (SELECT DISTINCT p_size AS size FROM part), c AS (SELECT size, unnest(list_distinct(list_concat(range(0, greatest(size - 10, 0) + 1, 4), [greatest(size - 10, 0)]))) AS start FROM s) SELECT size, start::INTEGER AS start FROM c")
def gen_01(s, d):
    """Window starts over lengths of all part sizes."""
    sizes = B.table(s, d, "part").select(F.col("p_size").alias("size")).distinct()
    return sizes.select("size", F.explode(arrays.window_starts(F.col("size"), 10, 4)).alias("start"))


@query("gen_02", f"{WITH} {TILES} SELECT * FROM tl")
def gen_02(s, d):
    return tiles(s, d)


@query("gen_03", f"{WITH} {PATCHES} SELECT * FROM pt")
def gen_03(s, d):
    return patches(s, d)


@query("gen_05", f"{WITH} x AS (SELECT 1) SELECT sample_id, least(20, 64 - cy * 20)::INTEGER AS h, least(20, 64 - cx * 20)::INTEGER AS w, count(*) AS n FROM samples, range(4) a(cy), range(4) b(cx) GROUP BY ALL")
def gen_05(s, d):
    """Chunks of 20 pixels, cut at the edges, counted by shape."""
    c = grid.tiles(B.samples(s, d), 20)
    return c.select(*K, (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w")).groupBy(*K, "h", "w").agg(F.count("*").alias("n"))


GRID = {"min_distance": [3, 5, 7], "dilate": [0, 1], "connectivity": [1, 2], "min_area": [0], "exclude_border": [True, False], "ridge": [0.5]}
PGRID = "pg AS (SELECT a.v::INTEGER AS min_distance, b.v::INTEGER AS dilate, c.v::INTEGER AS connectivity, 0 AS min_area, e.v AS exclude_border, 0.5::DOUBLE AS ridge FROM (VALUES (3), (5), (7)) a(v), (VALUES (0), (1)) b(v), (VALUES (1), (2)) c(v), (VALUES (true), (false)) e(v))"


@query("gen_04", f"WITH {PGRID} SELECT * FROM pg")
def gen_04(s, d):
    return grid.parameter_grid(s, **GRID)


@query("join_11", f"{WITH} {PGRID} SELECT samples.sample_id, pg.* FROM samples, pg")
def join_11(s, d):
    """Every setting with every sample; the grid is a fixed small table."""
    return B.samples(s, d).select(*K).join(F.broadcast(grid.parameter_grid(s, **GRID)))


COV = f"{TILES}, n AS (SELECT sample_id, y - y % {B.TILE} AS y0, x - x % {B.TILE} AS x0, count(*) AS n FROM tpx GROUP BY ALL), cov AS (SELECT tl.*, (y0 // {B.TILE} * {N} + x0 // {B.TILE})::INTEGER AS tile, coalesce(n, 0)::DOUBLE / {B.TILE * B.TILE} AS coverage FROM tl LEFT JOIN n USING (sample_id, y0, x0))"


def coverage(s, d):
    c = grid.pixel_coverage(tiles(s, d), B.pixels(s, d), B.TILE, K)
    return c.withColumn("tile", F.expr(f"(y0 div {B.TILE}) * {N} + x0 div {B.TILE}").cast("int"))


@query("agg_06", f"{WITH} {COV} SELECT sample_id, tile, coverage FROM cov")
def agg_06(s, d):
    """Covered share of each tile, by pixels; empty tiles have 0."""
    return coverage(s, d).select(*K, "tile", "coverage")


BOXCOV = f"{TILES}, n AS (SELECT sample_id, ty * {B.TILE} AS y0, tx * {B.TILE} AS x0, sum(greatest(0, least(x1, tx * {B.TILE} + {B.TILE}) - greatest(x0, tx * {B.TILE})) * greatest(0, least(y1, ty * {B.TILE} + {B.TILE}) - greatest(y0, ty * {B.TILE}))) AS n FROM tb, range({N}) a(ty), range({N}) b(tx) GROUP BY ALL)"


@query("join_10", f"{WITH} {BOXCOV} SELECT tl.sample_id, tl.y0, tl.x0, least(coalesce(n, 0)::DOUBLE / {B.TILE * B.TILE}, 1.0) AS coverage FROM tl LEFT JOIN n ON n.sample_id = tl.sample_id AND n.y0 = tl.y0 AND n.x0 = tl.x0")
def join_10(s, d):
    """Covered share of each tile, by summed boxes, at most 1."""
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0").select(*K, *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    return grid.box_coverage(tiles(s, d), b, B.TILE, K).select(*K, "y0", "x0", "coverage")


EDGES = f"{COV}, el AS (SELECT * FROM cov WHERE coverage >= 0.10::DOUBLE), ed AS (SELECT sample_id, quantile_cont(coverage, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM el GROUP BY ALL), ed2 AS (SELECT sample_id, CASE WHEN abs(e[5] - e[1]) <= 1e-8 THEN [e[1], e[5]] ELSE e END AS e FROM ed), bn AS (SELECT el.*, CASE WHEN len(e) = 2 THEN 0 ELSE (coverage > e[2])::INTEGER + (coverage > e[3])::INTEGER + (coverage > e[4])::INTEGER END AS bin FROM el JOIN ed2 USING (sample_id))"


@query("agg_14", f"{WITH} {EDGES} SELECT sample_id, round(e[1], 9) AS e0, round(e[2], 9) AS e1, round(e[3], 9) AS e2, round(e[4], 9) AS e3, round(e[5], 9) AS e4 FROM ed2")
def agg_14(s, d):
    """Quantile edges of the eligible tiles' coverage."""
    e = grid.quantile_edges(coverage(s, d).where(F.col("coverage") >= grid.ELIGIBLE), "coverage", 4, K)
    return e.select(*K, *[F.round(F.get("edges", F.lit(i)), 9).alias(f"e{i}") for i in range(5)])


def _binned(s, d):
    c = coverage(s, d).where(F.col("coverage") >= grid.ELIGIBLE)
    return c.join(grid.quantile_edges(c, "coverage", 4, K), K).withColumn("bin", grid.bin_of(F.col("coverage"), F.col("edges")))


@query("agg_15", f"{WITH} {EDGES}, bc AS (SELECT sample_id, bin, count(*) AS n FROM bn GROUP BY ALL) SELECT sample_id, CASE WHEN count(*) < max(bin) + 1 THEN 0 ELSE min(n) END AS least, count(*) AS used FROM bc GROUP BY ALL")
def agg_15(s, d):
    """Least and used bins of the coverage; a bin without tiles counts as 0."""
    n = _binned(s, d).groupBy(*K, "bin").agg(F.count("*").alias("n"))
    return n.groupBy(*K).agg(F.when(F.count("*") < F.max("bin") + 1, 0).otherwise(F.min("n")).cast("long").alias("least"), F.count("*").alias("used"))


@query("flt_14", f"{WITH} {COV} SELECT sample_id, tile, coverage >= 0.10::DOUBLE AS eligible FROM cov")
def flt_14(s, d):
    return coverage(s, d).select(*K, "tile", (F.col("coverage") >= grid.ELIGIBLE).alias("eligible"))


SPLIT = f"""{EDGES}, tn AS (SELECT *, row_number() OVER (PARTITION BY sample_id, bin ORDER BY (tile * 7919) % 10007, tile) AS turn FROM bn),
pl AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY turn, bin, tile) AS place, count(*) OVER (PARTITION BY sample_id) AS m FROM tn),
sp AS (SELECT sample_id, tile, bin, CASE WHEN place <= least(greatest(ceil(m * 0.34::DOUBLE), 1), m - 1) THEN 'val' ELSE 'train' END AS split FROM pl UNION ALL SELECT sample_id, tile, -1, 'train' FROM cov WHERE coverage < 0.10::DOUBLE)"""


def split(s, d):
    return grid.stratified_split(coverage(s, d), K, "tile", 0.34, 4).select(*K, "tile", "bin", "split")


@query("lim_06", f"{WITH} {SPLIT} SELECT sample_id, tile, bin, split FROM sp")
def lim_06(s, d):
    """Tiles split for training and validation, stratified by coverage, in a fixed shuffled order."""
    return split(s, d)


@query("lim_07", f"{WITH} {SPLIT} SELECT sample_id, count(*) AS regions, count(*) FILTER (split = 'val') AS val FROM sp GROUP BY ALL")
def lim_07(s, d):
    return split(s, d).groupBy(*K).agg(F.count("*").alias("regions"), F.count(F.when(F.col("split") == "val", 1)).alias("val"))


@query("lim_08", f"{WITH} {COV} SELECT sample_id, tile, (row_number() OVER (PARTITION BY sample_id ORDER BY (tile * 7919) % 10007, tile) - 1) % 3 AS fold FROM cov WHERE coverage >= 0.10::DOUBLE")
def lim_08(s, d):
    c = coverage(s, d).where(F.col("coverage") >= grid.ELIGIBLE)
    return grid.folds(c, K, "tile", 3).select(*K, "tile", F.col("fold").cast("long").alias("fold"))


@query("set_01", f"{WITH} {SPLIT} SELECT sample_id, tile FROM sp WHERE split = 'train'")
def set_01(s, d):
    """Training tiles: those for training only, and the eligible ones that validation doesn't have."""
    c = coverage(s, d)
    val = split(s, d).where("split = 'val'").select(*K, "tile")
    low = c.where(F.col("coverage") < grid.ELIGIBLE).select(*K, "tile")
    return low.unionByName(c.where(F.col("coverage") >= grid.ELIGIBLE).select(*K, "tile").join(val, [*K, "tile"], "left_anti"))


@query("set_02", f"{WITH} {SPLIT} SELECT sample_id, tile, bin = -1 AS train_only FROM sp WHERE split = 'train'")
def set_02(s, d):
    return split(s, d).where("split = 'train'").select(*K, "tile", (F.col("bin") == -1).alias("train_only"))


@query("set_06", f"{WITH} {TILES} SELECT sample_id, y0, x0, 'grid' AS part FROM tl UNION ALL SELECT sample_id, y0::INTEGER, x0::INTEGER, 'box' FROM tb")
def set_06(s, d):
    """Annotations of several tilings, one after another."""
    return tiles(s, d).select(*K, "y0", "x0", F.lit("grid").alias("part")).unionByName(B.boxes(s, d).select(*K, "y0", "x0", F.lit("box").alias("part")))


CLIP = f"""{PATCHES}, cl AS (SELECT pt.sample_id, py0, px0, label, greatest(x0, px0) - px0 AS cx0, greatest(y0, py0) - py0 AS cy0, least(x1, px1) - px0 AS cx1, least(y1, py1) - py0 AS cy1
  FROM pt JOIN tb ON tb.sample_id = pt.sample_id AND x0 < px1 AND px0 < x1 AND y0 < py1 AND py0 < y1 WHERE x1 > x0 AND y1 > y0)"""


def _clipped(s, d):
    """Boxes cut by the patches they meet, as rings in the patch; met by the tile, which patches never leave."""
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    span = lambda low, high: F.sequence(F.floor(F.col(low) / B.TILE), F.floor((F.col(high) - 1) / B.TILE))
    cells = b.withColumn("ty", F.explode(span("y0", "y1"))).withColumn("tx", F.explode(span("x0", "x1")))
    p = patches(s, d).withColumn("ty", F.floor(F.col("py0") / B.TILE)).withColumn("tx", F.floor(F.col("px0") / B.TILE))
    met = p.join(cells, [*K, "ty", "tx"]).where("x0 < px1 and px0 < x1 and y0 < py1 and py0 < y1")
    d_ = lambda c: F.col(c).cast("double")
    side = [d_("px0"), d_("py0"), d_("px1"), d_("py1")]
    cut = clip.clip_rings(met.select(*K, "label", arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"), *[c.alias(n) for c, n in zip(side, ("cx0", "cy0", "cx1", "cy1"), strict=True)]), "ring", ["cx0", "cy0", "cx1", "cy1"])
    moved = F.transform("ring", lambda q: F.struct((q["x"] - F.col("cx0")).alias("x"), (q["y"] - F.col("cy0")).alias("y")))
    return cut.select(*K, F.col("cy0").cast("int").alias("py0"), F.col("cx0").cast("int").alias("px0"), "label", moved.alias("ring"))


@query("geo_01", f"{WITH} {CLIP} SELECT sample_id, py0, px0, label, cx0::DOUBLE AS cx0, cy0::DOUBLE AS cy0, cx1::DOUBLE AS cx1, cy1::DOUBLE AS cy1 FROM cl")
def geo_01(s, d):
    """Boxes cut by half-planes; the bounds of what is left."""
    side = lambda f, c: f(F.transform("ring", lambda q: q[c]))
    return _clipped(s, d).select(*K, "py0", "px0", "label", side(F.array_min, "x").alias("cx0"), side(F.array_min, "y").alias("cy0"), side(F.array_max, "x").alias("cx1"), side(F.array_max, "y").alias("cy1"))


@query("geo_03", f"{WITH} {CLIP} SELECT sample_id, py0, px0, label, ((cx1 - cx0) * (cy1 - cy0))::DOUBLE AS area FROM cl")
@query("join_09", f"{WITH} {CLIP} SELECT sample_id, py0, px0, label, ((cx1 - cx0) * (cy1 - cy0))::DOUBLE AS area FROM cl")
def geo_03(s, d):
    """Boxes and the patches they meet, with the shared area."""
    return _clipped(s, d).select(*K, "py0", "px0", "label", arrays.shoelace(F.col("ring")).alias("area"))


@query("geo_04", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, ((x1 - x0) * (y1 - y0))::DOUBLE AS area, x0::DOUBLE AS minx, y0::DOUBLE AS miny, x1::DOUBLE AS maxx, y1::DOUBLE AS maxy FROM tb WHERE x1 > x0 AND y1 > y0")
def geo_04(s, d):
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0").select(*K, "label", arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    side = lambda f, c: f(F.transform("ring", lambda q: q[c]))
    return b.select(*K, "label", arrays.shoelace(F.col("ring")).alias("area"), side(F.array_min, "x").alias("minx"), side(F.array_min, "y").alias("miny"), side(F.array_max, "x").alias("maxx"), side(F.array_max, "y").alias("maxy"))


def _t(c: str) -> str:
    """A tenth as text, as the writer gives it."""
    return f"CASE WHEN {c} % {B.PATCH} = 0 THEN ({c} // {B.PATCH})::VARCHAR || '.0' ELSE '0.' || ({c} % {B.PATCH})::VARCHAR END"


@query("prj_13", f"{WITH} {CLIP} SELECT sample_id, py0, px0, label, '0 ' || concat_ws(' ', {_t('cx0')}, {_t('cy0')}, {_t('cx1')}, {_t('cy0')}, {_t('cx1')}, {_t('cy1')}, {_t('cx0')}, {_t('cy1')}) AS row_text FROM cl")
def prj_13(s, d):
    """Label rows of the patches, as shares of the patch's size."""
    flat = F.transform(arrays.flat_ring(F.col("ring")), lambda v: arrays.decimal_text(v / F.lit(float(B.PATCH))))
    return _clipped(s, d).select(*K, "py0", "px0", "label", F.concat(F.lit("0 "), F.array_join(flat, " ")).alias("row_text"))


@query("prj_12", f"WITH v AS (SELECT DISTINCT p_size FROM part) SELECT p_size, CASE WHEN p_size % 8 = 0 THEN (p_size // 8)::VARCHAR || '.0' ELSE rtrim(printf('%.6f', p_size / 8.0::DOUBLE), '0') END AS text FROM v")
def prj_12(s, d):
    v = B.table(s, d, "part").select("p_size").distinct()
    return v.select("p_size", arrays.decimal_text(F.col("p_size") / F.lit(8.0)).alias("text"))


@query("prj_14", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, concat_ws(' ', x0, y0, x1, y0, x1, y1, x0, y1) AS ring FROM tb WHERE x1 > x0 AND y1 > y0")
def prj_14(s, d):
    """Rings given clockwise, closed and started anywhere come out alike."""
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    ring = F.reverse(arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    k = (F.col("label") % 4).cast("int")
    turned = F.concat(F.slice(ring, k + 1, 4), F.slice(ring, F.lit(1), k))
    closed = F.concat(turned, F.slice(turned, 1, 1))
    return b.select(*K, "label", F.array_join(F.transform(arrays.flat_ring(arrays.canonical_ring(closed)), lambda v: v.cast("int").cast("string")), " ").alias("ring"))


@query("flt_08", f"{WITH} {CLIP} SELECT sample_id, py0, px0, label FROM cl WHERE (cx1 - cx0) * (cy1 - cy0) > 0")
def flt_08(s, d):
    """Cut rings with six numbers or more and an area."""
    return _clipped(s, d).where((F.size("ring") * 2 >= 6) & (arrays.shoelace(F.col("ring")) > 0)).select(*K, "py0", "px0", "label")


@query("gen_07", f"{WITH} {CLIP} SELECT sample_id, label, count(*) AS parts FROM cl GROUP BY ALL")
def gen_07(s, d):
    """Multipart geometries as single parts."""
    many = _clipped(s, d).groupBy(*K, "label").agg(F.collect_list("ring").alias("parts"))
    return many.select(*K, "label", F.explode("parts").alias("part")).groupBy(*K, "label").agg(F.count("part").alias("parts"))


LOCAL = f"lc AS (SELECT sample_id, label, x0 % {B.TILE} AS lx, y0 % {B.TILE} AS ly, x0 // {B.TILE} * {B.TILE} AS tile_x, y0 // {B.TILE} * {B.TILE} AS tile_y, x1 - x0 AS w, y1 - y0 AS h, score FROM pb)"


def _local(s, d):
    b = B.boxes(s, d, True)
    return b.select(*K, "label", (F.col("x0") % B.TILE).alias("lx"), (F.col("y0") % B.TILE).alias("ly"), F.expr(f"x0 div {B.TILE} * {B.TILE}").cast("int").alias("tile_x"), F.expr(f"y0 div {B.TILE} * {B.TILE}").cast("int").alias("tile_y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "score")


@query("prj_18", f"{WITH} {LOCAL} SELECT sample_id, label, (lx + tile_x)::INTEGER AS x, (ly + tile_y)::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h FROM lc")
def prj_18(s, d):
    """Boxes of tiles in the canvas' coordinates."""
    return _local(s, d).select(*K, "label", (F.col("lx") + F.col("tile_x")).alias("x"), (F.col("ly") + F.col("tile_y")).alias("y"), "w", "h")


@query("prj_19", f"{WITH} {LOCAL} SELECT sample_id, label, tile_x::VARCHAR AS tile_x, tile_y::VARCHAR AS tile_y, 2::BIGINT AS n FROM lc")
def prj_19(s, d):
    """Properties of annotations: those on the list, without masks and lists."""
    m = F.create_map(F.lit("tile_x"), F.col("tile_x").cast("string"), F.lit("tile_y"), F.col("tile_y").cast("string"), F.lit("rle"), F.lit("x"), F.lit("segmentation"), F.lit("y"))
    kept = _local(s, d).select(*K, "label", F.map_filter(m, lambda k, v: ~k.isin("rle", "segmentation")).alias("m"))
    return kept.select(*K, "label", F.col("m")["tile_x"].alias("tile_x"), F.col("m")["tile_y"].alias("tile_y"), F.size("m").cast("long").alias("n"))


@query("prj_21", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, y0::DOUBLE AS miny, y1::DOUBLE AS maxy FROM tb")
def prj_21(s, d):
    """Boxes with y upwards (all at or below 0) turned to y downwards; the turn is decided over the whole layer."""
    up = B.boxes(s, d).select(*K, "label", (-F.col("y1")).cast("double").alias("lo"), (-F.col("y0")).cast("double").alias("hi"))
    flip = up.agg(((F.max("hi") <= 0) & (F.min("lo") < 0)).alias("flip"))
    both = up.join(F.broadcast(flip))
    return both.select(*K, "label", F.when(F.col("flip"), -F.col("hi")).otherwise(F.col("lo")).alias("miny"), F.when(F.col("flip"), -F.col("lo")).otherwise(F.col("hi")).alias("maxy"))


@query("prj_22", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, round_even(x0 + 0.5::DOUBLE, 0)::INTEGER AS left_, round_even(x1 + 0.5::DOUBLE, 0)::INTEGER AS right_, round_even(y0 + 0.25::DOUBLE, 0)::INTEGER AS top, round_even(y1 + 0.25::DOUBLE, 0)::INTEGER AS bottom FROM tb")
def prj_22(s, d):
    """Boxes given as text in any corner order, as pixel windows."""
    b = B.boxes(s, d).select(*K, "label", F.concat_ws(",", F.col("x1") + 0.5, -(F.col("y0") + 0.25), F.col("x0") + 0.5, -(F.col("y1") + 0.25)).alias("bbox"))
    p = F.transform(F.split("bbox", ","), lambda v: v.cast("double"))
    x = [F.get(p, F.lit(i)) for i in range(4)]
    whole = lambda c: F.bround(c, 0).cast("int")
    return b.select(*K, "label", whole(F.least(x[0], x[2])).alias("left_"), whole(F.greatest(x[0], x[2])).alias("right_"), whole(-F.greatest(x[1], x[3])).alias("top"), whole(-F.least(x[1], x[3])).alias("bottom"))


@query("prj_16", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, ((x1 - x0) * (y1 - y0))::DOUBLE AS area, concat_ws(',', x0, y0, x1 - x0, y1 - y0) AS bbox FROM tb WHERE x1 > x0 AND y1 > y0")
def prj_16(s, d):
    """Area and box taken from the segmentation where they are missing or 0."""
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    ring = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    given = F.when(F.col("label") % 3 == 0, None).when(F.col("label") % 3 == 1, F.lit(0.0)).otherwise(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double"))
    b = b.select(*K, "label", ring.alias("ring"), given.alias("given"))
    side = lambda f, c: f(F.transform("ring", lambda q: q[c].cast("int")))
    x0, y0, x1, y1 = side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")
    return b.select(*K, "label", F.coalesce(F.nullif("given", F.lit(0.0)), F.abs(arrays.shoelace(F.col("ring")))).alias("area"), F.concat_ws(",", x0, y0, x1 - x0, y1 - y0).alias("bbox"))


@query("prj_17", f"{WITH} x AS (SELECT 1) SELECT sample_id, label, CASE WHEN label % 4 = 0 THEN 1 ELSE label % 4 END::BIGINT AS category_id FROM pb WHERE x1 > x0 AND y1 > y0")
def prj_17(s, d):
    """Category 0 is 1; detections without a segmentation are dropped."""
    b = B.boxes(s, d, True).withColumn("seg", F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.array("x0", "y0")))
    c = F.col("label") % 4
    return b.where("seg is not null and size(seg) > 0").select(*K, "label", F.when(c == 0, 1).otherwise(c).cast("long").alias("category_id"))


@query("prj_27", "WITH v AS (SELECT DISTINCT p_size FROM part) SELECT p_size, round_even(p_size * (1 - 0.25::DOUBLE), 0)::INTEGER AS rounded, trunc(p_size * (1 - 0.25::DOUBLE))::INTEGER AS cut FROM v")
def prj_27(s, d):
    """Strides of an overlap of a quarter, rounded half to even and truncated."""
    v = B.table(s, d, "part").select("p_size").distinct()
    stride = F.col("p_size") * F.lit(1 - 0.25)
    return v.select("p_size", F.bround(stride, 0).cast("int").alias("rounded"), stride.cast("int").alias("cut"))


@query("agg_23", f"{WITH} {LOCAL} SELECT sample_id, max(tile_y + ly + h)::INTEGER AS height FROM lc GROUP BY ALL")
def agg_23(s, d):
    return _local(s, d).groupBy(*K).agg(F.max(F.col("tile_y") + F.col("ly") + F.col("h")).alias("height"))


@query("geo_08")
def geo_08(s, d):
    """Corner cutting, twice per pass: rings as lines, in array expressions."""
    line = arrays.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0").select(*K, "label", line.alias("line"))
    for _ in range(3):
        mix = lambda i, a: F.struct(*[(F.get("line", i)[c] * a + F.get("line", i + 1)[c] * (1 - a)).alias(c) for c in "xy"])
        cut = F.flatten(F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: F.array(mix(i, 0.75), mix(i, 0.25))))  # noqa: B023
        b = b.withColumn("line", F.concat(F.slice("line", 1, 1), cut, F.slice("line", -1, 1)))
    return b.select(*K, "label", F.size("line").cast("long").alias("points"))


@query("lim_10", f"{WITH} x AS (SELECT 1) SELECT t.sample_id, t.label, arg_min(p.label, (t.x0 - p.x0) * (t.x0 - p.x0) * 1000000000000 + (t.y0 - p.y0) * (t.y0 - p.y0) * 1000000000000 + p.label) AS nearest FROM tb t JOIN pb p USING (sample_id) GROUP BY ALL")
def lim_10(s, d):
    """The nearest predicted corner of the sample, of equal ones the smallest label. A sample has at most 50 boxes."""
    p = B.boxes(s, d, True).select(*K, F.col("label").alias("p"), F.col("x0").alias("q0"), F.col("y0").alias("r0"))
    both = B.boxes(s, d).select(*K, "label", "x0", "y0").join(p, K)
    far = F.pow(F.col("x0") - F.col("q0"), 2) + F.pow(F.col("y0") - F.col("r0"), 2)
    return both.groupBy(*K, "label").agg(F.min_by("p", F.struct(far, "p")).alias("nearest"))


