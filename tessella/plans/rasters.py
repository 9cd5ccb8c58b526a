"""Queries over small rasters and predictions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.operators import metrics, raster
from tessella.plans import bindings as B
from tessella.plans.registry import query

V = ["vec_id"]
G = ["grp"]
WITH = f"WITH {B.RASTER}, "
IMG = "img AS (SELECT vec_id // 3 AS grp, vec_id % 3 AS c, vec_id, y, x, v, u FROM rast)"


def _img(s, d):
    return B.raster(s, d).select(F.expr("vec_id div 3").alias("grp"), (F.col("vec_id") % 3).cast("int").alias("c"), "vec_id", "y", "x", "v", "u")


def _scores(s, d):
    """Three neighbouring rasters as the scores of three classes."""
    return _img(s, d).select(*G, "y", "x", F.col("c").alias("k"), F.col("v").alias("p"))


@query("prj_01", f"{WITH} {IMG}, o AS (SELECT grp, y, x, list_sort(list(u)) AS l FROM img GROUP BY ALL), b AS (SELECT grp, y, x, list_reduce(list_prepend(1.0::DOUBLE, list_transform(l, lambda u: u::DOUBLE)), lambda a, u: a * (1 - u / 255.0::DOUBLE)) AS r FROM o) SELECT grp, y, x, least(255, greatest(0, floor((1 - r) * 255 + 1e-9::DOUBLE)))::INTEGER AS v FROM b")
def prj_01(s, d):
    """Screen blend of the images of a group."""
    return raster.screen_blend(_img(s, d).select(*G, "y", "x", F.col("u").alias("v")), G)


@query("prj_02", f"{WITH} {IMG} SELECT grp, y, x, c::INTEGER AS c, u AS v FROM img")
def prj_02(s, d):
    """Single-channel images stacked in the order of their names."""
    one = _img(s, d).select(*G, F.col("vec_id").alias("name"), "y", "x", F.lit(0).alias("c"), F.col("u").alias("v"))
    return raster.stack_channels(one, G, "name", 1)


@query("prj_03", f"{WITH} {IMG}, st AS (SELECT grp // 2 AS g, (grp % 2) * 3 + c AS c, y, x, u FROM img) SELECT g AS grp, y, x, (c // 3)::INTEGER AS image, (c % 3)::INTEGER AS c, u AS v FROM st")
def prj_03(s, d):
    """A stack of six channels as two images of three."""
    st = _img(s, d).select(F.expr("grp div 2").alias("grp"), "y", "x", ((F.col("grp") % 2) * 3 + F.col("c")).cast("int").alias("c"), F.col("u").alias("v"))
    return raster.split_channels(st)


@query("prj_04", "WITH v AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'hw' WHEN p_size % 3 = 1 THEN 'chw' ELSE 'hwc' END AS layout FROM v")
def prj_04(s, d):
    p = B.table(s, d, "part").select("p_partkey", "p_size")
    side = F.col("p_size") + 65
    shape = F.when(F.col("p_size") % 3 == 0, F.array(side, side)).when(F.col("p_size") % 3 == 1, F.array(F.lit(3), side, side)).otherwise(F.array(side, side, F.lit(3)))
    return p.select("p_partkey", raster.layout(shape).alias("layout"))


@query("prj_05", f"{WITH} a AS (SELECT unnest(range(10)) AS o), vs AS (SELECT DISTINCT vec_id FROM embeddings) SELECT vs.vec_id, p.o::INTEGER AS y, q.o::INTEGER AS x, coalesce(u, 0) AS v FROM vs CROSS JOIN a p CROSS JOIN a q LEFT JOIN rast r ON r.vec_id = vs.vec_id AND r.y = p.o AND r.x = q.o")
def prj_05(s, d):
    """Images of 8 x 8 in patches of 10 x 10, zeros right and below."""
    r = B.raster(s, d).select(*V, "y", "x", F.col("u").alias("v"))
    return raster.pad(r, r.select(*V), V, 10)


@query("prj_06", f"{WITH} h AS (SELECT vec_id, y, x, u % 3 AS cls FROM rast) SELECT vec_id, y, x, (cls = 0)::INTEGER AS k0, (cls = 1)::INTEGER AS k1, (cls = 2)::INTEGER AS k2 FROM h")
def prj_06(s, d):
    h = B.raster(s, d).select(*V, "y", "x", raster.one_hot(F.col("u") % 3).alias("h"))
    return h.select(*V, "y", "x", *[F.get("h", F.lit(i)).alias(f"k{i}") for i in range(3)])


W8 = f"greatest((0.5::DOUBLE - 0.5 * cos({2 * math.pi!r}::DOUBLE * y / 7.0)) * (0.5::DOUBLE - 0.5 * cos({2 * math.pi!r}::DOUBLE * x / 7.0)), 1e-4::DOUBLE)"


@query("prj_07", f"{WITH} p AS (SELECT DISTINCT y, x FROM rast) SELECT y, x, round({W8}, 9) AS w FROM p")
def prj_07(s, d):
    p = B.raster(s, d).select("y", "x").distinct()
    return p.select("y", "x", F.round(raster.window_weight(F.col("y"), F.col("x"), 8), 9).alias("w"))


@query("prj_08", f"{WITH} {IMG} SELECT grp, y, x, arg_max(c, (v, -c))::INTEGER AS cls FROM img GROUP BY ALL")
def prj_08(s, d):
    return raster.argmax_class(_scores(s, d), G)


ENDS = f"{IMG}, en AS (SELECT grp, c, min(u) AS lo, max(u) AS hi FROM img GROUP BY ALL)"


@query("agg_12", f"{WITH} {ENDS} SELECT grp, c::INTEGER AS c, lo, hi FROM en")
def agg_12(s, d):
    return _img(s, d).groupBy(*G, "c").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))


@query("prj_09", f"{WITH} {ENDS} SELECT grp, y, x, c::INTEGER AS c, CASE WHEN hi > lo THEN floor((u - lo)::DOUBLE / (hi - lo)::DOUBLE * 255)::INTEGER ELSE 0 END AS v FROM img JOIN en USING (grp, c)")
def prj_09(s, d):
    return raster.normalise_channels(_img(s, d).select(*G, "y", "x", "c", F.col("u").alias("v")), G)


@query("prj_10", f"{WITH} {IMG} SELECT grp, y, x, c::INTEGER AS c, round(CASE WHEN u % 3 > 0 THEN u / 255.0::DOUBLE * 0.6::DOUBLE + CASE WHEN c = 0 THEN 0.4::DOUBLE ELSE 0 END ELSE u / 255.0::DOUBLE END, 9) AS v FROM img")
def prj_10(s, d):
    """Masked pixels tinted red."""
    t = raster.tint(_img(s, d).select(*G, "y", "x", "c", (F.col("u") / F.lit(255.0)).alias("v"), (F.col("u") % 3).alias("cls")))
    return t.select(*G, "y", "x", "c", F.round("v", 9).alias("v"))


@query("prj_11", f"{WITH} t AS (SELECT unnest(range(4)) AS o) SELECT vec_id, a.o::INTEGER AS y, b.o::INTEGER AS x, u AS v FROM t a, t b, rast r WHERE r.y = floor((a.o + 0.5::DOUBLE) * 2) AND r.x = floor((b.o + 0.5::DOUBLE) * 2)")
def prj_11(s, d):
    """Masks shrunk to half, by the nearest pixel."""
    return raster.shrink_nearest(B.raster(s, d).select(*V, "y", "x", F.col("u").alias("v")), 8, 8, 4)


@query("prj_29", "SELECT DISTINCT p_size, 'val' || round_even(p_size / 2.0::DOUBLE, 0)::INTEGER::VARCHAR AS tag FROM part")
def prj_29(s, d):
    """Tags of validation shares in percent, rounded half to even."""
    v = B.table(s, d, "part").select("p_size").distinct()
    return v.select("p_size", F.concat(F.lit("val"), F.bround(100 * (F.col("p_size") / F.lit(200.0)), 0).cast("int")).alias("tag"))


@query("prj_31", f"{WITH} {IMG}, w AS (SELECT grp, y, x, max(v) FILTER (c = 0) AS a, max(v) FILTER (c = 1) AS b, max(v) FILTER (c = 2) AS z, max(u) FILTER (c = 0) % 3 AS cls FROM img GROUP BY ALL HAVING count(*) = 3) SELECT grp, round(avg(-(CASE cls WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 1.0 ELSE 5.0 END) * ln(exp(CASE cls WHEN 0 THEN a WHEN 1 THEN b ELSE z END) / (exp(a) + exp(b) + exp(z)))), 6) AS loss FROM w GROUP BY ALL")
def prj_31(s, d):
    """Weighted cross-entropy, averaged over an image."""
    p = _img(s, d).groupBy(*G, "y", "x").agg(F.array_sort(F.collect_list(F.struct("c", "v", "u"))).alias("l")).where(F.size("l") == 3)
    one = raster.cross_entropy(F.transform("l", lambda e: e["v"]), F.get("l", F.lit(0))["u"] % 3)
    return p.select(*G, one.alias("loss")).groupBy(*G).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("prj_32")
def prj_32(s, d):
    """Images flipped and turned by draws from their id, brightness and contrast changed; random by nature, so no SQL."""
    draw = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    r = B.raster(s, d).select(*V, "y", "x", (F.col("u") / 255.0).alias("v"), draw(1, 2).alias("lr"), draw(2, 2).alias("ud"), draw(3, 4).alias("turn"), (draw(4, 1000) / 1000.0).alias("b"), (draw(5, 1000) / 1000.0).alias("k"))
    r = r.withColumn("x", F.when(F.col("lr") == 1, 7 - F.col("x")).otherwise(F.col("x"))).withColumn("y", F.when(F.col("ud") == 1, 7 - F.col("y")).otherwise(F.col("y")))
    turned = F.when(F.col("turn") == 0, F.struct("y", "x")).when(F.col("turn") == 1, F.struct((7 - F.col("x")).alias("y"), F.col("y").alias("x"))).when(F.col("turn") == 2, F.struct((7 - F.col("y")).alias("y"), (7 - F.col("x")).alias("x"))).otherwise(F.struct(F.col("x").alias("y"), (7 - F.col("y")).alias("x")))
    r = r.withColumn("at", turned).select(*V, F.col("at.y").alias("y"), F.col("at.x").alias("x"), "v", "b", "k")
    mean = r.groupBy(*V).agg(F.avg("v").alias("mean"))
    bright = F.col("v") + 0.4 * F.col("b") - 0.2
    middle = F.col("mean") + 0.4 * F.col("b") - 0.2
    return r.join(mean, V).select(*V, "y", "x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (bright - middle) * (0.8 + 0.4 * F.col("k")) + middle)).alias("v"))


BL = f"{IMG}, pt AS (SELECT grp // 2 AS g, (grp % 2) * 4 AS oy, c AS k, y, x, v AS p, {W8} AS w FROM img)"


@query("agg_20", f"{WITH} {BL} SELECT g AS grp, (y + oy)::INTEGER AS y, x, k::INTEGER AS k, round(sum(p * w) / sum(w), 9) AS p FROM pt GROUP BY ALL")
def agg_20(s, d):
    """Scores of two overlapping patches blended by their windows."""
    i = _img(s, d).select(F.expr("grp div 2").alias("grp"), ((F.col("grp") % 2) * 4).alias("oy"), F.col("c").alias("k"), "y", "x", F.col("v").alias("p"), raster.window_weight(F.col("y"), F.col("x"), 8).alias("w"))
    b = raster.blend_predictions(i.withColumn("y", (F.col("y") + F.col("oy")).cast("int")).drop("oy"), G)
    return b.withColumn("p", F.round("p", 9))


@query("geo_17", f"{WITH} x AS (SELECT 1) SELECT vec_id, (y - 2)::INTEGER AS y, (x - 1)::INTEGER AS x, u AS v FROM rast WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 8")
def geo_17(s, d):
    """A window of each image."""
    return raster.crop(B.raster(s, d).select(*V, "y", "x", F.col("u").alias("v")), 2, 6, 1, 8)


METRIC = "mt AS (SELECT l_returnflag AS model, l_linestatus || (l_suppkey % 7)::VARCHAR AS sample_id, 'discount' AS metric, CASE WHEN l_linenumber % 7 = 0 THEN -1.0::DOUBLE ELSE l_discount END AS value FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus || (l_suppkey % 7)::VARCHAR, 'tax', CASE WHEN l_linenumber % 7 = 0 THEN -1.0::DOUBLE ELSE l_tax END FROM lineitem)"


def _metrics(s, d):
    """Metric values by model and sample, with sentinels where nothing is defined."""
    li = B.table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    value = lambda c: F.when(F.col("l_linenumber") % 7 == 0, -1.0).otherwise(F.col(c))
    both = F.array(F.struct(F.lit("discount").alias("metric"), value("l_discount").alias("value")), F.struct(F.lit("tax").alias("metric"), value("l_tax").alias("value")))
    return li.select(F.col("l_returnflag").alias("model"), F.concat("l_linestatus", (F.col("l_suppkey") % 7).cast("string")).alias("sample_id"), F.explode(both).alias("e")).select("model", "sample_id", "e.metric", "e.value")


@query("agg_08", f"WITH {METRIC} SELECT model, metric, count(*) FILTER (value >= 0) AS n, round(avg(value) FILTER (value >= 0), 6) AS mean FROM mt GROUP BY ALL")
@query("flt_13", f"WITH {METRIC} SELECT model, metric, count(*) FILTER (value >= 0) AS n, round(avg(value) FILTER (value >= 0), 6) AS mean FROM mt GROUP BY ALL")
def agg_08(s, d):
    """Means of the values that are defined."""
    return metrics.sentinel_means(_metrics(s, d), ["model", "metric"]).withColumn("mean", F.round("mean", 6))


@query("agg_09", f"WITH {METRIC} SELECT model, metric, round(avg(value), 6) AS mean FROM mt GROUP BY ALL HAVING count(DISTINCT sample_id) > 1")
def agg_09(s, d):
    return metrics.nan_means(_metrics(s, d), ["model", "metric"], "sample_id").withColumn("mean", F.round("mean", 6))


SAMPLED = f"{METRIC}, sm AS (SELECT model, metric, sample_id, avg(value) FILTER (value >= 0) AS value FROM mt GROUP BY ALL)"
TT = ", ".join(f"({i + 2}, {t}::DOUBLE)" for i, t in enumerate(metrics.T_975))


@query("agg_10", f"WITH {SAMPLED}, tt(n, t) AS (VALUES {TT}), a AS (SELECT model, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM sm GROUP BY ALL) SELECT model, metric, a.n, round(mean, 6) AS mean, round(CASE WHEN a.n < 2 THEN 0 ELSE sd / sqrt(a.n) * coalesce(t, 1.96::DOUBLE) END, 6) AS ci FROM a LEFT JOIN tt ON tt.n = a.n")
@query("agg_11", f"WITH {SAMPLED}, tt(n, t) AS (VALUES {TT}), a AS (SELECT model, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM sm GROUP BY ALL) SELECT model, metric, a.n, round(mean, 6) AS mean, round(CASE WHEN a.n < 2 THEN 0 ELSE sd / sqrt(a.n) * coalesce(t, 1.96::DOUBLE) END, 6) AS ci FROM a LEFT JOIN tt ON tt.n = a.n")
def agg_10(s, d):
    """Mean over samples with its 95 % interval, by model and metric."""
    sm = metrics.sentinel_means(_metrics(s, d), ["model", "metric", "sample_id"]).select("model", "metric", F.col("mean").alias("value"))
    m = metrics.mean_with_interval(sm, ["model", "metric"])
    return m.select("model", "metric", "n", F.round("mean", 6).alias("mean"), F.round("ci", 6).alias("ci"))


@query("agg_24", "SELECT user_id, min(value) AS objective FROM events GROUP BY ALL")
def agg_24(s, d):
    """A trial's objective: its least value."""
    return B.table(s, d, "events").groupBy("user_id").agg(F.min("value").alias("objective"))


