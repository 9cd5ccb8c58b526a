"""Deterministic rasters, masks, boxes and series from the common tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import runs

SIDE, TILE, PATCH, STRIDE = 64, 16, 10, 4
KEYS = ["sample_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, h, w) of all canvases."""
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 50").alias("sample_id")).distinct()
    return p.select("sample_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"))


def boxes(spark: SparkSession, sf_dir: str, pred: bool = False) -> DataFrame:
    """(sample_id, label, x0, y0, x1, y1, score): boxes before painting, cut at the canvas."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    x0, y0 = (k % 8) * 8 + F.col("p_size") % 3, F.expr("(p_partkey % 50) div 8") * 8 + F.col("p_size") % 2
    if pred:
        p = p.where(k % 11 != 0)
        x0, y0 = x0 + k % 3, y0 + F.expr("p_partkey div 3") % 2
    at = lambda c: F.least(c, F.lit(SIDE)).cast("int")
    return p.select(F.expr("p_partkey div 50").alias("sample_id"), (k + 1).alias("label"), at(x0).alias("x0"), at(y0).alias("y0"), at(x0 + 4 + F.col("p_size") % 7).alias("x1"), at(y0 + 4 + F.col("p_size") % 5).alias("y1"), (((k * 37) % 101) / F.lit(100.0)).alias("score"))


def pixels(spark: SparkSession, sf_dir: str, pred: bool = False) -> DataFrame:
    """(sample_id, y, x, label) of the painted label map."""
    return runs.paint(boxes(spark, sf_dir, pred), KEYS)


def label_runs(spark: SparkSession, sf_dir: str, pred: bool = False) -> DataFrame:
    return runs.to_runs(pixels(spark, sf_dir, pred), KEYS)


def box_runs(spark: SparkSession, sf_dir: str, pred: bool = False) -> DataFrame:
    """Runs of the boxes before painting, which overlap."""
    b = boxes(spark, sf_dir, pred).where("x1 > x0 and y1 > y0")
    return b.select("sample_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1", "label")


def semantic(spark: SparkSession, sf_dir: str, pred: bool = False) -> DataFrame:
    """(sample_id, y, x, label, cls): 1 inside, 2 on a boundary."""
    return runs.boundaries(pixels(spark, sf_dir, pred), KEYS, SIDE, SIDE)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, v, u): 8 x 8 rasters, as doubles and as 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    v = F.col("f").cast("double")
    return e.select("vec_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"), F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.6) * 200).cast("int"))).alias("u"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, fitness, click): a user's events in order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).cast("long").alias("i"), F.col("value").alias("fitness"), (F.col("event_type") == "click").alias("click"))


#: The same in SQL: the start of a WITH list.
SQL = f"""
samples AS (SELECT DISTINCT p_partkey // 50 AS sample_id FROM part),
tb AS (SELECT p_partkey // 50 AS sample_id, p_partkey + 1 AS label,
  least((p_partkey % 8) * 8 + p_size % 3, {SIDE}) AS x0, least(((p_partkey % 50) // 8) * 8 + p_size % 2, {SIDE}) AS y0,
  least((p_partkey % 8) * 8 + p_size % 3 + 4 + p_size % 7, {SIDE}) AS x1, least(((p_partkey % 50) // 8) * 8 + p_size % 2 + 4 + p_size % 5, {SIDE}) AS y1,
  ((p_partkey * 37) % 101) / 100.0::DOUBLE AS score FROM part),
pb AS (SELECT p_partkey // 50 AS sample_id, p_partkey + 1 AS label,
  least((p_partkey % 8) * 8 + p_size % 3 + p_partkey % 3, {SIDE}) AS x0, least(((p_partkey % 50) // 8) * 8 + p_size % 2 + (p_partkey // 3) % 2, {SIDE}) AS y0,
  least((p_partkey % 8) * 8 + p_size % 3 + p_partkey % 3 + 4 + p_size % 7, {SIDE}) AS x1, least(((p_partkey % 50) // 8) * 8 + p_size % 2 + (p_partkey // 3) % 2 + 4 + p_size % 5, {SIDE}) AS y1,
  ((p_partkey * 37) % 101) / 100.0::DOUBLE AS score FROM part WHERE p_partkey % 11 <> 0),
axis AS (SELECT unnest(range({SIDE})) AS v),
tboxpx AS (SELECT sample_id, label, ay.v AS y, ax.v AS x FROM tb JOIN axis ay ON ay.v >= y0 AND ay.v < y1 JOIN axis ax ON ax.v >= x0 AND ax.v < x1),
pboxpx AS (SELECT sample_id, label, ay.v AS y, ax.v AS x FROM pb JOIN axis ay ON ay.v >= y0 AND ay.v < y1 JOIN axis ax ON ax.v >= x0 AND ax.v < x1),
tpx AS (SELECT sample_id, y, x, max(label) AS label FROM tboxpx GROUP BY ALL),
ppx AS (SELECT sample_id, y, x, max(label) AS label FROM pboxpx GROUP BY ALL)"""

#: Classes of the painted true label map.
SEM = f"""
near AS (SELECT *, lag(x) OVER h AS lx, lag(label) OVER h AS ll, lead(x) OVER h AS rx, lead(label) OVER h AS rl, lag(y) OVER v AS uy, lag(label) OVER v AS ul, lead(y) OVER v AS ny, lead(label) OVER v AS nl
  FROM tpx WINDOW h AS (PARTITION BY sample_id, y ORDER BY x), v AS (PARTITION BY sample_id, x ORDER BY y)),
sem AS (SELECT sample_id, y, x, label, CASE WHEN (x = 0 OR (lx = x - 1 AND ll = label)) AND (x = {SIDE - 1} OR (rx = x + 1 AND rl = label))
  AND (y = 0 OR (uy = y - 1 AND ul = label)) AND (y = {SIDE - 1} OR (ny = y + 1 AND nl = label)) THEN 1 ELSE 2 END AS cls FROM near)"""

#: Overlaps, areas and IoUs of the painted maps.
PAIRS = """
ct AS (SELECT t.sample_id, t.label AS t, p.label AS p, count(*) AS n FROM tpx t JOIN ppx p USING (sample_id, y, x) GROUP BY ALL),
ta AS (SELECT sample_id, label AS t, count(*) AS ta FROM tpx GROUP BY ALL),
pa AS (SELECT sample_id, label AS p, count(*) AS pa FROM ppx GROUP BY ALL),
iou AS (SELECT sample_id, t, p, n, n::DOUBLE / (ta + pa - n)::DOUBLE AS iou FROM ct JOIN ta USING (sample_id, t) JOIN pa USING (sample_id, p))"""

#: The sweep's thresholds.
TAUS = "taus AS (SELECT i::INTEGER AS i, 0.5::DOUBLE + i * (0.55::DOUBLE - 0.5::DOUBLE) AS tau FROM range(10) r(i))"

RASTER = """
rast AS (SELECT vec_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, embedding[i]::DOUBLE AS v, least(255, greatest(0, floor((embedding[i]::DOUBLE + 0.6::DOUBLE) * 200)::INTEGER)) AS u
  FROM embeddings, range(1, 65) r(i))"""

SERIES = """
ser AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS fitness, event_type = 'click' AS click FROM events)"""
