"""Label maps as runs (keys, y, x0, x1, label; x1 is beyond the end): encoding, overlap, shape and morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import components


def paint(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x, label) of boxes x0, y0, x1, y1; where boxes overlap the largest label shows."""
    rows = boxes.where("x1 > x0 and y1 > y0").withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    return rows.groupBy(*keys, "y", "x").agg(F.max("label").alias("label"))


def to_runs(pixels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Neighbouring pixels of a row with one label become a run."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    new = F.coalesce(((F.col("x") - F.lag("x").over(row)) != 1) | (F.col(label) != F.lag(label).over(row)), F.lit(True))
    island = F.sum(new.cast("int")).over(row)
    return pixels.withColumn("_i", island).groupBy(*keys, "y", "_i", label).agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_i")


def to_pixels(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1")


def contingency(true: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, p, n): shared pixels of each pair of labels, from the runs of the same row that meet."""
    t = true.select(*keys, "y", F.col("x0").alias("t0"), F.col("x1").alias("t1"), F.col("label").alias("t"))
    p = pred.select(*keys, "y", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("label").alias("p"))
    both = t.join(p, [*keys, "y"]).where("t0 < p1 and p0 < t1")
    return both.groupBy(*keys, "t", "p").agg(F.sum(F.least("t1", "p1") - F.greatest("t0", "p0")).cast("long").alias("n"))


def shapes(runs: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Area and tight box (x1, y1 inclusive) of each label."""
    return runs.groupBy(*keys, label).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"), F.min("x0").alias("bx0"), F.min("y").alias("by0"), (F.max("x1") - 1).alias("bx1"), F.max("y").alias("by1"))


def union_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the union by keys: runs of a row that meet or touch become one."""
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.coalesce(F.col("x0") > reach, F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(row))
    return marked.groupBy(*keys, "y", "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def relabel(shapes_: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Add new_label: 1..K by ascending label."""
    return shapes_.withColumn("new_label", F.dense_rank().over(Window.partitionBy(*keys).orderBy(label)))


def boundaries(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Classes of labelled pixels: 2 if one of the four neighbours on the canvas has another label, else 1."""
    along = Window.partitionBy(*keys, "y").orderBy("x")
    down = Window.partitionBy(*keys, "x").orderBy("y")

    def same(order: Window, axis: str, by: int, end: int) -> Column:
        near = F.lag("label", by).over(order) if by > 0 else F.lead("label", -by).over(order)
        at = F.lag(axis, by).over(order) if by > 0 else F.lead(axis, -by).over(order)
        return (F.col(axis) == end) | F.coalesce((at == F.col(axis) - by) & (near == F.col("label")), F.lit(False))

    inner = same(along, "x", 1, 0) & same(along, "x", -1, width - 1) & same(down, "y", 1, 0) & same(down, "y", -1, height - 1)
    return pixels.withColumn("cls", F.when(inner, 1).otherwise(2))


def connected_components(runs: DataFrame, keys: list[str], diagonal: bool = False) -> DataFrame:
    """Runs with comp: components by the four (or eight) neighbours, numbered 1.. in scan order of their first pixel."""
    node = F.col("y").cast("long") * (1 << 31) + F.col("x0")
    named = runs.withColumn("id", node)
    reach = 1 if diagonal else 0
    a = named.select(*keys, F.col("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("id").alias("a"))
    b = named.select(*keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("b"))
    edges = a.join(b, [*keys, "y"]).where((F.col("a0") < F.col("b1") + reach) & (F.col("b0") < F.col("a1") + reach)).select(*keys, "a", "b")
    found = components(edges, keys)
    out = named.join(found, [*keys, "id"], "left").withColumn("root", F.coalesce("root", "id")).drop("id")
    return out.withColumn("comp", F.dense_rank().over(Window.partitionBy(*keys).orderBy("root"))).drop("root")


def dilate(pixels: DataFrame, keys: list[str], height: int, width: int, times: int = 1) -> DataFrame:
    """Pixels of the mask grown by its eight neighbours, on the canvas."""
    out = pixels.select(*keys, "y", "x")
    steps = F.array(*[F.lit(i) for i in range(-times, times + 1)])
    out = out.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return out.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width)).distinct()


def edge_count(pixels: DataFrame, keys: list[str], label: str = "comp") -> DataFrame:
    """(keys, label, pixel_area, n_edges): unit edges that belong to one pixel of the label only, its outline."""
    x, y = F.col("x"), F.col("y")
    sides = F.array(*[F.struct(F.lit(k).alias("way"), v.alias("ey"), u.alias("ex")) for k, v, u in (("h", y, x), ("h", y + 1, x), ("v", y, x), ("v", y, x + 1))])
    edges = pixels.select(*keys, label, F.explode(sides).alias("e")).groupBy(*keys, label, "e").agg(F.count("*").alias("n"))
    outline = edges.groupBy(*keys, label).agg(F.sum((F.col("n") == 1).cast("long")).alias("n_edges"))
    return pixels.groupBy(*keys, label).agg(F.count("*").alias("pixel_area")).join(outline, [*keys, label])


def rle(flags: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """(keys, counts): lengths of runs of a flag in order; the first counts the unset ones, so it can be 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    marked = flags.withColumn("_c", change).withColumn("_i", F.sum("_c").over(w))
    islands = marked.groupBy(*keys, "_i").agg(F.count("*").alias("_n"), F.first(flag).alias("_f"))
    lists = islands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_n", "_f"))).alias("_r"))
    counts = F.transform("_r", lambda r: r["_n"])
    return lists.select(*keys, F.when(F.get("_r", F.lit(0))["_f"], F.concat(F.array(F.lit(0).cast("long")), counts)).otherwise(counts).alias("counts"))


def encoded(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts) as ``rle`` gives them, from set runs (keys, start, length), without the unset ones after the last."""
    ordered = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("r"))
    end = lambda e: e["start"] + e["length"]
    counts = F.flatten(F.transform("r", lambda e, i: F.array(F.when(i == 0, e["start"]).otherwise(e["start"] - end(F.get("r", i - 1))), e["length"])))
    return ordered.select(*keys, counts.alias("counts"))


def span_shapes(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Area and tight box (x1, y1 inclusive) by keys of runs (start, length) over rows of this width; a run may go on in the next row."""
    y0, y1 = (F.floor(c / width).cast("int") for c in (F.col("start"), F.col("start") + F.col("length") - 1))
    x0 = F.when(y0 == y1, F.col("start") % width).otherwise(0).cast("int")
    x1 = F.when(y0 == y1, (F.col("start") + F.col("length") - 1) % width).otherwise(width - 1).cast("int")
    return spans.groupBy(*keys).agg(F.sum("length").alias("area"), F.min(x0).alias("bx0"), F.min(y0).alias("by0"), F.max(x1).alias("bx1"), F.max(y1).alias("by1"))


def unrle(encoded: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """(keys, start, length) of the set runs; a doubled leading zero is repaired."""
    c = F.col(counts)
    fixed = F.when((F.size(c) > 1) & (F.get(c, F.lit(0)) == 0) & (F.get(c, F.lit(1)) == 0), F.slice(c, F.lit(2), F.size(c))).otherwise(c)
    rows = encoded.withColumn("_c", fixed).select(*keys, "_c", F.posexplode("_c").alias("_p", "length"))
    start = F.aggregate(F.slice("_c", F.lit(1), F.col("_p")), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.where("_p % 2 = 1 and length > 0").select(*keys, start.alias("start"), "length")
