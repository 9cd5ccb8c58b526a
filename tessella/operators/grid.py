"""Tiles, patches, coverage and splits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.arrays import window_starts

#: A tile with less than this covered is for training only.
ELIGIBLE = 0.10


def tiles(canvases: DataFrame, tile: int, height: str = "h", width: str = "w") -> DataFrame:
    """Non-overlapping tiles in row-major order, cut at the edges: the canvas' columns and y0, y1, x0, x1."""
    df = canvases.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col(height) - 1, F.lit(tile)))).withColumn("x0", F.explode(F.sequence(F.lit(0), F.col(width) - 1, F.lit(tile))))
    return df.withColumn("y1", F.least(F.col("y0") + tile, F.col(height))).withColumn("x1", F.least(F.col("x0") + tile, F.col(width)))


def patches(regions: DataFrame, patch: int, stride: int) -> DataFrame:
    """Windows inside each region (y0, y1, x0, x1), which they never leave: py0, py1, px0, px1."""
    df = regions.withColumn("py0", F.explode(window_starts(F.col("y1") - F.col("y0"), patch, stride))).withColumn("px0", F.explode(window_starts(F.col("x1") - F.col("x0"), patch, stride)))
    df = df.withColumn("py0", F.col("py0") + F.col("y0")).withColumn("px0", F.col("px0") + F.col("x0"))
    return df.withColumn("py1", F.least(F.col("py0") + patch, "y1")).withColumn("px1", F.least(F.col("px0") + patch, "x1"))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations, in the order of the parameters given; a small table."""
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(x) for x in v])).alias(name))
    return out


def pixel_coverage(regions: DataFrame, pixels: DataFrame, tile: int, keys: list[str]) -> DataFrame:
    """Covered share of each tile; tiles without pixels stay, with 0. pixels: keys, y, x."""
    n = pixels.groupBy(*keys, (F.col("y") - F.col("y") % tile).alias("y0"), (F.col("x") - F.col("x") % tile).alias("x0")).agg(F.count("*").alias("n"))
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return regions.join(n, [*keys, "y0", "x0"], "left").withColumn("coverage", F.coalesce("n", F.lit(0)).cast("double") / area).drop("n")


def box_coverage(regions: DataFrame, boxes: DataFrame, tile: int, keys: list[str]) -> DataFrame:
    """Summed box area in a tile over its area, at most 1; overlaps count twice. boxes: keys, bx0, by0, bx1, by1."""
    cells = boxes.withColumn("ty", F.explode(F.sequence(F.floor(F.col("by0") / tile), F.floor((F.col("by1") - 1) / tile)))).withColumn("tx", F.explode(F.sequence(F.floor(F.col("bx0") / tile), F.floor((F.col("bx1") - 1) / tile))))
    cells = cells.select(*keys, (F.col("ty") * tile).cast("int").alias("y0"), (F.col("tx") * tile).cast("int").alias("x0"), "bx0", "by0", "bx1", "by1")
    w = F.least("bx1", F.col("x0") + tile) - F.greatest("bx0", "x0")
    h = F.least("by1", F.col("y0") + tile) - F.greatest("by0", "y0")
    n = cells.groupBy(*keys, "y0", "x0").agg(F.sum(w * h).alias("n"))
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return regions.join(n, [*keys, "y0", "x0"], "left").withColumn("coverage", F.least(F.coalesce("n", F.lit(0)).cast("double") / area, F.lit(1.0))).drop("n")


def quantile_edges(values: DataFrame, value: str, bins: int, keys: list[str]) -> DataFrame:
    """keys, edges: bins + 1 quantiles with linear interpolation; one bin if all values are alike."""
    edges = F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))
    return values.groupBy(*keys).agg(edges.alias("edges")).withColumn("edges", F.when(F.abs(F.element_at("edges", -1) - F.element_at("edges", 1)) <= 1e-8, F.array(F.element_at("edges", 1), F.element_at("edges", -1))).otherwise(F.col("edges")))


def bin_of(value: Column, edges: Column) -> Column:
    """The number of inner edges that lie below the value."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: value > e))


def hash_order(*columns: str, prime: int = 7919, modulus: int = 10007) -> Column:
    """A fixed shuffle: an integer order that looks random."""
    return sum((F.col(c).cast("long") * (prime + 2 * i) for i, c in enumerate(columns)), F.lit(0)) % modulus


def stratified_split(regions: DataFrame, keys: list[str], region: str, fraction: float, bins: int) -> DataFrame:
    """Add bin and split ('train' or 'val') by group of keys.

    Eligible regions are dealt to validation in rounds over the bins, in a fixed shuffled order, until the
    rounded-up share is reached (at least one, and not all); regions below the least coverage only train.
    """
    eligible = regions.where(F.col("coverage") >= ELIGIBLE)
    edges = quantile_edges(eligible, "coverage", bins, keys)
    binned = eligible.join(edges, keys).withColumn("bin", bin_of(F.col("coverage"), F.col("edges"))).drop("edges")
    order = [hash_order(region), F.col(region)]
    turn = F.row_number().over(Window.partitionBy(*keys, "bin").orderBy(*order))
    ranked = binned.withColumn("turn", turn)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "bin", region))
    n = F.count("*").over(Window.partitionBy(*keys))
    wanted = F.least(F.greatest(F.ceil(n * F.lit(fraction)), F.lit(1)), n - 1)
    split = ranked.withColumn("split", F.when(place <= wanted, "val").otherwise("train")).drop("turn")
    rest = regions.where(F.col("coverage") < ELIGIBLE).withColumn("bin", F.lit(-1)).withColumn("split", F.lit("train"))
    return split.unionByName(rest)


def folds(regions: DataFrame, keys: list[str], region: str, k: int) -> DataFrame:
    """Add fold 0..k-1: regions in a fixed shuffled order are dealt in turn."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(region), region))
    return regions.withColumn("fold", (place - 1) % k)


def seeded_split(coverages, fraction: float, seed: int, bins: int) -> tuple[list[int], list[int]]:
    """(training, validation) regions of one bounded list of coverages, in NumPy's shuffled order of the seed.

    For the same draws as in earlier splits; ``stratified_split`` is the form for tables. Bins are used if each has
    two regions and both sides can hold one of each; then regions go to validation by their turn in their bin, each
    bin keeps one, and what is still wanted comes in shuffled order.
    """
    cover = np.asarray(coverages)
    if not 0 < fraction < 1 or cover.ndim != 1 or not np.isfinite(cover).all():
        raise ValueError("the fraction lies between 0 and 1, and coverages are a list of finite numbers")
    eligible = np.flatnonzero(cover >= ELIGIBLE)
    n = len(eligible)
    if n < 2:
        raise ValueError("at least two regions must be covered enough")
    wanted = min(max(math.ceil(n * fraction), 1), n - 1)
    shuffled = eligible.copy()
    np.random.default_rng(seed).shuffle(shuffled)
    used = min(bins, max(1, n // max(2, math.ceil(1 / fraction))))
    edges = np.quantile(cover[eligible], np.linspace(0, 1, used + 1))
    alike = used <= 1 or np.allclose(edges, edges[0])
    of = dict(zip(eligible.tolist(), [0] * n if alike else np.digitize(cover[eligible], edges[1:-1], right=True).tolist(), strict=True))
    sizes = np.bincount(list(of.values()))
    order = shuffled.tolist()
    if sizes.min() >= 2 and np.count_nonzero(sizes) <= min(wanted, n - wanted):
        seen: dict[int, int] = {}
        first: dict[int, int] = {}
        turns = []
        for i in order:
            b = of[i]
            turn = seen[b] = seen.get(b, -1) + 1
            if turn == 0 or turn < sizes[b] - 1:
                turns.append((turn, first.setdefault(b, len(first)), i))
        chosen = [i for _, _, i in sorted(turns)]
        order = [*chosen, *sorted(set(order) - set(chosen), key=order.index)]
    val = sorted(order[:wanted])
    return sorted(set(range(len(cover))) - set(val)), val
