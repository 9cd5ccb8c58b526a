"""Raster algebra on long tables (keys, y, x, c, v)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.arrays import window_starts


def screen_blend(pixels: DataFrame, keys: list[str], top: int = 255, value: str = "v") -> DataFrame:
    """One image from several: top * (1 - product(1 - v / top)), clipped and truncated.

    The product is taken over the values in ascending order, so that its rounding doesn't depend on the input's order.
    """
    rest = F.aggregate(F.array_sort(F.collect_list(value)), F.lit(1.0), lambda a, v: a * (1 - v / F.lit(float(top))))
    return pixels.groupBy(*keys, "y", "x").agg(rest.alias("_r")).select(*keys, "y", "x", F.least(F.lit(top), F.greatest(F.lit(0), F.floor((1 - F.col("_r")) * top + F.lit(1e-9)))).cast("int").alias("v"))


def stack_channels(images: DataFrame, keys: list[str], name: str, channels: int = 3) -> DataFrame:
    """Channels of images one after another in the order of their names: keys, y, x, c, v."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(name)) - 1
    return images.select(*keys, "y", "x", (place * channels + F.col("c")).cast("int").alias("c"), "v")


def split_channels(stacked: DataFrame, channels: int = 3) -> DataFrame:
    """Images of ``channels`` channels each: adds image, c is the channel in it."""
    return stacked.withColumn("image", F.floor(F.col("c") / channels).cast("int")).withColumn("c", F.col("c") % channels)


def pad(pixels: DataFrame, canvases: DataFrame, keys: list[str], size: int, value: str = "v") -> DataFrame:
    """Pixels of a size x size patch; those beyond the image are 0."""
    grid = canvases.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.join(pixels, [*keys, "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def one_hot(cls: Column, depth: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: (k == cls).cast("int"))


def hann(i: Column, n: int) -> Column:
    return F.lit(1.0) if n == 1 else 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * i / F.lit(float(n - 1)))


def window_weight(y: Column, x: Column, size: int) -> Column:
    """Weight of a patch's pixel in blended predictions."""
    return F.greatest(hann(y, size) * hann(x, size), F.lit(1e-4))


def blend_predictions(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of overlapping patches' scores: keys, y, x, k, p."""
    return weighted.groupBy(*keys, "y", "x", "k").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))


def argmax_class(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The class with the highest score by pixel; of equal ones the first."""
    return scores.groupBy(*keys, "y", "x").agg(F.max_by("k", F.struct(F.col("p"), -F.col("k"))).alias("cls"))


def predict_tiled(pixels: DataFrame, keys: list[str], side: int, patch: int, stride: int, predict, classes: int = 3) -> DataFrame:
    """(keys, y, x, cls): square images predicted by overlapping patches, whose scores are blended by their windows.

    predict: scores (n, patch, patch, classes) of patches (n, patch, patch) of values; it runs on batches of patches.
    """
    starts = window_starts(F.lit(side), patch, stride)
    of = lambda c: F.filter(starts, lambda o: (F.col(c) >= o) & (F.col(c) < o + patch))
    cut = pixels.withColumn("py", F.explode(of("y"))).withColumn("px", F.explode(of("x")))
    whole = cut.groupBy(*keys, "py", "px").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells")).select(*keys, "py", "px", F.transform("cells", lambda e: e["v"].cast("double")).alias("v"))

    def scored(batches):
        for batch in batches:
            values = np.stack(batch["v"].to_list()).reshape(-1, patch, patch) if len(batch) else np.zeros((0, patch, patch))
            yield batch.drop(columns="v").assign(p=list(predict(values).reshape(len(batch), -1)))

    kinds = dict(whole.dtypes)
    scores = whole.mapInPandas(scored, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "py", "px")) + ", p array<double>")
    at = scores.select(*keys, "py", "px", F.posexplode("p").alias("i", "p"))
    y, x = F.expr(f"i div {patch * classes}").cast("int"), F.expr(f"(i div {classes}) % {patch}").cast("int")
    rows = at.select(*keys, (F.col("py") + y).alias("y"), (F.col("px") + x).alias("x"), (F.col("i") % classes).alias("k"), "p", window_weight(y, x, patch).alias("w"))
    return argmax_class(blend_predictions(rows, keys), keys)


def normalise_channels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Least to greatest value of a channel become 0 to 255, truncated; a constant channel is 0."""
    ends = pixels.groupBy(*keys, "c").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    span = F.col("_high") - F.col("_low")
    return pixels.join(ends, [*keys, "c"]).withColumn("v", F.when(span > 0, F.floor((F.col("v") - F.col("_low")) / F.nullif(span, F.lit(0)) * 255)).otherwise(0).cast("int")).drop("_low", "_high")


def tint(pixels: DataFrame) -> DataFrame:
    """Masked pixels (cls > 0) are 0.6 of the image and 0.4 of red (c = 0)."""
    return pixels.withColumn("v", F.when(F.col("cls") > 0, F.col("v") * 0.6 + F.when(F.col("c") == 0, 0.4).otherwise(0.0)).otherwise(F.col("v")))


def crop(pixels: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """The window's pixels, counted from its corner; the filter reaches the scan."""
    return pixels.where((F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def layout(shape: Column) -> Column:
    """'hw', 'chw' or 'hwc' of a shape: channels are at most 8, sides are over 64."""
    few, side = (lambda i: F.get(shape, F.lit(i)) <= 8), (lambda i: F.get(shape, F.lit(i)) > 64)
    return F.when(F.size(shape) == 2, "hw").when((F.size(shape) == 3) & few(0) & side(1) & side(2), "chw").otherwise("hwc")


def shrink_nearest(pixels: DataFrame, height: int, width: int, longest: int) -> DataFrame:
    """Nearest-neighbour downscaling so that the longest side is at most ``longest``."""
    if max(height, width) <= longest:
        return pixels
    scale = longest / max(height, width)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    sy, sx = height / h, width / w
    # each target reads one source pixel; a source is kept if it is the one some target reads
    ty, tx = F.ceil(F.col("y") / sy - 0.5), F.ceil(F.col("x") / sx - 0.5)
    hit = (F.floor((ty + 0.5) * sy) == F.col("y")) & (F.floor((tx + 0.5) * sx) == F.col("x")) & (ty < h) & (tx < w)
    return pixels.where(hit).withColumn("y", ty.cast("int")).withColumn("x", tx.cast("int"))


def cross_entropy(probabilities: Column, cls: Column, weights: tuple[float, ...] = (0.6, 1.0, 5.0)) -> Column:
    """Weighted cross-entropy of a pixel, over a softmax of the given probabilities."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + F.exp(p))
    return -F.get(F.array(*map(F.lit, weights)), cls) * F.ln(F.exp(F.get(probabilities, cls)) / total)
