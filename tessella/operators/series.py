"""Ordered series: smoothing, ordinals, best rows, logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kernel(window: int) -> list[float]:
    """A Gaussian over an odd window with a deviation of a seventh of it, summing to one."""
    half, sigma = window // 2, window / 7.0
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def smooth(series: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Add smooth: a centred Gaussian mean with the ends repeated, twice for windows of five or more.

    A window of one changes nothing; one longer than the series gives the mean; an even one is an error. Each
    pass is one window over the series; ends come from clamped places in the neighbourhood's list.
    """
    if window > 1 and window % 2 == 0:
        raise ValueError("the window's length is odd")
    out = series.withColumn("smooth", F.col(value).cast("double"))
    if window <= 1:
        return out
    half, weights = window // 2, kernel(window)
    whole = Window.partitionBy(*keys)
    at = Window.partitionBy(*keys).orderBy(*order)
    n, i = F.count("*").over(whole), F.row_number().over(at) - 1
    for _ in range(2 if window >= 5 else 1):
        near = F.collect_list("smooth").over(at.rowsBetween(-half, half))
        marked = out.withColumn("_near", near).withColumn("_n", n).withColumn("_i", i).withColumn("_mean", F.avg("smooth").over(whole))
        first = F.greatest(F.col("_i") - half, F.lit(0))
        place = lambda k: (F.least(F.greatest(F.col("_i") + (k - half), F.lit(0)), F.col("_n") - 1) - first).cast("int")  # noqa: B023, E731
        total = sum((F.get("_near", place(k)) * F.lit(w) for k, w in enumerate(weights)), F.lit(0.0))
        out = marked.withColumn("smooth", F.when(F.col("_n") < window, F.col("_mean")).otherwise(total)).drop("_near", "_n", "_i", "_mean")
    return out


def ordinal(series: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Add 1..n by the order."""
    return series.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def best(series: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """(keys, best_i, best): the largest value and its first place."""
    return series.groupBy(*keys).agg(F.max_by(place, F.struct(F.col(value), -F.col(place))).alias("best_i"), F.max(value).alias("best"))


def limits(series: DataFrame, value: str) -> DataFrame:
    """(p05, p95) with linear interpolation; the least and greatest value if both are equal."""
    p = series.agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.min(value).alias("a"), F.max(value).alias("b"))
    alike = F.get("p", F.lit(0)) == F.get("p", F.lit(1))
    return p.select(F.when(alike, F.col("a")).otherwise(F.get("p", F.lit(0))).alias("p05"), F.when(alike, F.col("b")).otherwise(F.get("p", F.lit(1))).alias("p95"))


def patience(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add best_so_far (least) and waited: rows since the last improvement."""
    at = Window.partitionBy(*keys).orderBy(order)
    before = F.min(value).over(at.rowsBetween(Window.unboundedPreceding, -1))
    out = series.withColumn("best_so_far", F.min(value).over(at)).withColumn("_n", F.row_number().over(at)).withColumn("_up", F.coalesce(F.col(value) < before, F.lit(True)))
    return out.withColumn("waited", (F.col("_n") - F.max(F.when(F.col("_up"), F.col("_n"))).over(at)).cast("long")).drop("_n", "_up")


#: Plain decimals after these names; other notations end the number early.
LOG_FIELDS = ["accuracy", "loss", "val_accuracy", "val_loss"]


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """The four measures of each line that has them all."""
    found = {k: F.regexp_extract(line, rf"(?:^|[^_a-z]){k}: ([0-9.]+)", 1) for k in LOG_FIELDS}
    out = lines.select("*", *[v.alias(k) for k, v in found.items()])
    return out.where(" and ".join(f"{k} <> ''" for k in LOG_FIELDS)).select(*lines.columns, *[F.col(k).cast("double").alias(k) for k in LOG_FIELDS])
