"""Boxes and masks that meet: bucketed self-joins, suppression and merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import components
from tessella.operators.runs import contingency, union_runs

#: Side of the cells that boxes are bucketed into; about twice a typical box.
CELL = 16


def meeting_boxes(boxes: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """(keys, i, j) with i < j of boxes (id, x0, y0, x1, y1) that share area, by a grid: no pair outside a cell is made.

    A pair is made in the cell of its intersection's corner only, so nothing has to be made distinct. Both sides grow with the boxes;
    exploded cells look small to the planner, hence the hint.
    """
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell))
    cells = boxes.where("x1 > x0 and y1 > y0").withColumn("cy", F.explode(span("y0", "y1"))).withColumn("cx", F.explode(span("x0", "x1")))
    a, b = (cells.select(*keys, "cy", "cx", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "x0", "y0", "x1", "y1")]) for n in "ab")
    both = a.join(b.hint("merge"), [*keys, "cy", "cx"]).where("a_id < b_id and a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    own = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    area = (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) * (F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    return both.where(own).select(*keys, F.col("a_id").alias("i"), F.col("b_id").alias("j"), area.cast("long").alias("overlap"))


def overlapping_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) that share area with another one, with the root of their overlap component."""
    pairs = meeting_boxes(boxes, keys)
    found = components(pairs.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")), keys, "merge")
    return boxes.join(found.hint("merge"), [*keys, "id"])


def component_pixels(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root, id, y, x) of boxes with the root of their component.

    Boxes are dealt by component, over a fixed number of tasks; pixels are made only then, so that they are neither joined, shuffled
    nor broadcast.
    """
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = boxes.select(*keys, "root", "id", "x0", "y0", "x1", "y1").repartition(parts, *keys, "root")
    rows = dealt.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    return rows.select(*keys, "root", "id", "y", "x")


def mask_overlaps(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, overlap) with i < j of masks given as runs (label), which may overlap."""
    both = contingency(runs, runs, keys).where("t < p")
    return both.select(*keys, F.col("t").alias("i"), F.col("p").alias("j"), F.col("n").alias("overlap"))


def suppress(boxes: DataFrame, overlaps: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys, id) kept by greedy suppression: best score first, ties by the larger id; an IoU above tau drops the other.

    Ids without such a partner are kept outright; only the rest is folded, by component of the IoU graph.
    """
    area = boxes.select(*keys, "id", "score", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    a, b = (area.select(*keys, F.col("id").alias(n), F.col("area").alias(f"area_{n}")) for n in "ij")
    close = overlaps.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where(F.col("overlap") / (F.col("area_i") + F.col("area_j") - F.col("overlap")) > tau).select(*keys, "i", "j")
    groups = components(close.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")), keys)
    rows = area.join(groups, [*keys, "id"])
    partners = close.unionByName(close.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).groupBy(*keys, F.col("i").alias("id")).agg(F.collect_list("j").alias("partners"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        dropped, kept = set(), []
        for row in group.sort_values(["score", "id"], ascending=False).itertuples(index=False):
            if row.id not in dropped:
                kept.append(row)
                dropped.update(row.partners)
        return pd.DataFrame(kept, columns=group.columns)[[*keys, "id"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.select(*keys, "id").schema)
    chosen = rows.join(partners, [*keys, "id"]).groupBy(*keys, "root").applyInPandas(fold, schema)
    return area.join(groups, [*keys, "id"], "left_anti").select(*keys, "id").unionByName(chosen)


def merge_groups(runs: DataFrame, keys: list[str], least_iom: float) -> DataFrame:
    """(keys, id, root): masks joined where they share at least this part of the smaller one; closure is transitive."""
    areas = runs.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    a, b = (areas.select(*keys, F.col("label").alias(n), F.col("area").alias(f"area_{n}")) for n in "ij")
    near = mask_overlaps(runs, keys).join(a, [*keys, "i"]).join(b, [*keys, "j"]).where(F.col("overlap") / F.least("area_i", "area_j") >= least_iom)
    found = components(near.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")), keys)
    return areas.select(*keys, F.col("label").alias("id")).join(found, [*keys, "id"], "left").withColumn("root", F.coalesce("root", "id"))


def merge_masks(runs: DataFrame, keys: list[str], least_iom: float) -> DataFrame:
    """(keys, root, members, area, box) of the merged masks."""
    groups = merge_groups(runs, keys, least_iom)
    united = union_runs(runs.withColumnRenamed("label", "id").join(groups, [*keys, "id"]).select(*keys, "root", "y", "x0", "x1"), [*keys, "root"])
    shape = united.groupBy(*keys, "root").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"), F.min("x0").alias("bx0"), F.min("y").alias("by0"), (F.max("x1") - 1).alias("bx1"), F.max("y").alias("by1"))
    members = groups.groupBy(*keys, "root").agg(F.array_sort(F.collect_set("id")).alias("members"))
    return shape.join(members, [*keys, "root"])


def keep_small(shapes: DataFrame, tile_area: float, most_coverage: float) -> DataFrame:
    """Masks that cover less than this share of a tile; no tile, no filter."""
    return shapes if tile_area <= 0 else shapes.where(F.col("area") / F.lit(float(tile_area)) < most_coverage)


def keep_below(shapes: DataFrame, most_area: float) -> DataFrame:
    """Masks below this area; 0 is no filter."""
    return shapes if most_area <= 0 else shapes.where(F.col("area") < most_area)


def top_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row by keys in this order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
