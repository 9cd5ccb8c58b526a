"""Rings cut by boxes, for all rings of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
RINGS = pa.list_(RING)


def following(bounds: np.ndarray) -> np.ndarray:
    """By point, the place of the next one of its ring."""
    after = np.arange(1, bounds[-1] + 1)
    full = bounds[1:] > bounds[:-1]
    after[bounds[1:][full] - 1] = bounds[:-1][full]
    return after


def clip(points: np.ndarray, bounds: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings (points one after the other, and the bounds between them) cut by the four half-planes of a box each (x0, y0, x1, y1).

    Exact for convex rings and right in area for all; a concave ring in several parts is left as one, joined along the box.
    """
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        ring = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        edge = boxes[ring, side]
        depth = sign * (points[:, axis] - edge)
        after = following(bounds)
        inside, crossed = depth >= 0, (depth >= 0) != (depth[after] >= 0)
        n = inside.astype(np.int64) + crossed
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros((ends[-1], 2))
        out[ends[:-1][inside]] = points[inside]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = points + (depth / (depth - depth[after]))[:, None] * (points[after] - points)
        at[:, axis] = edge
        out[ends[:-1][crossed] + inside[crossed]] = at[crossed]
        points, bounds = out, ends[bounds]
    return distinct(points, bounds)


def distinct(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without points that equal the one before, and without a last one that equals the first."""
    for closing in (False, True):
        keep = np.ones(len(points), bool)
        if closing:
            many = np.flatnonzero(np.diff(bounds) > 1)
            ends = bounds[1:][many] - 1
            keep[ends] = (points[ends] != points[bounds[:-1][many]]).any(1)
        else:
            keep[1:] = (points[1:] != points[:-1]).any(1)
            keep[bounds[:-1][np.diff(bounds) > 0]] = True
        points, bounds = points[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
    return points, bounds


def areas(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signed areas, positive if counter-clockwise with y upwards."""
    after = following(bounds)
    terms = points[:, 0] * points[after, 1] - points[after, 0] * points[:, 1]
    return np.diff(np.concatenate([[0.0], np.cumsum(terms)])[bounds]) / 2


def canonical(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The points in order: counter-clockwise from the smallest (x, y) on."""
    lengths = np.diff(bounds)
    ring = np.repeat(np.arange(len(lengths)), lengths)
    first = np.lexsort((points[:, 1], points[:, 0], ring))[bounds[:-1][lengths > 0]]
    start = np.zeros(len(lengths), np.int64)
    start[lengths > 0] = first - bounds[:-1][lengths > 0]
    turn = np.where(areas(points, bounds) < 0, -1, 1)
    step = np.arange(len(points)) - bounds[:-1][ring]
    return points[bounds[:-1][ring] + (start[ring] + turn[ring] * step) % np.maximum(lengths, 1)[ring]]


def points_of(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points and bounds of a column of rings."""
    flat = rings.flatten()
    lengths = np.nan_to_num(np.array(rings.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return np.stack([flat.field("x").to_numpy(), flat.field("y").to_numpy()], 1), np.concatenate([[0], np.cumsum(lengths)])


def ring_column(points: np.ndarray, bounds: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def clip_rings(rows: DataFrame, ring: str, box: list[str]) -> DataFrame:
    """Rows with their ring cut by their box (columns x0, y0, x1, y1 of doubles) and in canonical form; rows of which nothing is left are dropped."""
    at, sides = rows.columns.index(ring), [rows.columns.index(c) for c in box]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, bounds = points_of(batch.column(at))
            points, bounds = clip(points, bounds, np.stack([batch.column(i).to_numpy() for i in sides], 1))
            out = batch.set_column(at, ring, ring_column(canonical(points, bounds), bounds).cast(RING))
            yield out.filter(pa.array(np.diff(bounds) > 0))

    return rows.mapInArrow(cut, rows.schema)


def clip_polygons(rows: DataFrame, rings: str, box: list[str]) -> DataFrame:
    """The same for polygons (outer ring, then holes): holes without an inside are dropped, and polygons whose outer ring has fewer than three points."""
    at, sides = rows.columns.index(rings), [rows.columns.index(c) for c in box]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            of = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64))])
            points, bounds = points_of(column.flatten())
            boxes = np.stack([batch.column(i).to_numpy() for i in sides], 1)
            points, bounds = clip(points, bounds, np.repeat(boxes, np.diff(of), 0))
            full = np.diff(bounds) >= 3
            outer = np.zeros(len(full), bool)
            outer[of[:-1][np.diff(of) > 0]] = True
            kept = full & (outer | (np.abs(areas(points, bounds)) > 0))
            whole = np.zeros(len(of) - 1, bool)
            whole[np.diff(of) > 0] = full[of[:-1][np.diff(of) > 0]]
            flat = ring_column(canonical(points, bounds), bounds).filter(pa.array(kept))
            offsets = np.concatenate([[0], np.cumsum(kept)])[of]
            nested = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.cast(RING))
            yield batch.set_column(at, rings, nested.cast(RINGS)).filter(pa.array(whole))

    return rows.mapInArrow(cut, rows.schema)
