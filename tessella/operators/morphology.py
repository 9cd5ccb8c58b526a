"""Distance transform, peaks and marker-controlled watershed: one image per group, in NumPy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessella.operators.metrics import raster_jaccard


def offsets(connectivity: int) -> list[tuple[int, int]]:
    """The four (connectivity 1, or 4) or eight (2, or 8) neighbours."""
    near = [(-1, 0), (0, -1), (0, 1), (1, 0)]
    if connectivity in (1, 4):
        return near
    if connectivity in (2, 8):
        return [*near, (-1, -1), (-1, 1), (1, -1), (1, 1)]
    raise ValueError("connectivity is 1 or 2")


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set pixel to the nearest unset one; 0 elsewhere, and infinite if none is unset.

    Columns first, then rows by growing steps, as far as the largest distance found; memory of a few rasters.
    """
    h, w = mask.shape
    far = float((h + w) ** 2)
    run, up = np.full(w, np.inf), np.full((h, w), np.inf)
    for y in [*range(h), *range(h - 1, -1, -1)]:
        if y == h - 1:
            run = np.where(mask[y], np.minimum(run + 1, up[y]), 0)
        else:
            run = np.where(mask[y], run + 1, 0)
        up[y] = run = np.minimum(run, up[y])
    squares = np.minimum(up**2, far)
    out, step = squares.copy(), 1
    while step < w and step**2 < out.max():
        np.minimum(out[:, step:], squares[:, :-step] + step**2, out=out[:, step:])
        np.minimum(out[:, :-step], squares[:, step:] + step**2, out=out[:, :-step])
        step += 1
    return np.where(mask, np.where(out >= far, np.inf, np.sqrt(out)), 0.0)


def window_max(height: np.ndarray, distance: int) -> np.ndarray:
    """The greatest height in the (2 * distance + 1) square around each pixel."""
    out = height
    for axis in (0, 1):
        wide = np.pad(out, [(distance, distance) if i == axis else (0, 0) for i in (0, 1)], constant_values=-np.inf)
        out = np.lib.stride_tricks.sliding_window_view(wide, 2 * distance + 1, axis).max(-1)
    return out


def peaks(height: np.ndarray, distance: int, mask: np.ndarray, border: bool) -> list[tuple[int, int]]:
    """Highest pixels of their neighbourhood (2 * distance + 1 square), best first, at least ``distance`` apart.

    With border, pixels within the distance of the image's edge are out of the mask. Pixels out of the mask neither are peaks nor
    stand in one's way.
    """
    h, w = height.shape
    lowest = height.min()
    inside = mask.copy()
    if border:
        inside[:] = False
        inner = (slice(distance, max(h - distance, 0)), slice(distance, max(w - distance, 0)))
        inside[inner] = mask[inner]
    seen = np.where(inside, height, lowest)
    good = (seen == window_max(seen, distance)) & inside & (height > lowest)
    found = np.argwhere(good)
    free = np.ones((h, w), bool)
    kept: list[tuple[int, int]] = []
    for y, x in found[np.argsort(-height[good], kind="stable")].tolist():
        if free[y, x]:
            kept.append((y, x))
            free[max(y - distance + 1, 0) : y + distance, max(x - distance + 1, 0) : x + distance] = False
    return kept


def label(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Components in scan order."""
    wide = np.pad(np.asarray(mask, bool), 1)  # with a rim that isn't free
    names = np.zeros(wide.size, np.int32)
    free, named, steps = memoryview(wide.ravel()), memoryview(names), [dy * wide.shape[1] + dx for dy, dx in offsets(connectivity)]
    n = 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        at = int(y + 1) * wide.shape[1] + int(x + 1)
        if not free[at]:
            continue
        n += 1
        stack = [at]
        free[at], named[at] = False, n
        while stack:
            at = stack.pop()
            for step in steps:
                k = at + step
                if free[k]:
                    free[k], named[k] = False, n
                    stack.append(k)
    return names.reshape(wide.shape)[1:-1, 1:-1]


def dilate(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        wide = np.pad(mask, 1)
        mask = np.lib.stride_tricks.sliding_window_view(wide, (3, 3)).any((2, 3))
    return mask


def flood(height: np.ndarray, markers: np.ndarray, mask: np.ndarray, connectivity: int, parts: np.ndarray | None = None) -> np.ndarray:
    """Labels grow from the markers, lowest height first and in order of arrival, inside the mask.

    With ``parts``, the mask's components of this connectivity that hold all markers, a part with one marker is filled at once.
    """
    out, rivals = markers.copy(), markers > 0
    if parts is not None:
        own = parts[rivals]
        alone = np.bincount(own, minlength=int(parts.max()) + 1) == 1
        names = np.zeros(len(alone), markers.dtype)
        names[own] = markers[rivals]
        out = np.where(alone[parts], names[parts], out)
        rivals = rivals & ~alone[parts]
    free, level, names = (np.pad(a, 1).ravel() for a in (mask & (out == 0), height, out))  # with a rim that isn't free
    starts, shape = np.flatnonzero(np.pad(rivals, 1)), np.add(mask.shape, 2)
    queue = [(h, i, at) for i, (h, at) in enumerate(zip(level[starts].tolist(), starts.tolist(), strict=True))]
    heapq.heapify(queue)
    n, steps = len(queue), [int(dy * shape[1] + dx) for dy, dx in offsets(connectivity)]
    free, level, named = memoryview(free), memoryview(level), memoryview(names)
    while queue:
        _, _, at = heapq.heappop(queue)
        own = named[at]
        for step in steps:
            k = at + step
            if free[k]:
                free[k], named[k] = False, own
                heapq.heappush(queue, (level[k], n, k))
                n += 1
    return names.reshape(shape)[1:-1, 1:-1]


def elevation(interior: np.ndarray, boundary: np.ndarray, d: np.ndarray, ridge_level: float | None) -> np.ndarray:
    """What is flooded: the inside lies as deep as its distances, all else and (dilated) boundaries stand at the ridge level.

    By default that is above all: twice the greatest distance and 1.
    """
    top = float(2 * d.max() + 1) if ridge_level is None else float(ridge_level)
    return np.where(interior & ~boundary, -d, top)


def watershed(cls: np.ndarray, min_distance: int, dilate_iter: int, connectivity: int, min_area: int, exclude_border: bool, ridge_level: float | None, d: np.ndarray | None = None, known: dict | None = None) -> np.ndarray:
    """Instances of a semantic raster (1 interior, 2 boundary).

    The interior's distances (``d``, if they are known) have peaks, from which the elevation is flooded inside; without peaks the
    interior's four-connected components are the instances. With ``min_area`` smaller ones are dropped and the others numbered anew.
    ``known`` keeps what several settings share for one raster, its components too.
    """

    def once(name: tuple, make):
        if known is None:
            return make()
        if name not in known:
            known[name] = make()
        return known[name]

    interior = cls == 1
    if not interior.any():
        return np.zeros(cls.shape, np.int32)
    if d is None:
        d = interior_distances(interior)
    found = once(("peaks", min_distance, exclude_border), lambda: peaks(d, min_distance, interior, exclude_border))
    if found:
        markers = np.zeros(cls.shape, np.int32)
        markers[tuple(np.array(found).T)] = np.arange(1, len(found) + 1)
        parts = None if known is None else once(("parts", connectivity), lambda: label(interior, connectivity))
        boundary = once(("boundary", dilate_iter), lambda: dilate(cls == 2, dilate_iter))
        out = flood(elevation(interior, boundary, d, ridge_level), markers, interior, connectivity, parts)
    else:
        out = once(("parts", 1), lambda: label(interior, 1))
    if min_area <= 0:
        return out
    sizes = np.bincount(out.ravel())
    keep = np.flatnonzero((sizes >= min_area) & (np.arange(len(sizes)) > 0))
    table = np.zeros(len(sizes), np.int32)
    table[keep] = np.arange(1, len(keep) + 1)
    return table[out]


def interior_distances(interior: np.ndarray) -> np.ndarray:
    d = distances(interior)
    d[~np.isfinite(d)] = max(interior.shape)
    return d


def per_image(pixels: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Run work(dense raster) on each image; work gives the columns of ``schema`` as arrays. pixels: keys, y, x, cls."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((int(group["y"].max()) + 1, int(group["x"].max()) + 1), np.int8)
        dense[group["y"], group["x"]] = group["cls"]
        own = {k: group[k].iloc[0] for k in keys}
        del group
        found = pd.DataFrame(dict(zip(names, work(dense), strict=True)))
        for i, k in enumerate(keys):
            found.insert(i, k, own[k])
        return found

    kinds = dict(pixels.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    return pixels.groupBy(*keys).applyInPandas(fold, full)


def distance_rows(dense: np.ndarray) -> tuple[np.ndarray, ...]:
    d = distances(dense == 1)
    y, x = np.nonzero(d)
    return y, x, d[y, x]


def peak_rows(min_distance: int):
    def rows(dense: np.ndarray) -> tuple[np.ndarray, ...]:
        mask = dense == 1
        d = distances(mask)
        found = np.array(peaks(np.where(np.isfinite(d), d, 0), min_distance, mask, False), int).reshape(-1, 2)
        return np.arange(1, len(found) + 1), found[:, 0], found[:, 1]

    return rows


def watershed_rows(**parameters):
    """Labelled pixels of one setting."""

    def rows(dense: np.ndarray) -> tuple[np.ndarray, ...]:
        out = watershed(dense, **parameters)
        y, x = np.nonzero(out)
        return y, x, out[y, x]

    return rows


def watershed_grid(settings: list[dict]):
    """Labelled pixels of each setting, by its place in the list, from distances that are made once."""

    def rows(dense: np.ndarray) -> tuple[np.ndarray, ...]:
        parts = []
        for i, out in enumerate(watersheds(dense, settings)):
            y, x = np.nonzero(out)
            parts.append((np.full(len(y), i), y, x, out[y, x]))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    return rows


def watersheds(cls: np.ndarray, settings: list[dict]) -> Iterator[np.ndarray]:
    """The label map of each setting; distances, peaks and components are made once for all that share them."""
    d, known = interior_distances(cls == 1), {}
    for parameters in settings:
        yield watershed(cls, **parameters, d=d, known=known)


def painted(boxes: pd.DataFrame, height: int, width: int) -> np.ndarray:
    """Label map of boxes (label, x0, y0, x1, y1): labels are places in their order from 1, the largest shows, 0 is none."""
    out = np.zeros((height, width), np.int32)
    boxes = boxes[(boxes["x1"] > boxes["x0"]) & (boxes["y1"] > boxes["y0"])]
    places = np.unique(boxes["label"], return_inverse=True)[1] + 1
    spans = boxes[["x0", "y0", "x1", "y1"]].to_numpy(np.int64)
    for i in np.argsort(places):
        x0, y0, x1, y1 = spans[i]
        out[y0:y1, x0:x1] = places[i]
    return out


def classes(labels: np.ndarray) -> np.ndarray:
    """Classes of labelled pixels: 2 if one of the four neighbours on the canvas has another label, else 1; 0 without a label."""
    other = np.zeros(labels.shape, bool)
    for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:, 1:], np.s_[:, :-1])):
        differ = labels[a] != labels[b]
        other[a] |= differ
        other[b] |= differ
    return np.where(labels > 0, np.where(other, 2, 1), 0).astype(np.int8)


def tuned(boxes: DataFrame, keys: list[str], settings: list[dict], height: int, width: int) -> DataFrame:
    """(keys, setting, aji): true boxes, painted, against the instances of each watershed setting on the predicted ones.

    boxes: keys, label, x0, y0, x1, y1, pred. Only boxes travel; label maps of one image at a time live in a worker. Images are dealt
    over a fixed number of tasks, as their work doesn't show in the size of their rows.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        true, pred = (painted(group[group["pred"] == side], height, width) for side in (False, True))
        cls = classes(pred)
        y, x = np.nonzero(cls)
        h, w = int(y.max(initial=-1)) + 1, int(x.max(initial=-1)) + 1  # as per_image makes them
        found, aji = np.zeros_like(true), []
        for labels in watersheds(cls[:h, :w], settings) if len(y) else [cls] * len(settings):
            found[:h, :w] = labels[:h, :w]
            aji.append(raster_jaccard(true, found)[2])
        return pd.DataFrame({k: group[k].iloc[0] for k in keys} | {"setting": np.arange(len(settings), dtype=np.int32), "aji": np.array(aji, float)})

    dealt = boxes.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    kinds = dict(boxes.dtypes)
    return dealt.groupBy(*keys).applyInPandas(fold, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "setting int", "aji double"]))
