"""Polygon tracing, rasterising, splitting of overlaps and line work, in NumPy per feature or component."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]


def area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def is_simple(ring: list[Point]) -> bool:
    """Whether no two edges of a ring cross."""
    n = len(ring)
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            if crossing(ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]):
                return False
    return n >= 3


def crossing(a: Point, b: Point, c: Point, d: Point) -> Point | None:
    """Where two segments cross, if they do."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    cross = r[0] * s[1] - r[1] * s[0]
    if cross == 0:
        return None
    t = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / cross
    u = ((c[0] - a[0]) * r[1] - (c[1] - a[1]) * r[0]) / cross
    return (a[0] + t * r[0], a[1] + t * r[1]) if 0 <= t <= 1 and 0 <= u <= 1 else None


def snap(ring: list[Point], grid: float = 1e-6) -> list[Point]:
    """Points on a precision grid, repeated ones dropped."""
    points = [(round(x / grid) * grid, round(y / grid) * grid) for x, y in ring]
    return [p for i, p in enumerate(points) if p != points[i - 1] or len(points) == 1]


def smooth_line(line: list[Point], times: int = 3) -> list[Point]:
    """Corner cutting that keeps the ends."""
    for _ in range(times):
        if len(line) < 3:
            break
        cut = [line[0]]
        for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
            cut += [(0.75 * ax + 0.25 * bx, 0.75 * ay + 0.25 * by), (0.25 * ax + 0.75 * bx, 0.25 * ay + 0.75 * by)]
        line = [*cut, line[-1]]
    return line


def taubin(line: list[Point], times: int = 1, lam: float = 0.5, mu: float = -0.53) -> list[Point]:
    """Smoothing without shrinking: a step towards the neighbours' mean, then one back."""
    p = np.array(line, float)
    for _ in range(times):
        for step in (lam, mu):
            if len(p) > 2:
                p[1:-1] += step * ((p[:-2] + p[2:]) / 2 - p[1:-1])
    return [tuple(x) for x in p.tolist()]


def simplify(line: list[Point], tolerance: float) -> list[Point]:
    """Points that lie further than the tolerance from the line through those kept."""
    if len(line) < 3:
        return line
    a, b = np.array(line[0]), np.array(line[-1])
    p = np.array(line[1:-1])
    d = b - a
    length = math.hypot(*d)
    off = np.abs((p[:, 0] - a[0]) * d[1] - (p[:, 1] - a[1]) * d[0]) / length if length else np.hypot(*(p - a).T)
    k = int(off.argmax())
    if off[k] <= tolerance:
        return [line[0], line[-1]]
    return simplify(line[: k + 2], tolerance)[:-1] + simplify(line[k + 1 :], tolerance)


def nearest(points: list[Point], to: Point) -> Point:
    return min(points, key=lambda p: (math.dist(p, to), p))


def outlines(mask: np.ndarray) -> list[list[Point]]:
    """Pixel-exact rings of a mask: each follows unpaired unit edges with the mask on one side."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    wide = np.pad(mask.astype(bool), 1)
    for y, x in zip(*np.nonzero(mask), strict=True):
        y, x = int(y), int(x)
        for off, start, end in (((-1, 0), (x, y), (x + 1, y)), ((0, 1), (x + 1, y), (x + 1, y + 1)), ((1, 0), (x + 1, y + 1), (x, y + 1)), ((0, -1), (x, y + 1), (x, y))):
            if not wide[y + 1 + off[0], x + 1 + off[1]]:
                after.setdefault(start, []).append(end)
    rings = []
    while after:
        start = min(after)
        ring, at, way = [], start, (1, 0)
        while True:
            ring.append(at)
            ends = after[at]
            # where two rings touch, turn right, so that parts which meet in a corner stay apart
            ends.sort(key=lambda e: _turn(way, (e[0] - at[0], e[1] - at[1])))
            to = ends.pop(0)
            if not ends:
                del after[at]
            way, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
        rings.append([(float(x), float(y)) for i, (x, y) in enumerate(ring) if not _straight(ring[i - 1], (x, y), ring[(i + 1) % len(ring)])])
    return rings


def _turn(a: tuple[int, int], b: tuple[int, int]) -> int:
    cross = a[0] * b[1] - a[1] * b[0]
    return {1: 0, 0: 1, -1: 2}[cross]


def _straight(a: Point, b: Point, c: Point) -> bool:
    return (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])


def fill(rings: list[list[Point]], height: int, width: int) -> np.ndarray:
    """Pixels whose centre is inside an odd number of rings."""
    out = np.zeros((height, width), bool)
    for y in range(height):
        crossings = []
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ay <= y + 0.5) != (by <= y + 0.5):
                    crossings.append(ax + (y + 0.5 - ay) * (bx - ax) / (by - ay))
        crossings.sort()
        for a, b in zip(crossings[::2], crossings[1::2], strict=False):
            out[y, max(0, math.ceil(a - 0.5)) : max(0, min(width, math.ceil(b - 0.5)))] = True
    return out


def split_pair(a: np.ndarray, b: np.ndarray, min_area: int) -> tuple[np.ndarray, np.ndarray]:
    """Two masks without their overlap: a small part goes to the smaller mask, a large one is shared along its middle.

    Shared pixels go to the mask whose own part is nearer; that line is where both own parts are equally far.
    One mask inside the other is an error unless the overlap is small.
    """
    both = a & b
    if not both.any():
        return a, b
    smaller_is_a = a.sum() <= b.sum()
    a_only, b_only = a & ~b, b & ~a
    if both.sum() < min_area:
        return (a, b_only) if smaller_is_a else (a_only, b)
    if not a_only.any() or not b_only.any():
        raise ValueError("one mask holds the other")
    from tessella.operators.morphology import distances

    to_a, to_b = distances(~a_only), distances(~b_only)
    mine = both & ((to_a < to_b) | ((to_a == to_b) & smaller_is_a))
    return a_only | mine, b_only | (both & ~mine)


def _own_masks(group: pd.DataFrame) -> dict[int, tuple[int, int, np.ndarray]]:
    """By id in ascending order: its pixels' lowest y and x, and its mask from there. An id's mask is no larger than its own box."""
    masks = {}
    for i, part in group.groupby("id"):
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        y0, x0 = int(y.min()), int(x.min())
        mask = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
        mask[y - y0, x - x0] = True
        masks[i] = (y0, x0, mask)
    return masks


def _box_masks(boxes: Iterable[tuple[int, int, int, int, int]]) -> dict[int, tuple[int, int, np.ndarray]]:
    """The same of boxes (id, x0, y0, x1, y1) in order of ids; boxes of one id are one mask."""
    masks = {}
    for i, x0, y0, x1, y1 in boxes:
        own = (y0, x0, np.ones((y1 - y0, x1 - x0), bool))
        if i in masks:
            y, x, mask = masks[i]
            window = (min(y, y0), min(x, x0), max(y + mask.shape[0], y1), max(x + mask.shape[1], x1))
            own = (*window[:2], _within(masks[i], window) | _within(own, window))
        masks[i] = own
    return masks


def _meeting(masks: dict[int, tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
    """Pairs of ids in order whose own boxes meet, with the box (y0, x0, y1, x1) around both."""
    ids = list(masks)
    spans = [(y, x, y + m.shape[0], x + m.shape[1]) for y, x, m in masks.values()]
    for n, a in enumerate(spans):
        for k, b in enumerate(spans[n + 1 :], n + 1):
            if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                yield ids[n], ids[k], (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def _within(own: tuple[int, int, np.ndarray], window: tuple[int, int, int, int]) -> np.ndarray:
    """A mask on the window, which holds it."""
    y, x, mask = own
    out = np.zeros((window[2] - window[0], window[3] - window[1]), bool)
    out[y - window[0] : y - window[0] + mask.shape[0], x - window[1] : x - window[1] + mask.shape[1]] = mask
    return out


def resolve(pixels: DataFrame, keys: list[str], min_area: int) -> DataFrame:
    """(keys, id, y, x) without overlaps; pixels: keys (the last is the overlap component), id, y, x. Pairs go in order of ids.

    A group is one component of the overlap graph. A mask inside another one takes the shared pixels.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        masks = _own_masks(group)
        for i, j, window in _meeting(masks):
            a, b = (_within(masks[k], window) for k in (i, j))
            if (a & b).any():
                try:
                    a, b = split_pair(a, b, min_area)
                except ValueError:
                    a, b = (a, b & ~a) if a.sum() <= b.sum() else (a & ~b, b)
                for k, mask in ((i, a), (j, b)):
                    y, x, own = masks[k]
                    y0, x0 = y - window[0], x - window[1]
                    masks[k] = (y, x, mask[y0 : y0 + own.shape[0], x0 : x0 + own.shape[1]])
        found = [(i, y0, x0, *np.nonzero(mask)) for i, (y0, x0, mask) in masks.items()]
        out = {"id": np.repeat([f[0] for f in found], [len(f[3]) for f in found]), "y": np.concatenate([f[3] + f[1] for f in found]), "x": np.concatenate([f[4] + f[2] for f in found])}
        return pd.DataFrame({k: group[k].iloc[0] for k in keys} | out, columns=[*keys, "id", "y", "x"])

    return pixels.groupBy(*keys).applyInPandas(fold, pixels.select(*keys, "id", "y", "x").schema)


def trace(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, pixel_area, rings): pixel-exact rings of each group's mask. A group is one component."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(group["y"].min()), int(group["x"].min())
        mask = np.zeros((int(group["y"].max()) - y0 + 1, int(group["x"].max()) - x0 + 1), bool)
        mask[group["y"] - y0, group["x"] - x0] = True
        rings = outlines(mask)
        text = [[{"x": x + x0, "y": y + y0} for x, y in ring] for ring in rings]
        return pd.DataFrame([(*(group[k].iloc[0] for k in keys), len(rings), len(group), abs(sum(area(r) for r in rings)), text)], columns=[*keys, "n_rings", "pixel_area", "area", "rings"])

    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_rings long, pixel_area long, area double, rings array<array<struct<x: double, y: double>>>"
    return pixels.groupBy(*keys).applyInPandas(fold, schema)


def dividing_line(a: np.ndarray, b: np.ndarray) -> list[Point]:
    """The line along which the overlap of two masks is shared, as points from end to end.

    Points are the midpoints of pixel edges between the two shares; each is followed by the nearest one left.
    """
    both = a & b
    mine = split_pair(a, b, 0)[0] & both
    points = []
    for (dy, dx), at in (((0, 1), lambda y, x: (x + 1.0, y + 0.5)), ((1, 0), lambda y, x: (x + 0.5, y + 1.0))):
        one, two = mine[: mine.shape[0] - dy, : mine.shape[1] - dx], mine[dy:, dx:]
        inside = both[: both.shape[0] - dy, : both.shape[1] - dx] & both[dy:, dx:]
        points += [at(int(y), int(x)) for y, x in zip(*np.nonzero((one != two) & inside), strict=True)]
    if len(points) < 2:
        return points
    far = max(points, key=lambda p: (math.dist(p, points[0]), p))
    line, left = [far], set(points) - {far}
    while left:
        to = nearest(sorted(left), line[-1])
        line.append(to)
        left.discard(to)
    return line


def snap_ends(line: list[Point], targets: list[Point]) -> list[Point]:
    """A line whose ends are extended to the nearest target points; where both would be the same point, the second nearest serves the end that is further from it."""
    if len(line) < 2 or not targets:
        return line
    first, last = nearest(targets, line[0]), nearest(targets, line[-1])
    if first == last and len(targets) > 1:
        rest = [t for t in targets if t != first]
        if math.dist(first, line[0]) <= math.dist(first, line[-1]):
            last = nearest(rest, line[-1])
        else:
            first = nearest(rest, line[0])
    return [first, *line, last]


def split_by_line(ring: list[Point], line: list[Point]) -> list[list[Point]]:
    """The parts of a ring on both sides of a line that crosses it twice; any other line leaves it whole."""
    hits = []
    for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
        for j, (u, v) in enumerate(zip(line, line[1:], strict=False)):
            at = crossing(p, q, u, v)
            if at is not None and all(math.dist(at, h[2]) > 1e-9 for h in hits):
                hits.append((i, j, at))
    if len(hits) != 2:
        return [ring]
    (i, u, a), (j, v, b) = hits
    between = line[u + 1 : v + 1] if u <= v else line[v + 1 : u + 1][::-1]
    one = [a, *ring[i + 1 : j + 1], b, *between[::-1]]
    two = [b, *ring[j + 1 :], *ring[: i + 1], a, *between]
    parts = [snap(x) for x in (one, two)]
    return parts if all(abs(area(x)) > 1e-12 for x in parts) else [ring]


def inside(ring: list[Point], p: Point) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def centroid(ring: list[Point]) -> Point:
    s = area(ring)
    if not s:
        return ring[0]
    x = y = 0.0
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        c = a[0] * b[1] - b[0] * a[1]
        x, y = x + (a[0] + b[0]) * c, y + (a[1] + b[1]) * c
    return x / (6 * s), y / (6 * s)


def assign_pieces(pieces: list[list[Point]], a_only: list[Point], b_only: list[Point]) -> list[str]:
    """'a' or 'b' for each piece: whose own part's middle is nearer to the piece's; a's on a tie."""
    to_a, to_b = centroid(a_only), centroid(b_only)
    return ["a" if math.dist(centroid(p), to_a) <= math.dist(centroid(p), to_b) else "b" for p in pieces]


def shared_lines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, points, length) of the dividing line of each pair that overlaps; pixels: keys, id, y, x, a component per group."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        own = [group[k].iloc[0] for k in keys]
        return pd.DataFrame([(*own, *line) for line in _lines(_own_masks(group))], columns=[*keys, "i", "j", "points", "length"])

    return pixels.groupBy(*keys).applyInPandas(fold, _line_schema(pixels, keys))


def box_lines(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """What shared_lines gives for the pixels of boxes (keys, id, x0, y0, x1, y1), without a row for each pixel.

    Boxes are dealt by component, over a fixed number of tasks, and a component is a row; masks are made where they are compared.
    """
    names = ["id", "x0", "y0", "x1", "y1"]
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = boxes.where("x1 > x0 and y1 > y0").select(*keys, *names).repartition(parts, *keys)
    rows = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("own")).select(*keys, *[F.col(f"own.{c}").alias(c) for c in names])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                masks = _box_masks(zip(*(c.tolist() for c in row[len(keys) :]), strict=True))
                out += [(*row[: len(keys)], *line) for line in _lines(masks)]
            yield pd.DataFrame(out, columns=[*keys, "i", "j", "points", "length"])

    return rows.mapInPandas(folded, _line_schema(boxes, keys))


def _line_schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys) + f", i {kinds['id']}, j {kinds['id']}, points int, length double"


def _lines(masks: dict[int, tuple[int, int, np.ndarray]]) -> Iterator[tuple]:
    """(i, j, points, length) of the dividing line of each pair that overlaps and of which none holds the other."""
    for i, j, window in _meeting(masks):
        a, b = (_within(masks[k], window) for k in (i, j))
        if (a & b).any() and (a & ~b).any() and (b & ~a).any():
            line = smooth_line(taubin([(x + window[1], y + window[0]) for x, y in dividing_line(a, b)]))
            yield i, j, len(line), float(sum(math.dist(p, q) for p, q in zip(line, line[1:], strict=False)))


def intersects(a: list[Point], b: list[Point]) -> bool:
    """Whether two rings share area: edges cross, or one holds a point of the other's inside."""
    p, q = np.array(a, float), np.array(b, float)
    r, s = np.roll(p, -1, 0) - p, np.roll(q, -1, 0) - q
    side = lambda o, d, x: d[:, None, 0] * (x[None, :, 1] - o[:, None, 1]) - d[:, None, 1] * (x[None, :, 0] - o[:, None, 0])
    of_q, of_p = side(p, r, q), side(q, s, p).T
    if ((of_q * np.roll(of_q, -1, 1) < 0) & (of_p * np.roll(of_p, -1, 0) < 0)).any():
        return True
    middle = lambda ring: [((u[0] + v[0] + w[0]) / 3, (u[1] + v[1] + w[1]) / 3) for u, v, w in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True)]
    return any(inside(b, x) and inside(a, x) for x in [centroid(a), centroid(b), *middle(a), *middle(b)])


def shrink_convex(ring: list[Point], by: float) -> list[Point]:
    """A convex ring with its edges moved inwards; empty if nothing is left."""
    ring = ring if area(ring) >= 0 else ring[::-1]
    out = list(ring)
    for (ax, ay), (bx, by_) in zip(ring, ring[1:] + ring[:1], strict=True):
        length = math.hypot(bx - ax, by_ - ay)
        if not length:
            continue
        depth = [((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / length - by for x, y in out]
        cut = []
        for i, (p, d) in enumerate(zip(out, depth, strict=True)):
            q, e = out[(i + 1) % len(out)], depth[(i + 1) % len(out)]
            if d >= 0:
                cut.append(p)
            if (d >= 0) != (e >= 0):
                t = d / (d - e)
                cut.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = cut
    return out if len(out) >= 3 and abs(area(out)) > 1e-12 else []


def contours(mask: np.ndarray, tolerance: float = 0.001, offset: Point = (0.0, 0.0), negate: bool = True) -> list[list[Point]]:
    """Outer rings of a mask's parts, closed: points nearer to the line than a share of the ring's length are dropped, then the ring is moved and y turned; rings of fewer than three points are none."""
    out = []
    for ring in outlines(mask):
        if area(ring) <= 0:  # a hole
            continue
        closed = [*ring, ring[0]]
        kept = simplify(closed, tolerance * sum(math.dist(p, q) for p, q in zip(closed, closed[1:], strict=False)))
        if len(kept) >= 4:
            out.append([(x + offset[0], -(y + offset[1]) if negate else y + offset[1]) for x, y in kept])
    return out


def by_ring(rows: DataFrame, ring: str, work, schema: str) -> DataFrame:
    """Rows with columns that work(points) gives for their ring."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def folded(batches):
        for batch in batches:
            found = [work([(p["x"], p["y"]) for p in r]) for r in batch[ring]]
            yield batch.assign(**{n: [f[i] for f in found] for i, n in enumerate(names)})

    return rows.mapInPandas(folded, f"{kinds}, {schema}")


def filled(rows: DataFrame, keys: list[str], rings: str, height: int, width: int) -> DataFrame:
    """(keys, y, x0, x1): runs of the pixels whose centre is inside an odd number of a row's rings, on the canvas; points are cut to whole numbers towards 0 first."""

    def folded(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = [[(float(int(p["x"])), float(int(p["y"]))) for p in r] for r in getattr(row, rings)]
                low = max(0, int(min((y for r in own for _, y in r), default=0)))
                high = min(height, int(max((y for r in own for _, y in r), default=0)) + 1)
                for y in range(low, high):
                    marks = fill([[(x, v - y) for x, v in r] for r in own], 1, width)[0]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
                    out += [(*(getattr(row, k) for k in keys), y, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "y", "x0", "x1"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, rings).mapInPandas(folded, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y int, x0 int, x1 int")


def contour_rows(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, points, area): a row by outer contour of each group's mask, as ``contours`` gives them. pixels: keys, y, x; a group is one component."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(group["y"].min()), int(group["x"].min())
        mask = np.zeros((int(group["y"].max()) - y0 + 1, int(group["x"].max()) - x0 + 1), bool)
        mask[group["y"] - y0, group["x"] - x0] = True
        own = [group[k].iloc[0] for k in keys]
        rows = [(*own, [{"x": x, "y": y} for x, y in ring], len(ring), abs(area(ring[:-1]))) for ring in contours(mask, offset=(float(x0), float(y0)))]
        return pd.DataFrame(rows, columns=[*keys, "ring", "points", "area"])

    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ring array<struct<x: double, y: double>>, points int, area double"
    return pixels.groupBy(*keys).applyInPandas(fold, schema)
