"""What queries may not do on large tables: send pixels, or tables that grow, to the driver; and that they give the same rows without it."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.operators import graph, metrics, morphology, polygons, runs
from tessella.plans import bindings as B
from tessella.plans import instances
from tessella.plans.tiling import GRID

K = B.KEYS


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_tables(spark, data, parameters):
    """AJI of each sample as the tables of pixels and runs give it, for one setting."""
    px = morphology.per_image(B.semantic(spark, data, True).select(*K, "y", "x", "cls"), K, morphology.watershed_rows(**parameters), "y int, x int, label int")
    true, pred = B.label_runs(spark, data), runs.to_runs(px, K)
    at, ap = runs.shapes(true, K), runs.shapes(pred, K)
    return {r["sample_id"]: r["aji"] for r in metrics.aggregated_jaccard(B.samples(spark, data), metrics.ious(runs.contingency(true, pred, K), at, ap, K), at, ap, K).collect()}


def test_tuning_folds_boxes_and_gives_what_the_tables_give(spark, data):
    assert "Generate" not in plan(plans.QUERIES["agg_21"](spark, data))  # no pixel is made outside of an image's fold
    settings = [
        {"min_distance": 3, "dilate_iter": 1, "connectivity": 2, "min_area": 0, "exclude_border": False, "ridge_level": 0.5},
        {"min_distance": 2, "dilate_iter": 0, "connectivity": 1, "min_area": 6, "exclude_border": True, "ridge_level": None},
    ]
    sides = [B.boxes(spark, data, pred).withColumn("pred", F.lit(pred)) for pred in (False, True)]
    got = {(r["setting"], r["sample_id"]): r["aji"] for r in morphology.tuned(sides[0].unionByName(sides[1]), K, settings, B.SIDE, B.SIDE).collect()}
    assert got == {(i, k): v for i, x in enumerate(settings) for k, v in by_tables(spark, data, x).items()}


def test_best_setting_is_the_first_best_of_all_and_makes_no_pixels(spark, data):
    best = plans.QUERIES["lim_01"](spark, data)
    assert "Generate" not in plan(best)
    order = {tuple(r): i for i, r in enumerate(itertools.product(*[GRID[k] for k in instances.SETTINGS]))}
    every = sorted(plans.QUERIES["agg_21"](spark, data).collect(), key=lambda r: (-r["mean_aji"], order[tuple(r)[:-1]]))
    assert [tuple(r) for r in best.collect()] == [tuple(every[0])]


@pytest.mark.parametrize("name", ["agg_21", "lim_01"])
def test_tuning_joins_and_broadcasts_nothing(spark, data, name):
    text = plans.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "Join" not in text


def test_tuning_of_samples_without_pixels(spark):
    rows = [(1, 5, 9, 9, 9, 9, False), (2, 7, 3, 3, 9, 9, False), (3, 8, 3, 3, 9, 9, True)]  # nothing, nothing predicted, nothing true
    boxes = spark.createDataFrame(rows, "sample_id long, label long, x0 int, y0 int, x1 int, y1 int, pred boolean")
    setting = {"min_distance": 1, "dilate_iter": 0, "connectivity": 1, "min_area": 0, "exclude_border": False, "ridge_level": None}
    assert {r["sample_id"]: r["aji"] for r in morphology.tuned(boxes, K, [setting], 16, 16).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("connectivity", [1, 2])
def test_parts_with_one_marker_are_filled_as_the_flood_fills_them(connectivity):
    rng = np.random.default_rng(7)
    for _ in range(40):
        mask = rng.random((18, 18)) < 0.6
        height = rng.integers(-4, 2, mask.shape).astype(float)
        markers = np.zeros(mask.shape, np.int32)
        at = np.flatnonzero(mask & (rng.random(mask.shape) < 0.06))
        markers.ravel()[at] = rng.permutation(len(at)) + 1
        whole = morphology.flood(height, markers, mask, connectivity)
        assert (morphology.flood(height, markers, mask, connectivity, morphology.label(mask, connectivity)) == whole).all()


def flooded(height, markers, mask, connectivity):
    """Pixel by pixel: of the pixels reached, the lowest one that came first goes on."""
    out, queue, n = markers.copy(), [(height[p], i, p) for i, p in enumerate(zip(*np.nonzero(markers), strict=True))], markers.size
    while queue:
        at = min(queue)
        queue.remove(at)
        for dy, dx in morphology.offsets(connectivity):
            p = (at[2][0] + dy, at[2][1] + dx)
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                out[p], n = out[at[2]], n + 1
                queue.append((height[p], n, p))
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
def test_floods_and_components_are_those_by_pixel(connectivity):
    rng = np.random.default_rng(11)
    for _ in range(60):
        mask = rng.random(rng.integers(1, 16, 2)) < rng.choice([0.3, 0.6, 1])
        height, markers = rng.integers(-4, 2, mask.shape).astype(float), np.zeros(mask.shape, np.int32)
        at = np.flatnonzero(rng.random(mask.shape) < 0.06)  # also out of the mask and on the edge
        markers.ravel()[at] = rng.permutation(len(at)) + 1
        assert (morphology.flood(height, markers, mask, connectivity) == flooded(height, markers, mask, connectivity)).all()
        parts, seen = morphology.label(mask, connectivity), np.zeros(mask.shape, np.int32)
        for y, x in np.argwhere(mask):
            if not seen[y, x]:
                one = np.zeros(mask.shape, np.int32)
                one[y, x] = seen.max() + 1
                seen += flooded(np.zeros(mask.shape), one, mask, connectivity)
        assert (parts == seen).all()


@pytest.mark.parametrize("name", ["geo_06", "geo_07", "geo_12"])
def test_overlaps_broadcast_nothing(spark, data, name):
    assert "Broadcast" not in plans.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_found_without_a_row_for_each_pixel(spark, data):
    assert "Generate" not in plan(plans.QUERIES["geo_07"](spark, data))


def test_lines_of_boxes_equal_those_of_their_pixels(spark):
    rng, boxes = np.random.default_rng(5), []
    for k in range(30):
        for i in (0, 1, 2, 3, 3, 4):  # two boxes of id 3 are one mask
            y, x, h, w = (int(v) for v in rng.integers([0, 0, 1, 1], [14, 14, 10, 10]))
            boxes.append((k, i, x, y, x + w, y + h))
    boxes += [(40, 1, 3, 3, 9, 9), (41, 1, 0, 0, 4, 4), (41, 2, 1, 1, 3, 3), (42, 5, -4, -6, 3, 2), (42, 6, 0, -2, 7, 6), (43, 1, 4, 4, 4, 9)]  # alone, inside, off the canvas, empty
    pixels = [(k, i, y, x) for k, i, x0, y0, x1, y1 in boxes for y in range(y0, y1) for x in range(x0, x1)]
    want = polygons.shared_lines(spark.createDataFrame(pixels, "root long, id long, y int, x int").distinct(), ["root"])
    got = polygons.box_lines(spark.createDataFrame(boxes, "root long, id long, x0 int, y0 int, x1 int, y1 int"), ["root"])
    assert got.schema == want.schema
    rows = sorted(map(tuple, got.collect()))
    assert {r[0] for r in rows} >= {42} and rows == sorted(map(tuple, want.collect()))


def test_rounds_of_overlap_components_broadcast_nothing(spark, data, monkeypatch):
    ran = []

    def cut(df, own=graph.cut):
        out = own(df)
        ran.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    monkeypatch.setattr(graph, "cut", cut)
    plans.QUERIES["geo_07"](spark, data)
    assert len(ran) > 2 and not any("Broadcast" in text for text in ran)


def whole_rasters(pixels, side):
    """Masks by id on the whole raster."""
    out = {i: np.zeros((side, side), bool) for i, _, _ in sorted(pixels)}
    for i, y, x in pixels:
        out[i][y, x] = True
    return out


def test_overlaps_by_own_boxes_equal_those_on_whole_rasters(spark):
    rng, side, rows, after, lines = np.random.default_rng(3), 24, [], set(), {}
    for k in range(25):
        pixels = set()
        for i in range(6):
            y, x, h, w = (int(v) for v in rng.integers([0, 0, 2, 2], [14, 14, 10, 10]))
            pixels |= {(i, a, b) for a in range(y, y + h) for b in range(x, x + w) if rng.random() < 0.9 or (a, b) == (y, x)}
        rows += [(k, *p) for p in sorted(pixels)]
        masks = whole_rasters(pixels, side)
        for i, a in masks.items():
            for j, b in masks.items():
                if i < j and (a & b).any() and (a & ~b).any() and (b & ~a).any():
                    line = polygons.smooth_line(polygons.taubin(polygons.dividing_line(a, b)))
                    lines[k, i, j] = (len(line), sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(line, line[1:], strict=False)))
        for i in masks:
            for j in masks:
                if i < j and (masks[i] & masks[j]).any():
                    a, b = masks[i], masks[j]
                    try:
                        masks[i], masks[j] = polygons.split_pair(a, b, 6)
                    except ValueError:
                        masks[i], masks[j] = (a, b & ~a) if a.sum() <= b.sum() else (a & ~b, b)
        after |= {(k, i, int(y), int(x)) for i, m in masks.items() for y, x in np.argwhere(m)}
    df = spark.createDataFrame(rows, "root long, id long, y int, x int")
    got = [tuple(r) for r in polygons.resolve(df, ["root"], 6).select("root", "id", "y", "x").collect()]
    assert len(got) == len(set(got)) and set(got) == after
    found = {(r["root"], r["i"], r["j"]): (r["points"], r["length"]) for r in polygons.shared_lines(df, ["root"]).collect()}
    assert found.keys() == lines.keys()
    assert all(found[k][0] == v[0] and found[k][1] == pytest.approx(v[1], rel=1e-12) for k, v in lines.items())


def test_merge_entries_read_runs_only(spark, data):
    text = plan(plans.QUERIES["mrg_01"](spark, data))
    assert "Join" not in text and "4095" not in text  # no row for each pixel of the canvas


def test_encoded_runs_go_on_in_the_next_row(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 6, 4), (1, 10, 2), (2, 5, 1)], "id long, start long, length long")
    read = runs.unrle(runs.encoded(spans, ["id"]), ["id"])
    assert sorted(map(tuple, read.collect())) == [(1, 0, 3), (1, 6, 4), (1, 10, 2), (2, 5, 1)]
    assert sorted(map(tuple, runs.span_shapes(read, ["id"], 8).collect())) == [(1, 9, 0, 0, 7, 1), (2, 1, 5, 0, 5, 0)]
