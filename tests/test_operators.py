"""Goldens and properties of single operators on small tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.operators import catalog, grid, metrics, morphology, polygons, raster, runs, series, spatial
from tessella.operators.graph import components

K = ["sample_id"]


def label_map(spark, *samples):
    """Rasters as pixels; the samples are numbered."""
    rows = [(i, y, x, v) for i, m in enumerate(samples) for y, row in enumerate(m) for x, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "sample_id long, y int, x int, label long")


def evaluate(spark, true, pred, tau=0.5):
    t, p = (runs.to_runs(label_map(spark, m), K) for m in (true, pred))
    at, ap = runs.shapes(t, K), runs.shapes(p, K)
    iou = metrics.ious(runs.contingency(t, p, K), at, ap, K)
    samples = spark.createDataFrame([(0,)], "sample_id long")
    n = samples.join(at.groupBy(*K).agg(F.count("*").alias("n_true")), K, "left").join(ap.groupBy(*K).agg(F.count("*").alias("n_pred")), K, "left").fillna(0)
    taus = spark.createDataFrame([(0, tau)], "i int, tau double")
    prf = metrics.precision_recall(n, metrics.one_to_one(iou, taus, K), taus, K).first()
    return prf, metrics.aggregated_jaccard(samples, iou, at, ap, K).first()["aji"], metrics.mask_ap(samples, at, ap.withColumn("score", F.lit(1.0)), iou, K).first()


Z = [[0] * 4] * 4
ONE = [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
TWO = [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 2, 2], [0, 0, 2, 2]]


@pytest.mark.parametrize(
    ("true", "pred", "prf", "aji"),
    [
        (TWO, TWO, (1, 1, 1), 1),
        (Z, Z, (1, 1, 1), 1),
        (Z, ONE, (0, 0, 0), 0),
        (ONE, Z, (0, 0, 0), 0),
        (ONE, TWO, (0.5, 1, 2 / 3), 0.5),
        (TWO, ONE, (1, 0.5, 2 / 3), 0.5),
        ([[1, 1, 0, 2, 2]] * 2, [[1, 1, 0, 1, 1]] * 2, None, 1 / 3),
    ],
)
def test_instance_metrics(spark, true, pred, prf, aji):
    got, got_aji, _ = evaluate(spark, true, pred)
    if prf:
        assert (got["precision"], got["recall"], got["f1"]) == pytest.approx(prf)
    assert got_aji == pytest.approx(aji)


def test_one_prediction_over_two_truths_misses_both(spark):
    true = [[1] * 3 + [0] * 2 + [2] * 3] * 3 + [[0] * 8] * 5
    got, _, _ = evaluate(spark, true, [[1] * 8] * 8)
    assert got["tp"] == 0 and got["precision"] == 0 and got["recall"] == 0


def test_mask_ap_conventions(spark):
    ap = evaluate(spark, TWO, TWO)[2]
    assert ap["ap"] == pytest.approx(1) and ap["ap50"] == pytest.approx(1) and ap["apm"] == -1 and ap["ar1"] == pytest.approx(0.5)
    none = evaluate(spark, Z, ONE)[2]
    assert none["ap"] == -1 and none["ar100"] == -1
    missed = evaluate(spark, ONE, Z)[2]
    assert missed["ap"] == 0 and missed["ar100"] == 0 and missed["apl"] == -1


def test_sweep_is_floating_point_steps(spark):
    taus = [r["tau"] for r in metrics.sweep(spark).orderBy("i").collect()]
    assert len(taus) == 10 and taus == [0.5 + i * (0.55 - 0.5) for i in range(10)] and taus[2] == 0.6000000000000001


def test_greedy_matching_equals_the_count_on_disjoint_maps(spark):
    t, p = (runs.to_runs(label_map(spark, m), K) for m in (TWO, [[1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 2, 2], [0, 0, 2, 2]]))
    iou = metrics.ious(runs.contingency(t, p, K), runs.shapes(t, K), runs.shapes(p, K), K)
    taus = spark.createDataFrame([(0, 0.5)], "i int, tau double")
    assert metrics.greedy_matches(iou, K, 0.5).count() == metrics.one_to_one(iou, taus, K).first()["tp"] == 2


def test_means(spark):
    v = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.7), ("m", "c", -1.0), ("n", "a", -1.0), ("m", "d", float("nan"))], "k string, s string, value double")
    got = {r["k"]: r["mean"] for r in metrics.sentinel_means(v, ["k"]).collect()}
    assert got["m"] == pytest.approx(0.6) and got["n"] is None
    nan = spark.createDataFrame([("x", "a", float("nan")), ("x", "b", float("nan")), ("y", "a", 1.0)], "k string, s string, value double")
    rows = metrics.nan_means(nan, ["k"], "s").collect()
    assert [r["k"] for r in rows] == ["x"] and rows[0]["mean"] != rows[0]["mean"]
    ci = metrics.mean_with_interval(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, value double"), ["k"]).collect()
    by = {r["k"]: r["ci"] for r in ci}
    assert by["b"] == 0 and by["a"] == pytest.approx(12.706 * 2**0.5 / 2**0.5)


@pytest.mark.parametrize(("size", "patch", "stride", "want"), [(10, 4, 3, [0, 3, 6]), (11, 4, 3, [0, 3, 6, 7]), (3, 4, 2, [0]), (4, 4, 2, [0])])
def test_window_starts(spark, size, patch, stride, want):
    assert spark.range(1).select(arrays.window_starts(F.lit(size), patch, stride).alias("s")).first()["s"] == want


@pytest.mark.parametrize(("patch", "stride"), [(2, 3), (0, 1), (4, 0)])
def test_window_starts_reject(patch, stride):
    with pytest.raises(ValueError):
        arrays.window_starts(F.lit(5), patch, stride)


def test_tiles_and_patches(spark):
    c = spark.createDataFrame([(0, 5, 5)], "sample_id long, h int, w int")
    t = sorted(tuple(r) for r in grid.tiles(c, 4).select("y0", "y1", "x0", "x1").collect())
    assert t == [(0, 4, 0, 4), (0, 4, 4, 5), (4, 5, 0, 4), (4, 5, 4, 5)]
    region = spark.createDataFrame([(0, 5, 0, 5)], "y0 int, y1 int, x0 int, x1 int")
    p = sorted((r["py0"], r["px0"]) for r in grid.patches(region, 4, 3).collect())
    assert p == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_split_is_a_partition(spark):
    rows = [(0, i, c) for i, c in enumerate([0.0, 0.12, 0.18, 0.25, 0.31, 0.2, 0.5, 0.05])]
    s = grid.stratified_split(spark.createDataFrame(rows, "sample_id long, tile int, coverage double"), K, "tile", 0.5, 4).collect()
    assert sorted(r["tile"] for r in s) == list(range(8))
    val = {r["tile"] for r in s if r["split"] == "val"}
    assert len(val) == 3 and not val & {0, 7}


PIXELS = st.lists(st.booleans(), min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(PIXELS)
def test_run_lengths_round_trip(spark, flags):
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "sample_id long, i int, f boolean")
    encoded = runs.rle(df, K, ["i"], "f")
    counts = encoded.first()["counts"]
    assert sum(counts) == len(flags) and (counts[0] == 0) == flags[0]
    got = {i for r in runs.unrle(encoded, K).collect() for i in range(r["start"], r["start"] + r["length"])}
    assert got == {i for i, f in enumerate(flags) if f}


def test_doubled_leading_zero_is_repaired(spark):
    df = spark.createDataFrame([(0, [0, 0, 3, 2])], "sample_id long, counts array<bigint>")
    fixed = runs.unrle(df, K).collect()
    assert [(r["start"], r["length"]) for r in fixed] == [(0, 3)]


def test_connected_components(spark):
    m = [[1, 1, 0, 1, 1], [1, 1, 0, 1, 1], [0, 0, 1, 0, 0]]
    r = runs.to_runs(label_map(spark, m), K)
    four = runs.shapes(runs.connected_components(r, K), K, "comp")
    assert sorted((x["comp"], x["area"]) for x in four.collect()) == [(1, 4), (2, 4), (3, 1)]
    assert runs.connected_components(r, K, True).select("comp").distinct().count() == 1


def test_components_of_groups(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 2, 3), (0, 9, 8)], "sample_id long, a long, b long")
    got = sorted(tuple(r) for r in components(e, K).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 8, 8), (0, 9, 8), (1, 2, 2), (1, 3, 2)]


def test_suppression_keeps_pairs_apart(spark):
    b = spark.createDataFrame([(0, 1, 0, 0, 4, 4, 0.9), (0, 2, 1, 0, 5, 4, 0.8), (0, 3, 2, 0, 6, 4, 0.7), (0, 4, 20, 20, 22, 22, 0.1)], "sample_id long, id long, x0 int, y0 int, x1 int, y1 int, score double")
    kept = {r["id"] for r in spatial.suppress(b, spatial.meeting_boxes(b, K), K, 0.5).collect()}
    assert kept == {1, 3, 4}


def test_filters_are_strict(spark):
    s = spark.createDataFrame([(10,), (9,)], "area int")
    assert [r["area"] for r in spatial.keep_small(s, 100, 0.1).collect()] == [9]
    assert [r["area"] for r in spatial.keep_below(s, 10).collect()] == [9]
    assert spatial.keep_small(s, 0, 0.1).count() == 2 and spatial.keep_below(s, 0).count() == 2


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_rings(spark):
    square = ring((2, 2), (2, 0), (0, 0), (0, 2), (2, 2))
    got = one(spark, arrays.canonical_ring(square))
    assert [(p["x"], p["y"]) for p in got] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    text = F.concat(F.lit("0 "), F.array_join(F.transform(arrays.flat_ring(arrays.canonical_ring(square)), lambda v: arrays.decimal_text(v / 4)), " "))
    assert one(spark, text) == "0 0.0 0.0 0.5 0.0 0.5 0.5 0.0 0.5"
    f = lambda v: F.lit(float(v))
    clipped = arrays.clip_ring(ring((2, 2), (6, 2), (6, 6), (2, 6)), f(4), f(4), f(8), f(8))
    assert one(spark, arrays.shoelace(arrays.canonical_ring(clipped))) == 4
    assert one(spark, F.size(arrays.clip_ring(ring((0, 0), (1, 0), (1, 1)), f(4), f(4), f(8), f(8)))) == 0
    triangle = arrays.clip_ring(ring((0, 0), (4, 0), (0, 4)), f(0), f(0), f(2), f(2))
    assert one(spark, arrays.shoelace(triangle)) == pytest.approx(4)


def test_polygon_outlines():
    mask = np.zeros((4, 7), bool)
    mask[0:2, 1:3] = True
    rings = polygons.outlines(mask)
    assert len(rings) == 1 and abs(polygons.area(rings[0])) == 4 and len(rings[0]) == 4
    mask[2:4, 3:5] = True  # meets the first in a corner
    assert sorted(abs(polygons.area(r)) for r in polygons.outlines(mask)) == [4, 4]
    hole = np.ones((3, 3), bool)
    hole[1, 1] = False
    assert abs(sum(polygons.area(r) for r in polygons.outlines(hole))) == 8
    assert (polygons.fill(polygons.outlines(hole), 3, 3) == hole).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=5, max_size=5), min_size=1, max_size=6))
def test_outlines_fill_back(rows):
    mask = np.array(rows)
    rings = polygons.outlines(mask)
    assert (polygons.fill(rings, *mask.shape) == mask).all()
    assert abs(sum(polygons.area(r) for r in rings)) == mask.sum()


def test_overlap_split():
    a, b = np.zeros((6, 10), bool), np.zeros((6, 10), bool)
    a[:, :6], b[:, 4:] = True, True
    x, y = polygons.split_pair(a, b, 3)
    assert not (x & y).any() and ((x | y) == (a | b)).all() and x.sum() == 30 and y.sum() == 30
    x, y = polygons.split_pair(a, b, 100)
    assert (x == a).all() and (y == (b & ~a)).all()
    with pytest.raises(ValueError):
        polygons.split_pair(a, a, 3)


def test_lines():
    line = polygons.smooth_line([(0, 0), (1, 1), (2, 0)])
    assert line[0] == (0, 0) and line[-1] == (2, 0) and max(y for _, y in line) < 1
    assert polygons.taubin([(0, 0), (1, 2), (2, 0)])[0] == (0, 0)
    assert polygons.simplify([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]
    assert polygons.nearest([(0, 0), (3, 3)], (2, 2)) == (3, 3)
    assert polygons.crossing((0, 0), (2, 2), (0, 2), (2, 0)) == (1, 1)
    assert not polygons.is_simple([(0, 0), (2, 2), (2, 0), (0, 2)]) and polygons.is_simple([(0, 0), (2, 0), (2, 2)])
    assert polygons.snap([(0.0000004, 0), (0, 0), (1, 1)]) == [(0, 0), (1, 1)]


def discs():
    y, x = np.mgrid[0:31, 0:41]
    return (((y - 15) ** 2 + (x - 10) ** 2 <= 64) | ((y - 15) ** 2 + (x - 30) ** 2 <= 64)).astype(int)


def test_watershed_of_ridges_and_levels():
    cls = np.ones((12, 16), int)
    cls[:, 6] = 2
    out = morphology.watershed(cls, 4, 0, 1, 0, False, None)
    left, right = set(np.unique(out[:, :6])) - {0}, set(np.unique(out[:, 7:])) - {0}
    assert left and right and not left & right and not out[:, 6].any()
    interior, d = cls == 1, morphology.interior_distances(cls == 1)
    raised = morphology.elevation(interior, morphology.dilate(cls == 2, 1), d, None)
    assert (raised[:, 5:8] == 2 * d.max() + 1).all() and (raised[:, :5] == -d[:, :5]).all()
    for level in (0.5, 5.0):
        assert (morphology.elevation(interior, morphology.dilate(cls == 2, 1), d, level)[:, 5:8] == level).all()
    # a raised boundary is flooded last: its pixels go to whoever comes first over it, not to the nearest deep one
    row = np.ones((1, 9), int)
    height = np.array([[-1, -1, -1, 9, 9, -1, -1, -1, -1]], float)
    markers = np.zeros((1, 9), np.int32)
    markers[0, 0], markers[0, 8] = 1, 2
    assert morphology.flood(height, markers, row == 1, 1).tolist() == [[1, 1, 1, 1, 2, 2, 2, 2, 2]]


def test_watershed_with_dilation_brute_force():
    r = np.random.default_rng(4)
    for _ in range(20):
        cls = r.choice([0, 1, 1, 1, 2], (14, 15))
        for dilate_iter, connectivity, ridge in ((0, 1, None), (1, 1, 0.5), (1, 2, 5.0), (2, 2, None)):
            out = morphology.watershed(cls, 2, dilate_iter, connectivity, 0, False, ridge)
            interior = cls == 1
            found = morphology.peaks(morphology.interior_distances(interior), 2, interior, False)
            # what can be reached from a peak is labelled, nothing else is
            reach = np.zeros(cls.shape, bool)
            todo = list(found)
            while todo:
                y, x = todo.pop()
                if reach[y, x]:
                    continue
                reach[y, x] = True
                todo += [(y + a, x + b) for a, b in morphology.offsets(connectivity) if 0 <= y + a < 14 and 0 <= x + b < 15 and interior[y + a, x + b]]
            assert ((out > 0) == reach).all() and all(out[p] == i for i, p in enumerate(found, 1))


def test_peaks_and_connectivity():
    height = np.zeros((7, 12))
    height[3, 2] = height[3, 5] = 4
    height[3, 9] = 3
    mask = np.ones_like(height, bool)
    assert morphology.peaks(height, 3, mask, False) == [(3, 2), (3, 5), (3, 9)]  # exactly the distance apart is far enough
    assert morphology.peaks(height, 4, mask, False) == [(3, 2)]
    assert morphology.peaks(height, 3, mask, True) == [(3, 5)]
    assert len(morphology.offsets(1)) == 4 and len(morphology.offsets(2)) == 8
    with pytest.raises(ValueError, match="1 or 2"):
        morphology.offsets(3)
    diagonal = np.eye(4, dtype=int)
    assert morphology.watershed(diagonal, 2, 0, 2, 0, True, None).max() == 4  # without peaks components are four-connected


def test_watershed_of_a_large_image_in_little_memory():
    import tracemalloc

    r = np.random.default_rng(0)
    cls = np.ones((1024, 1024), np.int8)
    cls[:, ::37] = 2
    cls[::41] = 2
    cls[r.integers(0, 1024, 400), r.integers(0, 1024, 400)] = 0
    tracemalloc.start()
    out = morphology.watershed(cls, 5, 1, 1, 10, False, None)
    assert tracemalloc.get_traced_memory()[1] < 300e6 and out.max() > 500
    tracemalloc.stop()


def test_distances_equal_brute_force():
    r = np.random.default_rng(2)
    for share in (0.02, 0.3, 0.9, 0.999):
        mask = r.random((17, 23)) < share
        if mask.all():
            mask[3, 4] = False
        unset = np.argwhere(~mask)
        want = np.array([[0 if not mask[y, x] else np.sqrt(((unset - (y, x)) ** 2).sum(1).min()) for x in range(23)] for y in range(17)])
        assert np.allclose(morphology.distances(mask), want)
    assert np.isinf(morphology.distances(np.ones((4, 5), bool))).all()


def test_watershed_separates_discs():
    out = morphology.watershed(discs(), 5, 0, 4, 0, False, None)
    assert out[15, 10] and out[15, 30] and out[15, 10] != out[15, 30]
    assert ((out > 0) == (discs() > 0)).all()


def test_distances_equal_brute_force():
    mask = np.random.default_rng(2).random((9, 11)) < 0.7
    zeros = np.argwhere(~mask)
    want = np.array([[min(np.hypot(y - a, x - b) for a, b in zeros) if mask[y, x] else 0 for x in range(11)] for y in range(9)])
    assert np.allclose(morphology.distances(mask), want)


def test_dilation_equals_the_table_form(spark):
    mask = np.random.default_rng(3).random((8, 8)) < 0.1
    df = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(mask)] or [(0, 0, 0)], "sample_id long, y int, x int")
    got = {(r["y"], r["x"]) for r in runs.dilate(df, K, 8, 8, 2).collect()}
    assert got == {(int(y), int(x)) for y, x in np.argwhere(morphology.dilate(mask, 2))}


def test_blend_stack_split(spark):
    px = spark.createDataFrame([(0, 0, 0, 255), (0, 0, 0, 10), (0, 0, 1, 128), (0, 0, 1, 128)], "g long, y int, x int, v int")
    got = {r["x"]: r["v"] for r in raster.screen_blend(px, ["g"]).collect()}
    assert got == {0: 255, 1: int(255 * (1 - (1 - 128 / 255) ** 2))}
    images = spark.createDataFrame([(0, n, 0, 0, c, 10 * k + c) for k, n in enumerate(["a_first", "b_second"]) for c in range(3)], "g long, name string, y int, x int, c int, v int")
    stacked = raster.stack_channels(images, ["g"], "name")
    assert {r["c"]: r["v"] for r in stacked.collect()} == {0: 0, 1: 1, 2: 2, 3: 10, 4: 11, 5: 12}
    assert {(r["image"], r["c"]): r["v"] for r in raster.split_channels(stacked).collect()} == {(k, c): 10 * k + c for k in range(2) for c in range(3)}


def test_tint(spark):
    px = spark.createDataFrame([(c, cls, 0.0) for c in range(3) for cls in range(3)], "c int, cls int, v double")
    assert {(r["c"], r["cls"]): r["v"] for r in raster.tint(px).collect()} == {(c, k): 0.4 if c == 0 and k else 0 for c in range(3) for k in range(3)}


def test_smoothing(spark):
    rows = [(0, i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3, 9, 4, 7, 6])]
    df = spark.createDataFrame(rows, "g long, i int, v double")

    def once(x, w):
        k, h = series.kernel(w), w // 2
        wide = np.pad(x, h, mode="edge")
        return np.array([np.dot(wide[j : j + w], k) for j in range(len(x))])

    x = np.array([r[2] for r in rows])
    for w, want in ((1, x), (3, once(x, 3)), (5, once(once(x, 5), 5)), (11, np.full(9, x.mean()))):
        got = [r["smooth"] for r in series.smooth(df, ["g"], ["i"], "v", w).orderBy("i").collect()]
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        series.smooth(df, ["g"], ["i"], "v", 4)


def test_log_lines(spark):
    lines = ["13/13 - 1049s - accuracy: 0.7889 - loss: 0.7008 - val_accuracy: 0.8277 - val_loss: 0.6686", "nothing", "accuracy: 1 - loss: 2e-3 - val_accuracy: 3"]
    got = series.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r)[1:] for r in got] == [(0.7889, 0.7008, 0.8277, 0.6686)]


def test_catalogue(spark):
    files = spark.createDataFrame([("a", "x", "a_x"), ("a", "y", "a_y"), ("b", "x", "b_x")], "stem string, suffix string, path string")
    assert catalog.pair_files(files.where("stem = 'a'"), ["x", "y"]).first()["images"] == ["a_x", "a_y"]
    with pytest.raises(Exception, match="no file with suffix y"):
        catalog.pair_files(files, ["x", "y"]).collect()
    masks = spark.createDataFrame([("a", "tif", "a.tif"), ("a", "png", "a.png")], "stem string, ext string, path string")
    assert catalog.pick_mask(masks, ["png", "tif"]).first()["mask"] == "a.png"
    with pytest.raises(Exception, match="not registered"):
        catalog.lookup(files, files.where("stem = 'a'").select("stem", F.lit("p").alias("v")).distinct(), "stem", "v").collect()
    key = lambda *x: one(spark, catalog.cache_key(*map(F.lit, x)))
    assert key("a", "1") == key("a", "1") and key("a", "1") != key("a", "2") and len(key("a")) == 16
    p = spark.createDataFrame([(5, True, None, 0.5)], "min_distance int, exclude_border boolean, min_area int, ridge_level double")
    assert [r["token"] for r in catalog.settings_tokens(p, ["min_distance", "exclude_border", "min_area", "ridge_level"]).orderBy("pos").collect()] == ["--min-distance", "5", "--exclude-border", "--ridge-level", "0.5"]


def test_labels_and_keys(spark):
    f = spark.createDataFrame([("a b+c-d_e!",), ("!!",), ("__x__",)], "v string")
    assert [r["l"] for r in f.select(arrays.clean_label(F.col("v")).alias("l")).collect()] == ["a_b+c-d_e", "model", "x"]
    assert [r["l"] for r in f.select(arrays.clean_key(F.col("v")).alias("l")).collect()] == ["a_b_c_d_e_", "_", "__x__"]
    assert one(spark, arrays.decimal_text(F.lit(0.5))) == "0.5" and one(spark, arrays.decimal_text(F.lit(2.0))) == "2.0"


def test_shared_lines_and_pieces():
    a, b = np.zeros((6, 10), bool), np.zeros((6, 10), bool)
    a[:, :6], b[:, 4:] = True, True
    line = polygons.dividing_line(a, b)
    assert len(line) == 6 and {x for x, _ in line} == {5.0}
    assert polygons.snap_ends([(1, 1), (1, 2)], [(1, 0), (1, 3)]) == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert polygons.snap_ends([(1, 1), (1, 2)], [(1, 0), (9, 9)]) == [(1, 0), (1, 1), (1, 2), (9, 9)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    parts = polygons.split_by_line(square, [(1.0, -1.0), (1.0, 5.0)])
    assert sorted(abs(polygons.area(p)) for p in parts) == [4, 12]
    bent = polygons.split_by_line(square, [(1.0, -1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 5.0)])
    assert sorted(round(abs(polygons.area(p)), 9) for p in bent) == [6, 10]
    assert polygons.split_by_line(square, [(9.0, -1.0), (9.0, 5.0)]) == [square]
    assert polygons.assign_pieces(parts, [(-2, 0), (-1, 0), (-1, 4), (-2, 4)], [(5, 0), (6, 0), (6, 4), (5, 4)]) == (["a", "b"] if abs(polygons.area(parts[0])) == 4 else ["b", "a"])
    assert polygons.inside(square, (1, 1)) and not polygons.inside(square, (5, 1))


def test_fixed_noise_and_inputs(spark):
    lines = ["Unable to register cuDNN factory: x", "gpu_timer.cc:114] Skipping the delay kernel, measurement accuracy will be reduced", "x (ignoring feature)", "Epoch 1/50", ""]
    kept = catalog.drop_noise(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(r["value"] for r in kept) == ["", "Epoch 1/50"]
    got = spark.createDataFrame([("unet_PPL+AllPPX.keras",), ("unet_PPLPPXblend",), ("x",)], "f string").select(catalog.infer_inputs(F.col("f")).alias("i")).collect()
    assert [r["i"] and r["i"]["num_inputs"] for r in got] == [7, 1, None]
    assert one(spark, catalog.run_name(F.lit("PPL+AllPPX/x/tune.csv"))) == "PPL+XPL-Stack"


def test_seeded_split_goldens():
    assert grid.seeded_split([0, 0.12, 0.18, 0.25, 0.31], 0.5, 7, 4) == ([0, 2, 4], [1, 3])
    for fraction in (0.34, 0.99):
        assert grid.seeded_split([0.11, 0.12, 0.13, 0.0], fraction, 0, 4) == ([1, 3], [0, 2])
    assert grid.seeded_split(np.array([np.nextafter(0.1, 0), np.nextafter(0.1, 1), 0.2]), 0.5, 0, 4) == ([0, 2], [1])
    for bad in ([0, 0.09, np.float32(0.1)], [0.2, float("nan"), 0.3], [[0.2, 0.3]]):
        with pytest.raises(ValueError):
            grid.seeded_split(bad, 0.5, 0, 4)
    rng = np.random.default_rng(5)
    for seed in range(20):
        cover = rng.random(30).astype(np.float32)
        train, val = grid.seeded_split(cover, 0.25, seed, 4)
        n = int((cover >= 0.1).sum())
        assert sorted(train + val) == list(range(30)) and len(val) == int(np.ceil(n * 0.25)) and (cover[val] >= 0.1).all()


def test_clip_equals_the_expression(spark):
    from tessella.operators import clip

    r = np.random.default_rng(5)
    rows = []
    for i in range(200):
        n = int(r.integers(3, 9))
        angle = np.sort(r.random(n)) * 2 * np.pi
        rows.append((i, [(float(x), float(y)) for x, y in np.stack([np.cos(angle), np.sin(angle)], 1) * r.random() * 4 + r.random(2) * 4], 1.0, 1.0, 4.0, 3.0))
    rows.append((999, [], 0.0, 0.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double")
    got = {x["id"]: [tuple(p) for p in x["ring"]] for x in clip.clip_rings(df, "ring", ["x0", "y0", "x1", "y1"]).collect()}
    want = df.select("id", arrays.canonical_ring(arrays.clip_ring(F.col("ring"), *map(F.col, ("x0", "y0", "x1", "y1")))).alias("ring")).collect()
    for x in want:
        a, b = got.get(x["id"], []), [tuple(p) for p in x["ring"] or []]
        assert abs(polygons.area(a) if a else 0) == pytest.approx(abs(polygons.area(b)) if b else 0, abs=1e-9)
        assert all(1 - 1e-9 <= u <= 4 + 1e-9 and 1 - 1e-9 <= v <= 3 + 1e-9 for u, v in a) and (not a or (a[0] == min(a) and polygons.area(a) >= 0))


def test_polygons_with_holes_are_clipped(spark):
    from tessella.operators import clip

    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, [square(0.0, 8.0), square(2.0, 4.0), square(6.0, 7.0)]), (2, [square(9.0, 12.0), square(10.0, 11.0)]), (3, []), (4, None)]
    df = spark.createDataFrame([(*x, 0.0, 0.0, 5.0, 3.0) for x in rows], "id int, rings array<array<struct<x:double,y:double>>>, x0 double, y0 double, x1 double, y1 double")
    got = clip.clip_polygons(df, "rings", ["x0", "y0", "x1", "y1"]).collect()
    assert [x["id"] for x in got] == [1] and [abs(polygons.area([tuple(p) for p in r])) for r in got[0]["rings"]] == [15, 2]


def test_intersects_and_shrink():
    square, far = [(0, 0), (4, 0), (4, 4), (0, 4)], [(9, 9), (10, 9), (10, 10)]
    assert polygons.intersects(square, [(1, 1), (2, 1), (2, 2), (1, 2)]) and polygons.intersects(square, [(3, -1), (5, 1), (3, 9)]) and polygons.intersects(square, square)
    assert not polygons.intersects(square, far) and not polygons.intersects(square, [(4, 0), (8, 0), (8, 4), (4, 4)])
    assert abs(polygons.area(polygons.shrink_convex(square, 1))) == 4 and polygons.shrink_convex(square, 2) == []
    triangle = [(0, 0), (6, 0), (0, 8)]  # of inradius 2
    assert abs(polygons.area(polygons.shrink_convex(triangle, 1))) == pytest.approx(6) and polygons.shrink_convex(triangle, 2.1) == []


def test_contours(spark):
    mask = np.zeros((20, 24), int)
    mask[2:18, 3:9] = 1
    mask[5:8, 5:7] = 0
    y, x = np.mgrid[0:20, 0:24]
    mask[(y - 10) ** 2 + (x - 16) ** 2 <= 36] = 1
    found = polygons.contours(mask, offset=(100.0, 50.0))
    assert len(found) == 2 and all(r[0] == r[-1] for r in found)
    box = min(found, key=len)
    assert set(box) == {(103.0, -52.0), (109.0, -52.0), (109.0, -68.0), (103.0, -68.0)}  # the hole isn't an outer contour
    round_ = max(found, key=len)
    assert abs(abs(polygons.area(round_[:-1])) - (mask[:, 10:] > 0).sum()) < 3
    px = spark.createDataFrame([(0, 1, int(a), int(b)) for a, b in np.argwhere(mask[:, :9])], "sample_id long, comp int, y int, x int")
    row = polygons.contour_rows(px, [*K, "comp"]).collect()
    assert [(r["points"], r["area"]) for r in row] == [(5, 96.0)] and row[0]["ring"][0]["y"] < 0


def test_filled_polygons(spark):
    rings = [[(1.9, 1.0), (9.0, 1.0), (9.0, 8.0), (1.0, 8.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]]
    df = spark.createDataFrame([(1, rings), (2, [[(-3.0, -2.0), (2.0, -2.0), (2.0, 99.0)]]), (3, [])], "label long, rings array<array<struct<x:double,y:double>>>")
    px = {(r["label"], r["y"], x) for r in polygons.filled(df, ["label"], "rings", 10, 10).collect() for x in range(r["x0"], r["x1"])}
    whole = [[(float(int(a)), float(int(b))) for a, b in r] for r in rings]
    assert {(y, x) for i, y, x in px if i == 1} == {tuple(p) for p in np.argwhere(polygons.fill(whole, 10, 10))} and len([1 for i, _, _ in px if i == 1]) == 8 * 7 - 9
    assert {(y, x) for i, y, x in px if i == 2} == {tuple(p) for p in np.argwhere(polygons.fill([[(-3.0, -2.0), (2.0, -2.0), (2.0, 99.0)]], 10, 10))}


def test_predictions_by_patches(spark):
    v = np.random.default_rng(6).random((8, 8))
    df = spark.createDataFrame([(1, int(y), int(x), float(v[y, x])) for y in range(8) for x in range(8)], "vec_id long, y int, x int, v double")

    def model(p):  # says more of a pixel the brighter its patch is
        return np.stack([p, p.mean((1, 2))[:, None, None] * np.ones_like(p)], -1)

    hann = lambda i: 0.5 - 0.5 * np.cos(2 * np.pi * i / 3)
    score, weight = np.zeros((8, 8, 2)), np.zeros((8, 8, 1))
    for a in (0, 2, 4):
        for b in (0, 2, 4):
            w = np.maximum(hann(np.arange(4))[:, None] * hann(np.arange(4))[None], 1e-4)[..., None]
            score[a : a + 4, b : b + 4] += model(v[None, a : a + 4, b : b + 4])[0] * w
            weight[a : a + 4, b : b + 4] += w
    got = {(r["y"], r["x"]): r["cls"] for r in raster.predict_tiled(df, ["vec_id"], 8, 4, 2, model, 2).collect()}
    assert got == {(y, x): int((score / weight)[y, x].argmax()) for y in range(8) for x in range(8)}
