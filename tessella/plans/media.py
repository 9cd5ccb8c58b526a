"""Queries that write files of the real formats to the shared folder and read them back through the readers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.operators import catalog, raster, runs
from tessella.plans import bindings as B
from tessella.plans.registry import query
from tessella.plans.tiling import N, SPLIT, WITH, split
from tessella.sources import formats, readers, shared, writers

K, V = B.KEYS, ["vec_id"]
RASTER, BOXES = f"WITH {B.RASTER}, ", f"WITH {B.SQL}, "
#: Rasters that one file holds, by channel.
PER = 64


def number(path: str = "path"):
    """The number in a file's name."""
    return F.regexp_extract(path, r"(\d+)[^/\d]*$", 1).cast("long")


def pictures(s: SparkSession, d: str, encode, channels: int = 1, value: str = "u") -> str:
    """A folder of files, each of ``PER`` rasters: encode gives name and bytes of a number and an array (rasters, 8, 8, channels)."""

    def made(rows: pa.Table) -> pa.Table:
        g = rows["g"][0].as_py()
        place, c, y, x = (rows[k].to_numpy() for k in ("k", "ch", "y", "x"))
        pixels = np.zeros((int(place.max()) + 1, 8, 8, channels), np.int64)
        pixels[place, y, x, c] = rows["v"].to_numpy()
        name, body = encode(g, pixels)
        return pa.table({"name": [name], "content": pa.array([body], pa.binary())})

    r = B.raster(s, d).select(F.expr(f"vec_id div {PER * channels}").alias("g"), F.expr(f"(vec_id div {channels}) % {PER}").cast("int").alias("k"), (F.col("vec_id") % channels).cast("int").alias("ch"), "y", "x", F.expr(value).cast("long").alias("v"))
    folder = shared.folder(s)
    writers.write_files(r.groupBy("g").applyInArrow(made, "name string, content binary"), folder)
    return folder


def stacked(pixels: np.ndarray) -> np.ndarray:
    return pixels.reshape(-1, *pixels.shape[2:])


def rasters_of(s, d, px: DataFrame, channels: int = 1) -> DataFrame:
    """(vec_id, y, x, v) from pixels of stacked rasters (path, y, x, ch, v); the last file may lack some channels."""
    vec = (number() * PER + F.expr("y div 8")) * channels + F.col("ch")
    return px.select(vec.cast("long").alias("vec_id"), (F.col("y") % 8).cast("int").alias("y"), "x", "v").join(B.table(s, d, "embeddings").select("vec_id"), "vec_id", "left_semi")


def png(g: int, pixels: np.ndarray) -> tuple[str, bytes]:
    return f"{g}.png", formats.encode_png(stacked(pixels))


@query("src_02", f"{RASTER} x AS (SELECT 1) SELECT vec_id, y, x, u / 255.0::DOUBLE AS v FROM rast")
def src_02(s, d):
    """Colour images as shares of the greatest value."""
    px = readers.block_pixels(readers.rasters(s, pictures(s, d, png, 3)))
    return rasters_of(s, d, px, 3).withColumn("v", F.col("v") / F.lit(255.0))


def _masks(s, d, encode) -> DataFrame:
    px = readers.block_pixels(readers.one_band(readers.rasters(s, pictures(s, d, encode, value="u % 3"))))
    return rasters_of(s, d, px).select(*V, "y", "x", catalog.require(F.col("v").isin(0, 1, 2), F.col("v"), "a mask's classes are 0, 1 and 2").alias("cls"))


@query("src_03", f"{RASTER} x AS (SELECT 1) SELECT vec_id, y, x, u % 3 AS cls FROM rast")
def src_03(s, d):
    """Masks of one band from PNG files."""
    return _masks(s, d, png)


@query("src_06", f"{RASTER} x AS (SELECT 1) SELECT vec_id, y, x, u % 3 AS cls FROM rast")
def src_06(s, d):
    """Semantic rasters of two dimensions from TIFF files of whole numbers, in tiles."""
    return _masks(s, d, lambda g, p: (f"{g}.tif", formats.encode_tiff(stacked(p).astype(np.int32), tile=16, predictor=2)))


CHANNELS = "SELECT vec_id // 3 AS grp, (vec_id % 3)::INTEGER AS c, y, x, u AS v FROM rast"


def _channels_first(s, d, folder: str) -> DataFrame:
    b = readers.channels_first(readers.rasters(s, folder)).select("path", F.col("channel").alias("ch"), "w", F.posexplode("px").alias("i", "v"))
    px = b.select("path", F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "ch", "v")
    return rasters_of(s, d, px, 3).select(F.expr("vec_id div 3").alias("grp"), (F.col("vec_id") % 3).cast("int").alias("c"), "y", "x", "v")


@query("src_04", f"{RASTER} x AS (SELECT 1) {CHANNELS}")
def src_04(s, d):
    """Channels first, from TIFF files whose channels are pages, planes, or come last."""

    def encode(g, p):
        image = stacked(p).astype(np.uint8)
        pages = image.transpose(2, 0, 1)[..., None] if g % 3 == 0 else image
        return f"{g}.tif", formats.encode_tiff(pages, strip=40, planar=g % 3 == 1)

    return _channels_first(s, d, pictures(s, d, encode, 3))


@query("src_05", f"{RASTER} x AS (SELECT 1) {CHANNELS}")
def src_05(s, d):
    """Images for inference: values of 16 bits are cut at 255."""
    found = _channels_first(s, d, pictures(s, d, lambda g, p: (f"{g}.tif", formats.encode_tiff(stacked(p).astype(np.uint16), big=True, compression=1)), 3, "if(u = 255, 60000, u)"))
    return found.withColumn("v", F.least(F.lit(255), F.greatest(F.lit(0), "v")))


def paged(g: int, pixels: np.ndarray) -> tuple[str, bytes]:
    return f"{g}.tif", formats.encode_tiff(pixels.astype(np.uint8), strip=3)


@query("src_07", f"{RASTER} x AS (SELECT 1) SELECT vec_id, (y - 2)::INTEGER AS y, (x - 1)::INTEGER AS x, u AS v FROM rast WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 8")
def src_07(s, d):
    """A window of each image; only the strips that it needs are read, and it is held to the image."""
    b = readers.raster_window(s, pictures(s, d, paged), 2, 6, 1, 99)
    return readers.block_pixels(b).select((number() * PER + F.col("page")).cast("long").alias("vec_id"), "y", "x", "v")


@query("src_08", f"{RASTER} x AS (SELECT 1) SELECT vec_id // 3 AS grp, (y // 4)::INTEGER AS ty, (x // 4)::INTEGER AS tx, sum(u)::BIGINT AS total FROM rast GROUP BY ALL")
def src_08(s, d):
    """Aligned images read by blocks; each block's planes are summed where they are read."""
    b = readers.rasters(s, pictures(s, d, lambda g, p: (f"{g}.tif", formats.encode_tiff(stacked(p).astype(np.uint16), tile=16, planar=True)), 3), 4)
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select((number() * PER + F.expr("ty div 2")).alias("grp"), (F.col("ty") % 2).alias("ty"), "tx", total.alias("total"))


@query("src_09", f"{BOXES} st AS (SELECT unnest([0, 12, 24, 36, 48]) AS o) SELECT sample_id, a.o AS y0, b.o AS x0, count(*) AS n FROM tpx, st a, st b WHERE y >= a.o AND y < a.o + 16 AND x >= b.o AND x < b.o + 16 GROUP BY ALL")
def src_09(s, d):
    """Tiles of 16 that overlap by a quarter, with the labelled pixels in each."""

    def made(rows: pa.Table) -> pa.Table:
        g = rows["g"][0].as_py()
        image = np.zeros((16, B.SIDE, B.SIDE, 1), np.uint32)
        image[rows["page"].to_numpy(), rows["y"].to_numpy(), rows["x"].to_numpy(), 0] = rows["label"].to_numpy()
        return pa.table({"name": [f"{g}.tif"], "content": pa.array([formats.encode_tiff(image, tile=32)], pa.binary())})

    folder = shared.folder(s)
    p = B.pixels(s, d).select(F.expr("sample_id div 16").alias("g"), (F.col("sample_id") % 16).cast("int").alias("page"), "y", "x", "label")
    writers.write_files(p.groupBy("g").applyInArrow(made, "name string, content binary"), folder)
    n = F.size(F.filter("px", lambda v: v != 0)).cast("long")
    return readers.overlapping_tiles(s, folder, 16).select((number() * 16 + F.col("page")).cast("long").alias("sample_id"), F.col("ty").alias("y0"), F.col("tx").alias("x0"), n.alias("n")).where("n > 0")


PARTS = "SELECT sample_id, count(*) AS parts, sum((x1 - x0) * (y1 - y0))::BIGINT AS area FROM tb WHERE x1 > x0 AND y1 > y0 GROUP BY ALL"


def _ring(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def _geopackages(s, d, collection: bool) -> str:
    """A layer by 20 samples: a polygon by row, empty where a box is; or a sample's polygons as one collection."""

    def made(rows: pa.Table) -> pa.Table:
        boxes = rows.sort_by("label").to_pylist()
        ring = lambda b: [[_ring(b["x0"], b["y0"], b["x1"], b["y1"])]] if b["x1"] > b["x0"] and b["y1"] > b["y0"] else []
        if collection:
            by: dict[int, list] = {}
            for b in boxes:
                by.setdefault(b["sample_id"], []).extend(ring(b))
            rows_out = sorted(by.items())
        else:
            rows_out = [(b["label"], ring(b) or (None if b["label"] % 2 else [])) for b in boxes]
        body = formats.encode_geopackage("parts", rows_out, collection)
        return pa.table({"name": [f"{boxes[0]['g']}.gpkg"], "content": pa.array([body], pa.binary())})

    folder = shared.folder(s)
    b = B.boxes(s, d).select(F.expr("sample_id div 20").alias("g"), *K, "label", "x0", "y0", "x1", "y1")
    writers.write_files(b.groupBy("g").applyInArrow(made, "name string, content binary"), folder)
    return folder


def _parts(polygons: DataFrame) -> DataFrame:
    area = arrays.shoelace(F.get("rings", F.lit(0)))
    return polygons.groupBy(*K).agg(F.count("*").alias("parts"), F.round(F.sum(area)).cast("long").alias("area"))


@query("src_10", f"{BOXES} x AS (SELECT 1) {PARTS}")
def src_10(s, d):
    """Polygons of GeoPackage layers; null and empty ones are dropped."""
    found = readers.geopackage(s, _geopackages(s, d, False), "parts")
    return _parts(found.withColumn("sample_id", F.expr("(fid - 1) div 50")))


@query("src_11", f"{BOXES} x AS (SELECT 1) {PARTS}")
def src_11(s, d):
    """Geometry collections of GeoPackage layers, flattened to polygons."""
    found = readers.geopackage(s, _geopackages(s, d, True), "parts")
    return _parts(found.withColumn("sample_id", F.col("fid")))


@query("src_12", f"{BOXES} x AS (SELECT 1) {PARTS}")
def src_12(s, d):
    """Polygons of GeoJSON documents, whose multipolygons become a row by part."""
    b = B.boxes(s, d).where("x1 > x0 and y1 > y0")
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    many = b.groupBy(*K).agg(F.collect_list(F.array(ring)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("sample_id").cast("string").alias("id"), F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"))
    docs = many.groupBy(F.expr("sample_id div 20").alias("g")).agg(F.collect_list(feature).alias("features")).select(F.concat(F.col("g").cast("string"), F.lit(".geojson")).alias("name"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("content"))
    folder = shared.folder(s)
    writers.write_files(docs, folder)
    return _parts(readers.geojson(s, folder).withColumn("sample_id", F.col("id").cast("long")))


SHAPES = "sh AS (SELECT sample_id, label, count(*) AS area, min(x)::INTEGER AS bx0, min(y)::INTEGER AS by0, max(x)::INTEGER AS bx1, max(y)::INTEGER AS by1 FROM tpx GROUP BY ALL)"


def _annotations(s, d) -> str:
    """Run lengths, area and box of each painted mask, as lines of JSON; the tile's place says which mask it is."""
    r = B.label_runs(s, d)
    ordered = r.groupBy(*K, "label").agg(F.array_sort(F.collect_list(F.struct((F.col("y") * B.SIDE + F.col("x0")).cast("long").alias("start"), (F.col("x1") - F.col("x0")).cast("long").alias("length")))).alias("r"))
    end = lambda e: e["start"] + e["length"]
    counts = F.flatten(F.transform("r", lambda e, i: F.array(F.when(i == 0, e["start"]).otherwise(e["start"] - end(F.get("r", i - 1))), e["length"])))
    rest = F.lit(B.SIDE**2).cast("long") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.when(rest > 0, F.concat(counts, F.array(rest))).otherwise(counts)
    a = ordered.join(runs.shapes(r, K), [*K, "label"])
    line = writers.annotation(whole, (B.SIDE, B.SIDE), F.col("area"), F.array("bx0", "by0", "bx1", "by1"), F.col("sample_id").cast("int"), F.col("label").cast("int"))
    folder = shared.folder(s)
    a.select(line.alias("value")).write.text(folder)
    return folder


@query("src_13", f"{BOXES} {SHAPES} SELECT * FROM sh")
def src_13(s, d):
    """Areas and boxes from the run lengths of annotations."""
    a = readers.rle_annotations(s, _annotations(s, d), lines=True)
    found = runs.unrle(a.select(F.col("tile_x").cast("long").alias("sample_id"), F.col("tile_y").cast("long").alias("label"), F.col("rle.counts").alias("counts")), [*K, "label"])
    y, x = F.expr(f"start div {B.SIDE}").cast("int"), (F.col("start") % B.SIDE).cast("int")
    return runs.shapes(found.select(*K, "label", y.alias("y"), x.alias("x0"), (x + F.col("length")).cast("int").alias("x1")), K)


@query("snk_08", f"{BOXES} {SHAPES} SELECT * FROM sh")
def snk_08(s, d):
    """Annotations as they were written: the stored areas and boxes."""
    a = readers.rle_annotations(s, _annotations(s, d), lines=True)
    return a.select(F.col("tile_x").cast("long").alias("sample_id"), F.col("tile_y").cast("long").alias("label"), "area", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("bx0", "by0", "bx1", "by1"))])


@query("src_14", f"{BOXES} {SHAPES} SELECT * FROM sh")
def src_14(s, d):
    """A cache of raw masks, as a table of runs that is written once and read back."""
    return runs.shapes(shared.written(B.label_runs(s, d)), K)


@query("src_16", "SELECT r_regionkey, n_nationkey % 5 AS place, n_name, 'data/r' || r_regionkey AS root FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_16(s, d):
    """Data set files: names as a list or a map by number, the root as written or the file's folder."""
    n = B.table(s, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    listed = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    as_map = F.concat(F.lit("names:\n"), F.array_join(F.transform("l", lambda e: F.concat(F.lit("  "), e["n_nationkey"].cast("string"), F.lit(": "), e["n_name"])), "\n"))
    as_list = F.concat(F.lit("names: # a list\n"), F.array_join(F.transform("l", lambda e: F.concat(F.lit("- '"), e["n_name"], F.lit("'"))), "\n"))
    odd = F.col("n_regionkey") % 2 == 1
    head = F.concat(F.when(odd, F.concat(F.lit("path: data/r"), F.col("n_regionkey").cast("string"), F.lit("\n"))).otherwise(""), F.lit("train: images/train\nval: images/val\n\n"))
    folder = shared.folder(s)
    writers.write_files(listed.select(F.concat(F.when(odd, "").otherwise(F.concat(F.lit("data/r"), F.col("n_regionkey").cast("string"), F.lit("/"))), F.lit("set_"), F.col("n_regionkey").cast("string"), F.lit(".yaml")).alias("name"), F.concat(head, F.when(odd, as_list).otherwise(as_map)).alias("content")), folder)
    read = readers.dataset_yaml(s, f"{folder}/*.yaml").unionByName(readers.dataset_yaml(s, f"{folder}/data/*/*.yaml"))
    top = writers.local_path(folder).rstrip("/") + "/"
    r = read.select(number().cast("int").alias("r_regionkey"), "name", F.replace("root", F.lit(top), F.lit("")).alias("root"), "train")
    return r.join(n.select("n_nationkey", F.col("n_name").alias("name")), "name").select("r_regionkey", (F.col("n_nationkey") % 5).alias("place"), F.col("name").alias("n_name"), "root")


@query("src_17", "SELECT page_id, CASE WHEN url LIKE '/%' THEN url ELSE 'base/' || url END AS path FROM pages")
def src_17(s, d):
    """Pairs of a manifest under either of its names; relative paths are under its folder."""
    p = B.table(s, d, "pages").select("page_id", "url")
    odd, label = F.col("page_id") % 2 == 1, F.concat(F.lit("/"), F.col("page_id").cast("string"))
    row = F.struct(F.when(odd, F.col("url")).alias("tiff"), F.when(~odd, F.col("url")).alias("test_tiff"), F.when(odd, label).alias("gpkg"), F.when(~odd, label).alias("test_gpkg"))
    folder = shared.folder(s)
    p.select(F.to_json(row).alias("value")).write.text(folder)
    return readers.manifest(s, folder, "base", lines=True).select(F.substring_index("gpkg", "/", -1).cast("long").alias("page_id"), F.col("tiff").alias("path"))


def _tuning(s, d) -> str:
    folder = shared.folder(s)
    B.series(s, d).select("user_id", "i", "fitness").write.option("header", True).csv(folder)
    return folder


@query("src_19", f"WITH {B.SERIES} SELECT fitness FROM ser WHERE NOT isnan(fitness)")
def src_19(s, d):
    """One column of tuning tables, without NaN."""
    return readers.tuning_series(s, _tuning(s, d), ["fitness"])


@query("src_20", f"WITH {B.SERIES} SELECT user_id, i, fitness FROM ser WHERE NOT isnan(fitness)")
def src_20(s, d):
    """Three columns of tuning tables; rows with any NaN are dropped."""
    t = readers.tuning_series(s, _tuning(s, d), ["user_id", "i", "fitness"])
    return t.select(F.col("user_id").cast("long").alias("user_id"), F.col("i").cast("long").alias("i"), "fitness")


@query("src_23", f"{RASTER} x AS (SELECT 1) SELECT vec_id, sum(u % 3)::BIGINT AS total FROM rast GROUP BY ALL")
def src_23(s, d):
    """Cached predictions: files of one band and of the samples' shape, others are an error."""
    b = readers.one_band(readers.rasters(s, pictures(s, d, png, value="u % 3"), 8))
    good = catalog.require((F.col("h") == 8) & (F.col("w") == 8), F.col("px"), "a cached prediction has its image's shape")
    total = F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select((number() * PER + F.col("ty")).cast("long").alias("vec_id"), total.alias("total"))


@query("src_24", f"{RASTER} e AS (SELECT vec_id // 3 AS grp, vec_id % 3 AS f, min(u) AS lo, max(u) AS hi FROM rast GROUP BY ALL), n AS (SELECT vec_id // 3 AS grp, vec_id % 3 AS f, y, x, CASE WHEN hi > lo THEN floor((u - lo)::DOUBLE / (hi - lo)::DOUBLE * 255)::INTEGER ELSE 0 END AS v FROM rast JOIN e ON e.grp = vec_id // 3 AND e.f = vec_id % 3), m AS (SELECT grp, max(f) AS last FROM n GROUP BY ALL) SELECT n.grp, c::INTEGER AS c, y, x, v FROM n JOIN m USING (grp), range(3) r(c) WHERE f = least(c, last)")
def src_24(s, d):
    """Previews: the first three frames, each stretched to 0 to 255; the last one is repeated where there are fewer."""
    px = readers.block_pixels(readers.rasters(s, pictures(s, d, paged))).select((number() * PER + F.col("page")).cast("long").alias("vec_id"), "y", "x", "v")
    p = px.select(F.expr("vec_id div 3").alias("grp"), (F.col("vec_id") % 3).cast("int").alias("c"), "y", "x", "v")
    n = raster.normalise_channels(p, ["grp"])
    last = n.groupBy("grp").agg(F.max("c").alias("last"))
    want = F.when(F.col("c") == F.col("last"), F.sequence("c", F.lit(2))).otherwise(F.array("c"))
    return n.join(last, "grp").withColumn("c", F.explode(want)).select("grp", "c", "y", "x", "v")


def _files(s, rows: DataFrame) -> str:
    """Files by name, each with its name as content."""
    folder = shared.folder(s)
    writers.write_files(rows.select("name", F.col("name").alias("content")), folder)
    return folder


@query("src_25", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'tif' WHEN 1 THEN 'tiff' END AS ext FROM pages WHERE page_id % 3 < 2")
def src_25(s, d):
    """Files of some endings, in any folder and case."""
    ending = F.when(F.col("page_id") % 3 == 0, "TIF").when(F.col("page_id") % 3 == 1, "tiff").otherwise("txt")
    folder = _files(s, B.table(s, d, "pages").select(F.concat(F.lit("f"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit("."), ending).alias("name")))
    return readers.listing(s, folder, ["tif", "tiff"]).select(F.col("stem").cast("long").alias("page_id"), "ext")


@query("src_26", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def src_26(s, d):
    """Images that have a label file: labels lie where the first ``images`` of an image's path is ``labels``."""
    docs, labels = (B.table(s, d, t).select("doc_id").distinct() for t in ("documents", "labels"))
    name = lambda kind, end: F.concat(F.lit(f"{kind}/train/images_"), F.col("doc_id").cast("string"), F.lit(end)).alias("name")
    folder = _files(s, docs.select(name("images", ".png")).union(labels.select(name("labels", ".txt"))))
    found = readers.listing(s, folder)
    images = found.where("ext = 'png'").select("stem", F.regexp_replace(F.regexp_replace("path", "^(.*?)/images/", "$1/labels/"), r"\.png$", ".txt").alias("label_path"))
    return catalog.having_labels(images, found.select(F.col("path").alias("label_path")), "label_path").select(F.substring_index("stem", "_", -1).cast("long").alias("doc_id"))


@query("src_01", "SELECT s_suppkey, 's' || s_suppkey || '_PPL.png' AS a, 's' || s_suppkey || '_PPX.png' AS b, 's' || s_suppkey || '_mask.' || CASE s_suppkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'tif' ELSE 'jpg' END AS mask FROM supplier")
def src_01(s, d):
    """A catalogue of samples: an image by suffix and a mask of the first ending there is."""
    k = B.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stem"))
    images = k.select(F.explode(F.array(*[F.concat("stem", F.lit(f"_{x}.png")) for x in ("PPL", "PPX")])).alias("name"))
    ends = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("png"), F.lit("jpg"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("tif"), F.lit("tiff"))).otherwise(F.array(F.lit("jpg")))
    masks = k.select("stem", F.explode(ends).alias("end")).select(F.concat(F.lit("masks/"), "stem", F.lit("_mask."), "end").alias("name"))
    found = readers.listing(s, _files(s, images.union(masks))).select("name", "stem", "ext")
    parts = found.where("stem rlike '_(PPL|PPX)$'").select(F.substring_index("stem", "_", 1).alias("stem"), F.concat(F.lit("_"), F.substring_index("stem", "_", -1)).alias("suffix"), "name")
    pairs = catalog.pair_files(parts, ["_PPL", "_PPX"], "stem", "suffix", "name")
    order = F.array_position(F.array(*map(F.lit, ("png", "tif", "tiff", "jpg"))), F.col("ext"))
    mask = found.where("stem rlike '_mask$'").groupBy(F.substring_index("stem", "_", 1).alias("stem")).agg(F.min_by("name", order).alias("mask"))
    whole = pairs.join(mask, "stem", "left").withColumn("mask", catalog.require(F.col("mask").isNotNull(), F.col("mask"), "a sample has a mask"))
    return whole.select(F.substring("stem", 2, 20).cast("long").alias("s_suppkey"), F.get("images", F.lit(0)).alias("a"), F.get("images", F.lit(1)).alias("b"), "mask")


@query("snk_01", f"{BOXES} x AS (SELECT 1) SELECT sample_id, label, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM tb WHERE x1 > x0 AND y1 > y0")
def snk_01(s, d):
    """Polygons written as GeoPackage layers and read back; boxes without an inside are null or empty there."""
    found = readers.geopackage(s, _geopackages(s, d, False), "parts")
    return found.select(F.expr("(fid - 1) div 50").alias("sample_id"), F.col("fid").alias("label"), arrays.shoelace(F.get("rings", F.lit(0))).alias("area"))


@query("snk_02", f"{RASTER} x AS (SELECT 1) SELECT vec_id, y, x, u AS v FROM rast")
def snk_02(s, d):
    """Images written as TIFF files, with planes apart or not, and read back."""
    folder = pictures(s, d, lambda g, p: (f"{g}.tif", formats.encode_tiff(stacked(p).clip(0, 255).astype(np.uint8), tile=16 if g % 2 else None, planar=g % 3 == 0)), 3)
    return rasters_of(s, d, readers.block_pixels(readers.rasters(s, folder, 100), 100), 3)


@query("snk_03", f"{RASTER} x AS (SELECT 1) SELECT vec_id, y, x, u AS v FROM rast")
def snk_03(s, d):
    """An image written stripe by stripe, each a TIFF of its own that its task writes, and read back in place."""
    folder = shared.folder(s)

    def made(rows: pa.Table) -> pa.Table:
        g, stripe = rows["g"][0].as_py(), rows["stripe"][0].as_py()
        image = np.zeros((16, 8, 1), np.uint8)
        image[rows["row"].to_numpy(), rows["x"].to_numpy(), 0] = rows["u"].to_numpy()
        return pa.table({"name": [f"{g}/{stripe}.tif"], "content": pa.array([formats.encode_tiff(image)], pa.binary())})

    r = B.raster(s, d).select(F.expr("vec_id div 16").alias("g"), F.expr("(vec_id % 16) div 2").alias("stripe"), ((F.col("vec_id") % 2) * 8 + F.col("y")).cast("int").alias("row"), "x", "u")
    writers.write_files(r.groupBy("g", "stripe").applyInArrow(made, "name string, content binary"), folder)
    px = readers.block_pixels(readers.rasters(s, folder))
    g = F.regexp_extract("path", r"(\d+)/\d+\.tif$", 1).cast("long")
    vec = g * 16 + number() * 2 + F.expr("y div 8")
    return px.select(vec.cast("long").alias("vec_id"), (F.col("y") % 8).cast("int").alias("y"), "x", "v").join(B.table(s, d, "embeddings").select("vec_id"), "vec_id", "left_semi")


@query("snk_05", "SELECT DISTINCT p_size, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 8.0::DOUBLE END AS value FROM part")
def snk_05(s, d):
    """Strict JSON written and read back: NaN is null."""
    v = B.table(s, d, "part").select("p_size").distinct().withColumn("value", F.when(F.col("p_size") % 4 == 0, float("nan")).otherwise(F.col("p_size") / F.lit(8.0)))
    folder = shared.folder(s)
    readers.write_strict_json(v, folder)
    return s.read.schema(v.schema).json(folder)


@query("snk_06", "SELECT DISTINCT p_size, printf('%.8f', p_size / 8.0::DOUBLE) AS mean_aji, CASE WHEN p_size % 5 = 0 THEN '' ELSE (p_size)::VARCHAR || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.5' END END AS ridge_level FROM part")
def snk_06(s, d):
    """A tuning table written as CSV and read back as text: eight decimals, an automatic ridge is blank."""
    ridge = F.when(F.col("p_size") % 5 != 0, F.col("p_size") + F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5))
    v = B.table(s, d, "part").select("p_size").distinct().select("p_size", (F.col("p_size") / F.lit(8.0)).alias("mean_aji"), ridge.alias("ridge_level"))
    folder = shared.folder(s)
    writers.write_grid(v, folder, ["mean_aji"])
    read = s.read.option("header", True).schema("p_size int, mean_aji string, ridge_level string").csv(folder)
    return read.withColumn("ridge_level", F.coalesce("ridge_level", F.lit("")))


@query("snk_07", "SELECT event_id, '{\"event_id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS summary FROM events")
def snk_07(s, d):
    """Summaries written as JSON lines and read back as text."""
    e = B.table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("b")).select("event_id", "b.k")
    folder = shared.folder(s)
    e.write.json(folder)
    return s.read.text(folder).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("summary"))


@query("snk_09", f"{WITH} {SPLIT} SELECT split || '/s' || sample_id || '_region_' || lpad(tile::VARCHAR, 4, '0') || '_y' || lpad((tile // {N} * {B.TILE})::VARCHAR, 5, '0') || '_x' || lpad((tile % {N} * {B.TILE})::VARCHAR, 5, '0') AS stem, sample_id, CASE WHEN tile % 2 = 0 THEN 12 ELSE 0 END AS chars FROM sp")
def snk_09(s, d):
    """Label trees: files by split and region, rows with a line end, tiles without rows as empty files; files of an earlier export are cleared."""
    stem = F.concat(F.lit("s"), F.col("sample_id").cast("string"), F.lit("_"), F.format_string("region_%04d_y%05d_x%05d", "tile", F.expr(f"tile div {N} * {B.TILE}").cast("int"), F.expr(f"tile % {N} * {B.TILE}").cast("int")))
    rows = split(s, d).select("split", stem.alias("stem"), F.when(F.col("tile") % 2 == 0, F.array(F.lit("0 0.0"), F.lit("0 1.0"))).otherwise(F.array().cast("array<string>")).alias("rows"))
    folder = shared.folder(s)
    writers.write_tree(s.createDataFrame([("train", "stale", ["0 9.9"])], "split string, stem string, rows array<string>"), folder)
    writers.write_tree(rows, folder)
    found = readers.listing(s, f"{folder}/labels", ["txt"])
    name = F.regexp_extract("path", r"labels/([^/]+/[^/]+)\.txt$", 1)
    return found.select(name.alias("stem"), F.regexp_extract("path", r"/s(\d+)_region", 1).cast("long").alias("sample_id"), F.col("length").cast("int").alias("chars"))
