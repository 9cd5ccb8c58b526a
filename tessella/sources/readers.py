"""Readers: YOLO labels, RLE and GeoJSON documents, metrics, tuning series, logs, registries, rasters, GeoPackages."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.catalog import require
from tessella.sources import formats
from tessella.sources.formats import decode_png, decode_tiff, encode_tiff


POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"


def yolo_polygon(line: Column, width: Column, height: Column) -> Column:
    """(class, points) of a label line scaled to the image; too few or an even number of values is an error."""
    parts = F.transform(F.split(F.trim(line), r"\s+"), lambda v: v.cast("double"))
    good = require((F.size(parts) >= 7) & (F.size(parts) % 2 == 1), parts, "a label line has a class and three points or more")
    points = F.transform(F.sequence(F.lit(1), F.size(good) - 2, F.lit(2)), lambda i: F.struct((F.get(good, i) * width).alias("x"), (F.get(good, i + 1) * height).alias("y")))
    return F.struct(F.get(good, F.lit(0)).cast("int").alias("cls"), points.alias("points"))


def yolo_labels(lines: DataFrame, width: int, height: int, line: str = "value") -> DataFrame:
    """Add cls and points; blank lines are skipped."""
    return lines.where(F.trim(line) != "").withColumn("_p", yolo_polygon(F.col(line), F.lit(width), F.lit(height))).select("*", "_p.cls", "_p.points").drop("_p")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, geometry_type, rings) of a feature collection; the parts of a multipolygon are rows."""
    raw = spark.read.option("multiLine", True).schema("features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.id", "f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"))
    one, many = F.from_json("c", "array<array<array<double>>>"), F.from_json("c", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geometry_type") == "Polygon", F.array(one)).when(F.col("geometry_type") == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rings = lambda part: F.transform(part, lambda ring: F.transform(ring, point))
    return f.select("id", "properties", "geometry_type", F.explode(parts).alias("part")).select("id", "properties", "geometry_type", rings(F.col("part")).alias("rings"))


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature per line: id, properties (map) and rings."""
    coordinates = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    features.select(F.lit("Feature").alias("type"), "id", "properties", geometry.alias("geometry")).write.mode("overwrite").json(path)


RLE = "rle struct<size:array<int>,counts:array<bigint>,order:string>, area bigint, bbox array<int>, predicted_iou double, stability_score double, tile_x int, tile_y int"


def rle_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Mask annotations as rows, from documents that are lists of them, or one by line; any key may be absent."""
    return spark.read.option("multiLine", not lines).schema(RLE).json(path)


def metrics_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_id, metric, value) of metrics documents; the mean entry and values that aren't numbers are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,map<string,string>>").alias("m"))
    rows = raw.select("path", F.explode("m").alias("sample_id", "metrics")).where("sample_id <> 'mean'").select("path", "sample_id", F.explode("metrics").alias("metric", "text"))
    return rows.select("path", "sample_id", "metric", F.try_to_number("text", F.lit("S9999999999D9999999999")).cast("double").alias("_n"), F.col("text")).select("path", "sample_id", "metric", F.expr("try_cast(text AS double)").alias("value")).where("value is not null")


def tuning_series(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a CSV with a header as doubles; missing columns and bad numbers are errors, rows with NaN are dropped."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("inferSchema", False).csv(path)
    lacking = [c for c in columns if c not in raw.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    out = raw.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return out.where(" and ".join(f"not isnan({c})" for c in columns))


def model_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated table of models; comments and blank lines are skipped, four fields are the least."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    f = F.split("value", "\t")
    good = require(F.size(f) >= 4, f, "a row has four fields or more")
    names = ["label", "model", "num_inputs", "suffix_csv", "watershed_json"]
    return lines.select(*[F.get(good, F.lit(i)).alias(n) for i, n in enumerate(names)]).withColumn("num_inputs", F.col("num_inputs").cast("int"))


def manifest(spark: SparkSession, path: str, base: str, lines: bool = False) -> DataFrame:
    """(tiff, gpkg) pairs of a manifest; short names are taken too, relative paths are under base."""
    raw = spark.read.option("multiLine", not lines).schema("test_tiff string, test_gpkg string, tiff string, gpkg string").json(path)
    full = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))
    return raw.select(full(F.coalesce("test_tiff", "tiff")).alias("tiff"), full(F.coalesce("test_gpkg", "gpkg")).alias("gpkg"))


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, name, stem, ext, modified, length) of all files below a folder; contents aren't read.

    Spark leaves files without content out, which label files may be; so a mounted folder is listed by itself. In
    other stores files without content are missed.
    """
    if mounted(folder):
        top = os.path.abspath(unquote(urlsplit(folder).path))
        found = [e for base, _, names in os.walk(top) for x in names for e in [(os.path.join(base, x), os.stat(os.path.join(base, x)))]]
        columns = [pa.array(["file:" + p for p, _ in found], pa.string()), pa.array([int(e.st_mtime * 1e6) for _, e in found], pa.timestamp("us", "UTC")), pa.array([e.st_size for _, e in found], pa.int64())]
        files = spark.createDataFrame(pa.table(columns, ["path", "modified", "length"]), "path string, modified timestamp, length long")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "modified", "length")
    return out.where(F.col("ext").isin(extensions)) if extensions else out


def mounted(path: str) -> bool:
    """Whether tasks can open the files of a path."""
    return path.startswith(("/", "file:"))


def pages_of(read: Callable[[int, int], bytes]) -> list[formats.Page | np.ndarray]:
    """The images of a PNG or TIFF."""
    if read(0, 4) == b"\x89PNG":
        return [formats.decode_png(read(0, 1 << 31))]
    return formats.tiff_pages(read)


def window(page: formats.Page | np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    return page[top:bottom, left:right] if isinstance(page, np.ndarray) else page.window(top, bottom, left, right)


def shape(page: formats.Page | np.ndarray) -> tuple[int, int]:
    return page.shape[:2] if isinstance(page, np.ndarray) else (page.height, page.width)


def _windows(spark: SparkSession, path: str, windows: Callable[[int, int], list[tuple[int, int, int, int, int, int]]]) -> DataFrame:
    """(path, page, ty, tx, h, w, c, px) of the windows (ty, tx, top, bottom, left, right) that a function gives for an image's height and width.

    Where tasks can open the files they read the parts that a window needs, so an image of any size is read in small
    pieces; elsewhere Spark hands over whole files, of 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    opens = mounted(path)
    files = files.select("path") if opens else files.select("path", "content")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                with open(unquote(urlsplit(name).path), "rb") if opens else io.BytesIO(batch.column(1)[i].as_py()) as f:

                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    for k, page in enumerate(pages_of(read)):
                        for ty, tx, *place in windows(*shape(page)):
                            b = window(page, *place)
                            if b.dtype.kind == "f":
                                raise ValueError("rasters of floats have no whole numbers")
                            whole = [pa.array([x], pa.int32()) for x in (k, ty, tx, *b.shape)]
                            yield pa.RecordBatch.from_arrays([pa.array([name]), *whole, pa.array([b.ravel().astype(np.int32)], pa.list_(pa.int32()))], ["path", "page", "ty", "tx", "h", "w", "c", "px"])

    return files.mapInArrow(blocks, "path string, page int, ty int, tx int, h int, w int, c int, px array<int>")


def rasters(spark: SparkSession, path: str, tile: int = 512) -> DataFrame:
    """(path, page, ty, tx, h, w, c, px): images as blocks; a block is small whatever the image's size."""
    return _windows(spark, path, lambda h, w: [(y // tile, x // tile, y, y + tile, x, x + tile) for y in range(0, h, tile) for x in range(0, w, tile)])


def raster_window(spark: SparkSession, path: str, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """The same window of each image, as a block; it is held to the image, and an empty one is an error."""
    return _windows(spark, path, lambda h, w: [(0, 0, top, bottom, left, right)])


def overlapping_tiles(spark: SparkSession, path: str, side: int, overlap: int | None = None) -> DataFrame:
    """Square tiles that share ``overlap`` pixels with their neighbours (a quarter of the side by default); ty and tx are their first pixels."""
    step = side - (side // 4 if overlap is None else overlap)
    starts = lambda n: range(0, max(n - side, 0) + step, step) if n > side else [0]
    return _windows(spark, path, lambda h, w: [(y, x, y, y + side, x, x + side) for y in starts(h) if y < h for x in starts(w) if x < w])


def one_band(blocks: DataFrame) -> DataFrame:
    """Blocks of masks: one band and one page, others are an error."""
    return blocks.withColumn("px", require((F.col("c") == 1) & (F.col("page") == 0), F.col("px"), "a mask has one band and two dimensions"))


def channels_first(blocks: DataFrame) -> DataFrame:
    """Blocks with their channel (channel, h, w, px): pages are channels where each has one band; pages with several are an error."""
    whole = blocks.withColumn("px", require((F.col("page") == 0) | (F.col("c") == 1), F.col("px"), "channels are pages or bands, not both"))
    split = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    own = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.get("px", i * F.col("c") + F.col("k")))
    return split.select("path", "ty", "tx", F.when(F.col("c") == 1, F.col("page")).otherwise(F.col("k")).alias("channel"), "h", "w", own.alias("px"))


def dataset_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, root, train, val, id, name) of data set files: the root is the file's folder unless given, names are a list or a map by number."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain, names = yaml_subset(text)
                root = plain.get("path", "") or "."
                root = root if root.startswith("/") else os.path.normpath(os.path.join(os.path.dirname(unquote(urlsplit(file).path)), root))
                found += [(file, root, plain.get("train"), plain.get("val"), i, n) for i, n in names.items()]
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 4 else pa.string()) for i, c in enumerate(columns)], ["path", "root", "train", "val", "id", "name"])

    return raw.mapInArrow(rows, "path string, root string, train string, val string, id int, name string")


def yaml_subset(text: str) -> tuple[dict[str, str], dict[int, str]]:
    """Top-level values and names of a data set file: ``key: value`` lines, and names as a list, a map, or either in brackets."""
    plain: dict[str, str] = {}
    names: dict[int, str] = {}
    inside = False
    clean = lambda x: x.strip().strip("\"'")
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not line:
            continue
        if not line[0].isspace() and not line.startswith("-"):
            key, _, value = line.partition(":")
            inside = clean(key) == "names"
            value = value.strip()
            if not inside:
                plain[clean(key)] = clean(value)
            elif value[:1] in "[{" and value:
                parts = [x for x in value[1:-1].split(",") if x.strip()]
                names |= dict(enumerate(map(clean, parts))) if value[0] == "[" else {int(clean(k)): clean(v) for k, _, v in (x.partition(":") for x in parts)}
        elif inside:
            item = line.strip()
            if item.startswith("-"):
                names[len(names)] = clean(item[1:])
            else:
                key, _, value = item.partition(":")
                names[int(clean(key))] = clean(value)
    return plain, names


def block_pixels(blocks: DataFrame, tile: int = 512) -> DataFrame:
    """(path, page, y, x, c, v) of blocks."""
    i = F.col("i")
    return blocks.select("path", "page", "ty", "tx", "w", "c", F.posexplode("px").alias("i", "v")).select("path", "page", (F.col("ty") * tile + F.floor(i / (F.col("w") * F.col("c")))).cast("int").alias("y"), (F.col("tx") * tile + F.floor(i / F.col("c")) % F.col("w")).cast("int").alias("x"), (i % F.col("c")).alias("ch"), "v")


def geopackage(spark: SparkSession, path: str, layer: str, geometry: str = "geom") -> DataFrame:
    """(path, fid, part, rings) of the polygons of a layer; multipart geometries are flattened, empty ones dropped.

    A GeoPackage is one SQLite file, so a task reads a file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = formats.decode_geopackage(content, layer, geometry)
                yield pd.DataFrame([(name, fid, k, p) for fid, blob in found if blob for k, p in enumerate(formats.geometry(blob))], columns=["path", "fid", "part", "rings"])

    return files.mapInPandas(rows, f"path string, fid long, part int, rings {RINGS}")


def write_labels(rows: DataFrame, path: str) -> None:
    """Label texts (split, stem, row_text) as one folder per split; earlier content is replaced."""
    rows.select("split", F.concat_ws("\t", "stem", "row_text").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_strict_json(rows: DataFrame, path: str) -> None:
    """JSON lines in which NaN is null."""
    rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in rows.dtypes]).write.mode("overwrite").option("ignoreNullFields", False).json(path)
