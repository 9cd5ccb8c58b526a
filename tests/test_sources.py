"""Readers and writers on small files, and the line stream."""

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import formats, readers, writers
from tessella.streaming import lines


def png(pixels, filters=0):
    h, w, c = pixels.shape
    raw = b""
    for y in range(h):
        row = pixels[y].astype(np.uint8)
        if filters == 1:
            row = np.concatenate([row[:1], row[1:] - row[:-1]]).astype(np.uint8)
        elif filters == 2 and y:
            row = (row - pixels[y - 1]).astype(np.uint8)
        raw += bytes([filters]) + row.tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [0, 1, 2])
def test_rasters_are_read_in_blocks(spark, tmp_path, filters):
    pixels = np.random.default_rng(1).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels, filters))
    (tmp_path / "b.tif").write_bytes(readers.encode_tiff(pixels))
    blocks = readers.rasters(spark, str(tmp_path), 4)
    assert blocks.count() == 8
    px = readers.block_pixels(blocks, 4).collect()
    for name in ("a.png", "b.tif"):
        got = np.zeros((5, 7, 3), int)
        for r in px:
            if r["path"].endswith(name):
                got[r["y"], r["x"], r["ch"]] = r["v"]
        assert (got == pixels).all()


def test_yolo_labels(spark, tmp_path):
    (tmp_path / "l.txt").write_text("0 0.2 0.25 0.8 0.25 0.8 0.75 0.2 0.75\n\n")
    r = readers.yolo_labels(spark.read.text(str(tmp_path / "l.txt")), 100, 80).collect()
    assert len(r) == 1 and len(r[0]["points"]) == 4 and (r[0]["points"][0]["x"], r[0]["points"][0]["y"]) == (20, 20)
    for bad in ("0 0.1 0.2", "0 0.1 0.2 0.3 0.4 0.5 0.6 0.7"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="three points"):
            readers.yolo_labels(spark.read.text(str(tmp_path / "bad.txt")), 1, 1).collect()


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "1", "properties": {"a": "x"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "id": "2", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    got = readers.geojson(spark, str(tmp_path / "f.json"))
    assert sorted(r["id"] for r in got.collect()) == ["1", "2", "2"] and got.first()["rings"][0][1]["x"] == 1
    readers.write_geojson(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("geometry.coordinates").count() == 3


def test_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"s1": {"aji": 0.5, "list": [1]}, "mean": {"aji": 0.5}}))
    assert [(r["sample_id"], r["metric"], r["value"]) for r in readers.metrics_document(spark, str(tmp_path / "m.json")).collect()] == [("s1", "aji", 0.5)]
    (tmp_path / "t.csv").write_text("fitness,lr0,dropout\n0.1,0.2,0.3\nNaN,1,1\n")
    assert [tuple(r) for r in readers.tuning_series(spark, str(tmp_path / "t.csv"), ["fitness", "lr0", "dropout"]).collect()] == [(0.1, 0.2, 0.3)]
    with pytest.raises(ValueError, match="missing"):
        readers.tuning_series(spark, str(tmp_path / "t.csv"), ["other"])
    (tmp_path / "models.tsv").write_text("# label\n\na\tm.keras\t2\t_x,_y\tw.json\n")
    assert readers.model_table(spark, str(tmp_path / "models.tsv")).first()["num_inputs"] == 2
    (tmp_path / "man.json").write_text(json.dumps([{"tiff": "a.tif", "gpkg": "/g.gpkg"}]))
    assert tuple(readers.manifest(spark, str(tmp_path / "man.json"), "/base").first()) == ("/base/a.tif", "/g.gpkg")
    (tmp_path / "rle.json").write_text(json.dumps([{"rle": {"size": [2, 2], "counts": [1, 3], "order": "C"}, "area": 3}]))
    r = readers.rle_annotations(spark, str(tmp_path / "rle.json")).first()
    assert r["rle"]["counts"] == [1, 3] and r["bbox"] is None
    assert readers.listing(spark, str(tmp_path), ["tsv"]).first()["stem"] == "models"


def test_geopackage(spark, tmp_path):
    def polygon(*points):
        return b"\x01" + struct.pack("<III", 3, 1, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)

    head = b"GP\x00\x01" + struct.pack("<i", 0)
    one = polygon((0, 0), (2, 0), (2, -2), (0, 0))
    with sqlite3.connect(tmp_path / "g.gpkg") as c:
        c.execute("CREATE TABLE parts (fid INTEGER PRIMARY KEY, geom BLOB)")
        c.executemany("INSERT INTO parts VALUES (?, ?)", [(1, head + one), (2, head + b"\x01" + struct.pack("<II", 6, 2) + one + one), (3, None)])
    got = readers.geopackage(spark, str(tmp_path / "g.gpkg"), "parts").collect()
    assert sorted((r["fid"], r["part"]) for r in got) == [(1, 0), (2, 0), (2, 1)] and got[0]["rings"][0][2]["y"] == -2


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", "0 0.0"), ("val", "b", "0 1.0")], "split string, stem string, row_text string")
    readers.write_labels(rows, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).where("split = 'val'").first()["value"] == "b\t0 1.0"
    readers.write_strict_json(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double"), str(tmp_path / "strict"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "strict")).orderBy("value").collect()]
    assert text == ['{"a":1,"b":null}', '{"a":2,"b":0.5}']


def test_line_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("keep me\nsome warning: x\n\nkeep too\n")
    patterns = ["warning:", r"^\s*$"]
    query = lines.write_lines(lines.filter_lines(lines.read_lines(spark, str(tmp_path / "in")), patterns), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["keep me", "keep too"]
    assert lines.filter_lines(spark.read.text(str(tmp_path / "in")).withColumn("n", F.lit(1)), patterns).count() == 2


@pytest.mark.parametrize("kind", ["u1", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("layout", [{}, {"strip": 3}, {"tile": 16}])
@pytest.mark.parametrize("planar", [False, True])
def test_tiffs_round_trip_and_windows(kind, layout, planar):
    x = (np.random.default_rng(0).random((2, 21, 37, 3)) * 250).astype(kind)
    for big in (False, True):
        for compression in (1, 8):
            for predictor in (1, 2) if kind[0] != "f" else (1,):
                body = formats.encode_tiff(x, compression=compression, predictor=predictor, planar=planar, big=big, **layout)
                got = formats.decode_tiff(body)
                assert got.dtype == x.dtype and (got == x).all()
                touched = []

                def read(at, n, body=body, touched=touched):
                    touched.append(n)
                    return body[at : at + n]

                page = formats.tiff_pages(read)[1]
                touched.clear()
                assert (page.window(17, 99, 30, 34) == x[1, 17:, 30:34]).all()
                assert not layout or sum(touched) < len(body) / 3
                with pytest.raises(ValueError, match="empty"):
                    page.window(21, 30, 0, 5)


def test_tiff_lzw_and_packbits():
    raw = bytes(range(50)) * 3
    codes = [256, *raw[:100], 256, *raw[100:], 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert formats.lzw(packed) == raw
    # codes of strings: aaaa.. as a, aa, aaa and so on
    assert formats.lzw(bytes(int(b[i : i + 8].ljust(8, "0"), 2) for b in ["".join(f"{c:09b}" for c in (256, 97, 258, 259, 257))] for i in range(0, len(b), 8))) == b"a" * 6
    assert formats.packbits(b"\x02abc\xfex\x80\x00y") == b"abcxxxy"


@pytest.mark.parametrize(("tag", "value"), [(259, 7), (317, 3), (258, 12), (262, 3), (266, 2)])
def test_unsupported_tiffs_are_errors(tag, value):
    tags = {256: (4,), 257: (4,), 258: (8,), 273: (8,), 279: (16,)} | {tag: (value,)}
    with pytest.raises(ValueError, match="supported"):
        formats.Page(lambda at, n: b"", tags, "<")


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    x = np.random.default_rng(kind).integers(0, 256, (9, 13, 3)).astype(int)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    p = left + up - corner
    nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    lines = (x - [0 * x, left, up, (left + up) // 2, nearest][kind]) & 255
    assert (formats.unfiltered(np.full(9, kind), lines.astype(np.uint8)) == x).all()
    mixed = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1])
    every = np.stack([(x - g) & 255 for g in (0 * x, left, up, (left + up) // 2, nearest)])
    assert (formats.unfiltered(mixed, every[mixed, np.arange(9)].astype(np.uint8)) == x).all()


def test_geometry_kinds():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = formats.encode_geopackage("a b", [(3, [[ring]]), (5, [[ring], [ring, ring]]), (7, []), (9, None)])
    found = formats.decode_geopackage(body, "a b")
    assert [fid for fid, _ in found] == [3, 5, 7, 9] and found[3][1] is None
    assert [len(formats.geometry(b)) for _, b in found[:3]] == [1, 2, 0] and len(formats.geometry(found[1][1])[1]) == 2
    mixed = b"GP\x00\x01" + struct.pack("<i", 0) + b"\x01" + struct.pack("<II", 7, 3) + b"\x01" + struct.pack("<Idd", 1, 5, 5) + b"\x01" + struct.pack("<II", 2, 1) + struct.pack("<dd", 1, 1) + formats.wkb([[ring]])
    assert [len(p) for p in formats.geometry(mixed)] == [1]
    assert formats.decode_geopackage(formats.encode_geopackage("none", []), "none") == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", ["0 0.0", "0 1.0"]), ("val", "b", [])], "split string, stem string, rows array<string>")
    (tmp_path / "labels" / "train").mkdir(parents=True)
    (tmp_path / "labels" / "train" / "stale.txt").write_text("x")
    (tmp_path / "labels" / "train" / "kept.json").write_text("x")
    assert writers.write_tree(rows, f"file:{tmp_path}") == 2
    assert (tmp_path / "labels/train/a.txt").read_text() == "0 0.0\n0 1.0\n" and (tmp_path / "labels/val/b.txt").read_text() == ""
    listed = readers.listing(spark, f"file:{tmp_path}").collect()
    assert sorted((r["name"], r["length"]) for r in listed) == [("a.txt", 12), ("b.txt", 0), ("kept.json", 1)]
    assert readers.listing(spark, str(tmp_path / "labels" / "val"), ["png"]).count() == 0
    with pytest.raises(ValueError, match="can't write"):
        writers.write_files(rows, "hdfs://somewhere/x")
    grid = spark.createDataFrame([(1, 0.25, 1.0), (2, 0.5, None), (3, 0.125, 0.5)], "a int, mean_aji double, ridge_level double")
    writers.write_grid(grid, str(tmp_path / "grid"), ["mean_aji"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "grid")).collect() if r["value"][0] != "a") == ["1,0.25000000,1", "2,0.50000000,", "3,0.12500000,0.5"]


def test_dataset_files():
    assert readers.yaml_subset("path: ../d # x\ntrain: 'a b'\nnames:\n  0: p\n  2: \"q\"\n") == ({"path": "../d", "train": "a b"}, {0: "p", 2: "q"})
    assert readers.yaml_subset("names: [a, 'b']\nval: v")[1] == {0: "a", 1: "b"} and readers.yaml_subset("names: {0: a, 1: b}")[1] == {0: "a", 1: "b"}
    assert readers.yaml_subset("names:\n- a\n- b\ntrain: t") == ({"train": "t"}, {0: "a", 1: "b"})
