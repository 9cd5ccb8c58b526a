"""Sinks: files of any format written by tasks, label trees, annotations, settings and tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_path(folder: str) -> str:
    """The path of a folder that tasks can open; other stores than mounted ones are an error, as Spark has no sink for single files there."""
    scheme, colon, rest = folder.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"tasks can't write files to {scheme}:")
    return "/" + rest.lstrip("/") if colon else folder


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write a file by row below a shared folder and give their number; a file appears whole or not at all, so a task may run again.

    A task holds one batch of contents; a name may have folders.
    """
    top = local_path(folder)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(top, x)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{path}.{uuid.uuid4().hex}.draft"
                with open(draft, "wb") as f:
                    f.write(body)
                os.replace(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(top, exist_ok=True)
    chosen = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return chosen.mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_tree(rows: DataFrame, folder: str) -> int:
    """Export label texts (split, stem, rows: array of lines) as ``labels/{split}/{stem}.txt``; label files that were there before are cleared.

    A file with rows ends with a line end, one without is empty.
    """
    top = local_path(folder)
    for base, _, names in os.walk(os.path.join(top, "labels")):
        for x in names:
            if x.endswith(".txt"):
                os.unlink(os.path.join(base, x))
    text = F.when(F.size("rows") > 0, F.concat(F.concat_ws("\n", "rows"), F.lit("\n"))).otherwise("")
    return write_files(rows.select(F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")).alias("name"), text.alias("content")), folder)


def annotation(counts: Column, size: tuple[int, int], area: Column, bbox: Column, tile_x: Column, tile_y: Column) -> Column:
    """A mask's annotation as JSON."""
    rle = F.struct(F.array(F.lit(size[0]), F.lit(size[1])).alias("size"), counts.alias("counts"), F.lit("C").alias("order"))
    return F.to_json(F.struct(rle.alias("rle"), area.alias("area"), bbox.alias("bbox"), tile_x.alias("tile_x"), tile_y.alias("tile_y")))


def write_grid(rows: DataFrame, path: str, scores: list[str], ridge: str = "ridge_level") -> None:
    """A tuning table as CSV: scores with eight decimals, a ridge in its shortest form, blank where it is automatic."""
    shortest = F.regexp_replace(F.col(ridge).cast("string"), r"\.0$", "")
    cells = [F.format_string("%.8f", F.col(c)).alias(c) if c in scores else F.coalesce(shortest, F.lit("")).alias(c) if c == ridge else F.col(c) for c in rows.columns]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
