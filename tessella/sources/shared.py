"""Checkpoints and tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where driver and executors are one process, as in tests."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    root(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, by: list[str] | None = None, kind: str = "parquet", path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Write a table, partitioned by columns, and read it with the same schema."""
    path = path or folder(df.sparkSession)
    df.write.format(kind).mode(mode).partitionBy(*(by or [])).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def add_missing(cache: str, rows: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key the cached table doesn't have yet, and give the whole table."""
    spark = rows.sparkSession
    have = spark.read.schema(rows.schema).parquet(cache)
    rows.join(have.select(key).distinct(), key, "left_anti").select(*have.columns).write.mode("append").parquet(cache)
    return spark.read.schema(rows.schema).parquet(cache)
