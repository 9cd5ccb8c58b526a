"""The one stream there is: lines come, noise is dropped, the rest goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.fixed import NOISE_PATTERNS
from tessella.operators.catalog import drop_noise


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    return spark.readStream.format("text").load(folder)


def filter_lines(lines: DataFrame, patterns: list[str] = NOISE_PATTERNS) -> DataFrame:
    """A stateless filter: the same plan on a stream and on a table."""
    return drop_noise(lines, patterns)


def write_lines(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to text files, all that is there now; the checkpoint lets a lost run go on where it stopped."""
    return lines.writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
