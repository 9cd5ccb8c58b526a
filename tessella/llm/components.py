"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import graph


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that has a link; component_id is the smallest id reachable."""
    return graph.components(links.select(F.col(a).alias("a"), F.col(b).alias("b")), []).withColumnRenamed("root", "component_id")
