"""Connected components of graphs, over all groups of keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import cut

def components(edges: DataFrame, keys: list[str], hint: str | None = None) -> DataFrame:
    """(keys, id, root) of every end of an edge (keys, a, b); root is the smallest id reachable.

    Large-star and small-star steps until nothing changes, which they come to on any graph. State stays in the cluster, each round cuts the lineage
    with a reliable checkpoint, and a hub's edges are read by joins that can be split and by sums with map-side
    combining. Edges with a null end or from an id to itself are ignored, repeated ones count once. With the hint "merge" no
    round broadcasts a side that happens to be below the threshold.
    """
    own = {k: f"key_{i}" for i, k in enumerate(keys)}  # other names can't clash
    e = edges.where("a <> b").select(*[F.col(f"`{k}`").alias(x) for k, x in own.items()], F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    keys, names = list(own.values()), {x: k for k, x in own.items()}
    hinted = lambda side: side.hint(hint) if hint else side
    e, before = cut(e), None
    while True:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.where("v > u").join(hinted(least), [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy(*keys, "u").agg(F.min("v").alias("v"))
        moved = e.join(hinted(least.withColumnRenamed("v", "m")), [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(least).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    low = e.groupBy(*keys, "u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    whole = low.unionByName(e.select(*keys, F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    return whole.select(*[F.col(x).alias(k) for x, k in names.items()], "id", "root")
