"""Tables in the shared folder, and connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.core import join_facts
from pageloom.session import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write rows to a new folder below ``spark.checkpoint.dir`` and read them back.

    Cuts lineage like a checkpoint, but keeps column pruning and compression.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every id in ``links(a, b)`` with a < b: the smallest id reachable.

    Small-star rounds connect each id's smaller neighbours to the smallest one, until every
    id but a root has one smaller neighbour; then parents are followed, doubling each time.
    Every shuffle is by an id whose rows may be many; those joins can be split by adaptive
    execution, and minima combine before their shuffle. An empty table gives an empty one.
    """
    links = saved(links.select("a", "b").distinct(), "links")
    while True:
        least = links.groupBy("b").agg(F.min("a").alias("m"))
        moved = join_facts(links.select("a", "b"), least, "b", "inner").where("a <> m")
        up = moved.select(F.col("m").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))
        links = saved(least.select(F.col("m").alias("a"), "b", F.lit(False).alias("moved")).union(up).distinct(), "links")
        if links.where("moved").isEmpty():
            break
    parents = links.select(F.col("b").alias("id"), F.col("a").alias("parent"))
    while True:
        above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        moved = saved(join_facts(parents, above, "parent"), "parents")
        if moved.where("above is not null").isEmpty():
            break
        parents = moved.select("id", F.coalesce("above", "parent").alias("parent"))
    roots = parents.select(F.col("parent").alias("id")).distinct()
    return parents.select("id", F.col("parent").alias("component_id")).union(
        roots.select("id", F.col("id").alias("component_id"))
    )
