"""Connected components of links between ids, by contraction rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(id, component_id) for every id in a link; component_id is the smallest id reachable.

    Each round hangs every id under its smallest neighbour, jumps until every id
    points to its tree's root (the depth halves with each jump), and replaces the
    links by those between roots. Every tree has two ids at least, so the ids at
    least halve in each round; nothing but counts and tests for emptiness reaches the driver. The
    minimum is pre-aggregated before each shuffle, so a hub costs no more than
    other ids. Links to itself and nulls are ignored. No links: no rows. rows is the
    number of links, about, if known: small tables aren't written in many files.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows)
    found: DataFrame | None = None
    while n := edges.count():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root"))
        up, moved = cut(up, 2 * n), True
        while moved:
            above = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            up = cut(up.join(above, "root").select("id", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), 2 * n)
            moved = not up.where("moved").isEmpty()
        up = up.select("id", "root")
        left = up.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = cut(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), n)
        if found is None:
            found, ids = up, 2 * n
        else:
            moved = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            found = cut(found.join(moved, "root", "left").select("id", F.coalesce("top", "root").alias("root")), ids)
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return found.select("id", F.col("root").alias("component_id"))
