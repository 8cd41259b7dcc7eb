"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.operators.scratch import durable


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``links`` (long columns ``a`` and ``b``).

    Each round points all larger neighbours of a node, then the node and its smaller ones, at the smallest of them, until
    nothing changes. A round is two aggregations with map-side minima and two joins; its links are written to the shared
    folder, so lineage stays short and a lost executor costs one round at most. Links to itself and repeated links do no
    harm; nulls are left out. Only two numbers a round reach the driver.
    """
    links = links.where(F.col("a") != F.col("b"))
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = durable(links, "links"), None
    while (now := _state(links)) != before:
        before = now
        links = durable(_small_star(_large_star(links)), "links")
    roots = links.select("b", "b").distinct()  # each component's links are a star around its root by now
    return links.union(roots).toDF("node", "root")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """``links`` have a > b. Each node's larger neighbours, pointed at the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, pointed at the smallest of these."""
    pointed = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pointed.groupBy("u").agg(F.min("v").alias("m"))
    moved = pointed.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).where("a != b").distinct()
