"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import dropped, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): comp is the least id of the component; ids without an edge are absent.

    Alternating large-star and small-star steps until every id but the centres has one link, to a centre: a
    logarithmic number of rounds, each a few shuffles of the edges in which a key's minimum is combined before
    the shuffle; a hub's neighbours are rows of a join, which can be split, and never one group.
    """
    now, before = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), None
    while True:
        now = saved(_star(_star(now, large=True), large=False), "edges")
        if before is not None:
            dropped(before)
        before = now
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("links"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("links"), F.lit(1).alias("centre")))
        if ends.groupBy("x").agg(F.sum("links").alias("links"), F.max("centre").alias("centre")).where("links + centre > 1").isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link every greater neighbour to the least one. Small star: link the lesser ones and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()
