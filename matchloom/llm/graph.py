"""Connected components of a graph whose edges are rows, by alternating large and small stars.

Each round is two aggregations and two joins on node ids; labels and edges stay
distributed, and the edges of a node that many have are dealt to several tasks.
A round's result is staged in the shared folder, so that a lost executor costs
no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import staged


#: Tasks to which the edges of one node are dealt.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` joined with the least neighbour of their ``u``."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each neighbour larger than a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = _with_least(edges, least).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component) for each node that has an edge to another; component is the smallest node it can reach."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = staged(now, name)
    before, here = None, _state(now)
    while here != before and here[0]:
        now = staged(_small_star(_large_star(now)), name)
        before, here = here, _state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
