"""Connected components of a large edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkshelf.llm.columns import dealt_apart
from linkshelf.session import materialize

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``u``, itself included; combined before it is shuffled."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _with_least(edges: DataFrame) -> DataFrame:
    return edges.join(_least(edges), (F.col("u") == F.col("k")) & (dealt_apart("u") == dealt_apart("k")))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: the least node it is connected to.

    Every round joins each edge with its end's least neighbour, so a node with very many edges is split like any skewed
    join key. Rounds are stored in the shared folder; they end when a round changes no edge.
    """
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select("v", "v").distinct().toDF("node", "root"))
        seen = mark
        # Large star: greater neighbours of a node move to its least neighbour.
        two_way = _both(edges)
        large = _with_least(two_way).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lesser neighbours move to the least of them.
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").filter("u <> v").distinct(), "links")
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
