"""Connected components by alternating large-star and small-star steps on an edge table.

Each step is a ``groupBy(...).min`` (combined before the shuffle) and a join with it, so a node
with very many links is never gathered in one task.  The edges after each round are a table of the
shared folder; the rounds end when a round changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v.  Large: link every larger neighbour of a node to the node's least; small: the others."""
    if large:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (id, component): the least id reachable, for every id of a link between two ids."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == state or not now["n"]:
            break
        state = tuple(now)
        edges = stored(_stars(_stars(edges, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
