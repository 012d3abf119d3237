"""Connected components of an edge table by alternating large-star and small-star steps.

Each step hangs every vertex on the smallest vertex it can see; steps repeat until the
table doesn't change, about log2 of the longest path times.  Every step is a
grouped minimum (partial aggregation) and a join of two written tables, which
adaptive execution can split at a hub.  Each step's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with v < u, hung on the least neighbour: of larger vertices, or of a vertex and its smaller ones."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = staged(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    met = seen.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(doc_id, component) for every vertex of (a, b) edges; a component is named by its smallest vertex."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = staged(_star(staged(_star(now, True), "large-star"), False), "small-star")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("doc_id")).distinct().withColumn("component", F.col("doc_id"))
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(roots)
