"""Connected components of an edge table, by alternating large and small stars.

Every round is a pair of joins on the edge table; nothing is collected but counts.
Each round's edges go to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Link the larger (or the smaller-or-equal) neighbours of each node to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    else:
        both = both.filter("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
    # written first: a join of two plain exchanges can be split where a node is hot
    least = scratch.save(least.withColumnRenamed("u", "n"), f"{name}-least")
    linked = both.join(least, both["u"] == least["n"])
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is its least node.

    Rounds end when no edge changes; their number grows with the logarithm of the
    longest path. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    kept = scratch.save(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0"
    )
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
    before = mark(kept)
    for i in range(1, most_rounds + 1):
        if not before[0]:
            break
        middle = scratch.save(_star(kept, scratch, f"large-{i}", True), f"middle-{i}")
        after = scratch.save(_star(middle, scratch, f"small-{i}", False), f"edges-{i}")
        scratch.drop(f"edges-{i - 1}", f"middle-{i}", f"large-{i}-least", f"small-{i}-least")
        kept, last, before = after, before, mark(after)
        if before == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = kept.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
