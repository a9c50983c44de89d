"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.session import cut_lineage

NATURAL = 4


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """(``node``, ``root``) for each node of an edge; nodes of one component have one root, a node of it.

    In each round every node moves to its neighbour (or itself) that comes first: in the order of nodes in the first rounds, so
    that stars round their first node are done at once, and then in an order that is random for the round, so that the number
    of nodes falls by a constant factor whatever their names.  Edges and nodes stay tables; a node with many edges is one row of a
    partial aggregate, and joins on it are split by the planner.  Null ends and loops are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e, "edges")
    nodes = cut_lineage(e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("root", F.col("node")), "nodes")
    for n in range(most_rounds):
        if e.isEmpty():
            return nodes
        both = e.union(e.select("v", "u"))
        rank = lambda c, n=n: F.struct((F.lit(0).cast("long") if n < NATURAL else F.xxhash64(F.lit(n), c)).alias("h"), F.col(c).alias("x"))
        moved = both.groupBy("u").agg(F.min(rank("v")).alias("best")).select("u", F.least("best", rank("u"))["x"].alias("to"))
        moved = cut_lineage(moved.where("u <> to"), "moved")
        one, two = (moved.select(F.col("u").alias(k), F.col("to").alias(t)) for k, t in (("u", "tu"), ("v", "tv")))
        e = cut_lineage(e.join(one, "u", "left").join(two, "v", "left").select(F.coalesce("tu", "u").alias("u"), F.coalesce("tv", "v").alias("v"))
                        .where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        nodes = cut_lineage(nodes.join(moved.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "nodes")
    raise RuntimeError("components did not converge")
