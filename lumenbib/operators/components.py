"""Connected components of an edge list, by alternating large-star and small-star steps.

Both steps are one aggregation and one join over the edges; a component of any diameter settles in O(log^2 n) rounds
and no neighbourhood is ever gathered in one task, so a node with a third of all edges is only a large group of a
partial aggregation. Lineage is cut after each round by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Edges (a, b) of any orderable type -> (node, component): component is the smallest node that node can reach.

    Edges with a null end and loops tie nothing together and are left out; repeated edges count once; nodes that occur
    in no other edge give no row; an empty edge list gives an empty result.
    """
    kind = edges.schema[a].dataType
    cur = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    cur = cut(cur)
    for _ in range(max_rounds):
        # large star: every node sends its larger neighbours to the smallest node around it
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node sends its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # settled: every node has one edge and no target has an edge of its own
        unsettled = nxt.select(F.col("v").alias("u")).join(nxt.select("u"), "u", "left_semi").limit(1).count()
        doubled = 0 if unsettled else nxt.groupBy("u").count().filter("count > 1").limit(1).count()
        cur = nxt
        if not unsettled and not doubled:
            break
    else:
        raise RuntimeError("connected_components did not settle")
    stars = cur.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
