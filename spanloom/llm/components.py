"""Connected components of a graph given as a table of edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import join_on, written


def _least(a: Column, b: Column) -> Column:
    return F.when(a <= b, a).otherwise(b)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """node, label: each node of an edge with two ends, and the least node of its component.

    Rows with a null end or two equal ends are no edges. Each round makes every node point to a
    lesser node of its component, by minima that are made before the shuffle and a join on the node
    (nodes of many edges by broadcast), and is written out. The rounds end when all edges point at roots.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = written(e, "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", _least(F.col("u"), F.col("m")))
        large = join_on(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now all edges point down; for each node, its lesser neighbours and itself go to the least of these
        large = written(large, "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_on(large, down, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct()
        new = written(small, "edges")
        # at rest: every node has one edge, and no edge's lower end has one itself
        chained = new.join(new.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count()
        forked = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        e = new
        if not chained and not forked:
            break
    else:
        raise RuntimeError("components did not come to rest")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
