"""Connected components by frontier breadth-first search from many seeds at once.

Adjacency lists are hash-partitioned by node and cut into chunks, so that no list grows with its
node's degree. The seeds are the nodes whose hash is below that of all their neighbours, so every
component has one, and a walk to the nearest is short whatever the nodes are called. All seeds expand concurrently, a level at a time; where two seeds meet, their pair goes into a
smaller graph, whose components are found the same way. Everything stays in tables; the driver sees
only counts. A level writes what it reached and what is new; where seeds met is read from these at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import Scratch

CHUNK = 1000  # neighbours in one piece of an adjacency list


def _adjacency(both: DataFrame) -> DataFrame:
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    chunk = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / CHUNK)).cast("int")
    return both.join(degree, "src").groupBy("src", chunk.alias("chunk")).agg(F.collect_list("dst").alias("near"))


def connected_components(spark: SparkSession, edges: DataFrame, depth: int = 0) -> DataFrame:
    """(node, component) of each node of `edges` (a BIGINT, b BIGINT); component is one of its nodes, the same on every run.

    Null ends, loops and repeated edges count for nothing. An empty table gives an empty table.
    """
    keep = Scratch(spark, f"components{depth}")
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = keep.put(pairs)
    both = pairs.selectExpr("a AS src", "b AS dst").unionAll(pairs.selectExpr("b AS src", "a AS dst"))
    near = keep.put(_adjacency(both))
    order = lambda c: F.struct(F.xxhash64(F.lit(depth), c).alias("h"), c.alias("n"))
    nodes = near.groupBy("src").agg(F.min(F.array_min(F.transform("near", order))).alias("least"))
    labels = keep.put(nodes.where(order(F.col("src")) < F.col("least")).selectExpr("src AS node", "src AS seed", "0 AS level"))
    if labels.isEmpty():
        return labels.selectExpr("node", "seed AS component")
    steps: list[DataFrame] = []
    level = 0
    while True:
        reach = (
            labels.where(F.col("level") == level)
            .join(near, F.col("node") == F.col("src"))
            .select(F.explode("near").alias("node"), "seed")
            .distinct()
        )
        step = keep.put(reach.join(labels.selectExpr("node", "seed AS had"), "node", "left"))
        first = keep.put(step.where("had IS NULL").groupBy("node").agg(F.min("seed").alias("seed")).withColumn("level", F.lit(level + 1)))
        owner = first.selectExpr("node", "seed AS won")
        steps.append(step.where("seed <> had OR had IS NULL").join(owner, "node", "left").selectExpr("seed AS a", "coalesce(had, won) AS b"))
        if first.isEmpty():
            break
        labels = labels.unionAll(first)
        level += 1
    met = steps[0]
    for more in steps[1:]:
        met = met.unionAll(more)
    small = keep.put(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if small.isEmpty():
        return labels.selectExpr("node", "seed AS component")
    merged = connected_components(spark, small, depth + 1).selectExpr("node AS seed", "component AS merged")
    return keep.put(labels.join(merged, "seed", "left").selectExpr("node", "coalesce(merged, seed) AS component"))
