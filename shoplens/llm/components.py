"""Connected components of an edge list, by contraction; no node or edge list leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    A round points each node to its smallest neighbour, follows the pointers until they end
    (they only ever go to smaller nodes), and contracts the edges to those ends. The ends of
    a round are local minima, at most half of its nodes, so the rounds are logarithmic in the
    number of nodes; so are the pointer steps of a round. Null and self edges are ignored.
    """
    spark = edges.sparkSession
    left = staged(edges.select("a", "b").where("a <> b"), "edges")
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                    .select("node", F.least("node", "low").alias("to")), "pointers")
        while True:
            ends = to.select(F.col("node").alias("at"), F.col("to").alias("further"))
            jumped = staged(to.join(ends, F.col("to") == F.col("at"))
                            .select("node", F.col("further").alias("to"),
                                    (F.col("further") != F.col("to")).alias("moved")), "pointers")
            to = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        step = to.select(F.col("node").alias("at"), "to")
        if found is None:
            found = to.withColumnRenamed("to", "component")
        else:  # nodes that are ends of earlier rounds go on to where those point now
            found = staged(found.join(step, F.col("component") == F.col("at"), "left")
                           .select("node", F.coalesce("to", "component").alias("component")), "components")
        a = left.join(step, F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
        left = staged(a.join(step, F.col("b") == F.col("at")).select("a", F.col("to").alias("b"))
                      .where("a <> b").distinct(), "edges")
    if found is None:
        return spark.createDataFrame([], "node long, component long")
    return found
