"""Connected components over an edge table by contraction.

In each round every node hooks onto the neighbour of least rank (a hash, so that long chains of rising names do not
slow it down), then onto that node's own; the edges between what is left make the next, smaller table. A part that is
settled has no edge left and costs nothing more. Nothing is collected: each round is a few joins and aggregations,
written to the shared folder, so lost executors cost at most one round. Both sides of every join are tables as
written, which adaptive execution can split where a node is very common; aggregations combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import stage_table, unstage


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of every node of ``links`` (u, v), and the links between parents."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e"))
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    least = ends.select("e.node", "e.other").groupBy("node").agg(F.min(rank("other")).alias("best"))
    own = F.struct(F.xxhash64("node").alias("col1"), F.col("node").alias("other"))
    near = stage_table(least.select("node", F.when(F.col("best") < own, F.col("best.other")).otherwise(F.col("node")).alias("parent")), "near")
    up = near.select(F.col("node").alias("at"), F.col("parent").alias("above"))
    step = stage_table(near.join(up, near.parent == up.at).select("node", F.col("above").alias("parent")), "step")
    unstage(near)
    a, b = step.select(F.col("node").alias("u"), F.col("parent").alias("pu")), step.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
    moved = links.join(a, "u").join(b, "v").where("pu <> pv")
    return step, stage_table(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``, as a written table; component is the smallest node reachable.

    Self-loops, repeated edges and nulls are allowed; edges with a null end are ignored. An empty table
    gives an empty result. The number of nodes left falls by a constant factor a round, so rounds are O(log nodes).
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    links = stage_table(known.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct(), "links")
    steps: list[DataFrame] = []
    while not steps or not links.isEmpty():
        step, fewer = _contracted(links)
        unstage(links)
        steps.append(step)
        links = fewer
    unstage(links)
    labels = steps[-1].withColumnRenamed("parent", "root")
    for step in reversed(steps[:-1]):
        above = labels.select(F.col("node").alias("at"), "root")
        labels = step.join(above, step.parent == above.at, "left").select("node", F.coalesce("root", "parent").alias("root"))
    labels = stage_table(labels, "labels")
    unstage(*steps)
    smallest = stage_table(labels.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    out = stage_table(labels.join(smallest, "root").select("node", "component"), "components")
    unstage(labels, smallest)
    return out
