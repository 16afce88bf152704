"""Connected components of a graph given as edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import in_few, materialise, remove, settle


PER_TASK = 1 << 17


def spread(both: DataFrame, labels: DataFrame, nodes: int) -> DataFrame:
    """One round: every node takes the least label of itself and its neighbours, then that label's label.

    both: edges in both directions (u, v). labels: (u, label), a row for each node.
    """
    near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("label"))
    least = materialise(in_few(labels.unionByName(near).groupBy("u").agg(F.min("label").alias("label")), nodes, PER_TASK))
    of = least.select(F.col("u").alias("label"), F.col("label").alias("up"))
    return settle(in_few(least.join(of, "label").select("u", F.col("up").alias("label")), nodes, PER_TASK), "labels")


def components(edges: DataFrame) -> DataFrame:
    """(u, label): the least node reachable from each node that has an edge. edges: (a, b) longs, any direction, repeats allowed.

    Each round writes its labels to the shared folder, so a lost executor costs one round at most.
    """
    turned = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).filter("u != v").distinct()
    rows = 2 * edges.count()
    both = settle(in_few(turned, rows, PER_TASK), "edges")
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
    labels = settle(in_few(labels, rows, PER_TASK), "labels")
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first()  # noqa: E731  labels only fall, so their sum shows any change
    before = sign(labels)
    nodes = before[0]
    while True:
        after_labels = spread(both, labels, nodes)
        remove(labels)
        labels, after = after_labels, sign(after_labels)
        if after == before:
            remove(both)
            return labels
        before = after
