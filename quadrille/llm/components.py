"""Connected components of a graph in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import drop_written, written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of the edges (a, b), root the smallest node that a path reaches.

    Every node has a parent, at first itself. In a round, each node offers the smallest parent among its neighbours to
    itself and to its parent, which take the smallest offer, and then every parent is replaced by its own parent; so
    the rounds grow with the logarithm of the longest path. The table of a round is written to the shared folder. Null
    ends and an empty table give no rows; repeated edges and edges from a node to itself change nothing.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = written(ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    parents = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("parent")).select(F.col("a").alias("node"), "parent"), f"{label}-parents")
    while True:
        offered = both.join(parents.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("parent").alias("offer"))
        own = parents.join(offered.withColumnRenamed("a", "node"), "node")
        offers = own.select("node", "offer").unionAll(own.select(F.col("parent").alias("node"), "offer")).unionAll(parents.select("node", F.col("parent").alias("offer")))
        hooked = offers.groupBy("node").agg(F.min("offer").alias("up"))
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        short = hooked.join(above, "up").select("node", F.col("top").alias("parent"))
        after = written(short.join(parents.withColumnRenamed("parent", "was"), "node"), f"{label}-parents")
        changed = not after.where("parent <> was").isEmpty()
        drop_written(parents)
        if not changed:
            drop_written(both)
            return after.select("node", F.col("parent").alias("root"))
        kept = after.quadrille_path
        parents = after.select("node", "parent")
        parents.quadrille_path = kept
