"""Connected components of a link table, distributed.

Every node points to a parent with a smaller or equal id. A round lets each
node see its neighbours' parents, hooks the parent of each node to the smallest
id its children saw, and halves all paths; rounds end when nothing changes.
Each round is a few equi-joins and min-aggregations (combined map-side) whose
result is written to the shared folder, so lineage stays short and a lost
executor costs one round at most. Nothing but the change count reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of one type); root is the smallest id of the component.

    An empty link table gives an empty table; self-links and repeated links are harmless.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(spark, both.distinct(), "component-edges")
    state = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("p"))
    state = written(spark, state, "component-state")
    while True:
        seen = (
            edges.join(state, edges["b"] == state["node"])
            .groupBy(F.col("a").alias("node")).agg(F.min("p").alias("m"))
        )
        low = state.join(seen, "node").select("node", "p", F.least("p", "m").alias("q"))
        hooked = low.groupBy(F.col("p").alias("node")).agg(F.min("q").alias("h"))
        nearer = (
            low.join(hooked, "node", "left")
            .select("node", "p", F.least("q", F.coalesce("h", "q")).alias("q"))
        )
        nearer = written(spark, nearer, "component-hook")
        up = nearer.select(F.col("node").alias("q"), F.col("q").alias("up"))
        step = written(
            spark,
            nearer.join(up, "q", "left").select("node", F.col("p").alias("was"), F.least("q", F.coalesce("up", "q")).alias("p")),
            "component-state",
        )
        changed = step.filter("p <> was").limit(1).count()
        state = step.select("node", "p")
        if not changed:
            return state.select("node", F.col("p").alias("root"))
