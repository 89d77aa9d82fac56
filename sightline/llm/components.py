"""Connected components of a graph of links, by contraction along smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.hot import hot_join
from sightline.llm.session import kept


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b long); label: the smallest node reachable.

    Each round every node points to its smallest neighbour (partial aggregation,
    so a hub costs one row a task). Circles of such pointers are pairs only, whose
    smaller node becomes a root; the trees are contracted to their roots by pointer
    doubling, and links between roots go on. A tree has two nodes at least, so each
    round leaves half of the nodes at most: rounds, and doublings within one, grow
    with the logarithm of the number of nodes, in whatever order labels lie.

    No task gets a hub's links: what is known of hubs is sent to their links.
    """
    given = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept(given.where("a <> b").distinct(), "links")
    named = lambda df, a, b: df.select(F.col("node").alias(a), F.col("label").alias(b))
    labels = None
    while total := both.count():
        least = kept(both.groupBy("a").agg(F.min("b").alias("p")), "links")
        met = hot_join(least, least.select(F.col("a").alias("p"), F.col("p").alias("pp")), ["p"], total)
        circle = (F.col("pp") == F.col("a")) & (F.col("a") < F.col("p"))
        up = kept(met.select(F.col("a").alias("node"), F.when(circle, F.col("a")).otherwise(F.col("p")).alias("label")), "links")
        moved = True
        while moved:
            step = hot_join(up, named(up, "label", "further"), ["label"], total)
            step = kept(step.select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "links")
            moved, up = step.where("moved").limit(1).count(), step.select("node", "label")
        for side in ("a", "b"):
            both = hot_join(both, named(up, side, "_root"), [side], total).withColumn(side, F.col("_root")).select("a", "b")
        both = kept(both.where("a <> b").distinct(), "links")
        labels = up if labels is None else kept(_relabelled(labels, named(up, "label", "further")), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
    return _relabelled(labels, labels.groupBy("label").agg(F.min("node").alias("further")))


def _relabelled(labels: DataFrame, new: DataFrame) -> DataFrame:
    """node, label with each label replaced by its row in ``new`` (label, further), if it has one."""
    return hot_join(labels, new, ["label"], labels.count(), "left").select("node", F.coalesce("further", "label").alias("label"))
