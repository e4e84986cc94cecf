"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); a component is named by its smallest node.

    Each step takes the smallest label among a node's neighbours and then the
    label of that label, so chains shorten by half or more.  Steps end when no
    label changes; tables stay distributed and each step is written, so
    lineage stays short.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        stepped = written(seen.join(jump, "low").select("node", "before", F.least("low", "further").alias("component")))
        if stepped.where("before <> component").isEmpty():
            return stepped.select("node", "component")
        labels = stepped.select("node", "component")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, component) after more ``links`` (a, b), which may bring new nodes.

    Only links between different components are walked, each component being
    one node of them; where there are none nothing is written but that.
    """
    of = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = written(named.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")).where("a <> b").distinct())
    if apart.isEmpty():
        return classes
    joined = components(apart).select(F.col("node").alias("component"), F.col("component").alias("further"))
    # a component is named by one of its nodes: names that are no classes' component are new nodes
    fresh = joined.join(classes.select("component"), "component", "left_anti").select(F.col("component").alias("node"), "component")
    return written(classes.unionByName(fresh).join(joined, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
