"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import compacted


def components(links: DataFrame) -> DataFrame:
    """v and component (the smallest vertex reachable) of all vertices of ``links`` (a, b).

    Labels fall to the least label of a neighbour, then to the label of their label, until none
    changes; the second step halves long chains. Each round is written to the shared folder.
    Neighbours are never gathered in lists: the least label is aggregated before rows are shuffled.
    """
    both = compacted(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct())
    labels = compacted(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("component")))
    while True:
        offered = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("component").alias("m"))
        lower = labels.join(offered, "v").select("v", F.least("component", "m").alias("l"), F.col("component").alias("old"))
        jump = labels.select(F.col("v").alias("l"), F.col("component").alias("next"))
        new = compacted(lower.join(jump, "l").select("v", F.least("l", "next").alias("component"), "old"))
        labels = new.select("v", "component")
        if new.where(F.col("component") < F.col("old")).isEmpty():
            return labels
