"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.llm._arrow import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every end of a link.

    Each round takes the least label among the neighbours and then the label of that label, so that chains shorten by
    half; each round's labels are written to the shared folder. Only a count of changes reaches the driver. Minima are
    taken before the shuffle, so that an end with very many links is no large group.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to"))
    both = stored(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "links")
    labels = stored(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("theirs")), "to").groupBy("id").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = stored(step.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        discard(labels)
        labels = step.select("id", "component")
        if not step.where("was <> component").limit(1).count():
            discard(both)
            return labels
