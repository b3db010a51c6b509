"""Connected components of a link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, staged


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of ``links`` (a, b): label is the smallest id that links reach.

    Each round takes the smallest label among an id's neighbours and then that label's own label, so
    chains halve. All steps are joins and aggregates on one id; a hub's rows can be split by
    adaptive execution. Nothing is collected but one count a round.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = staged(both.filter("u <> v").distinct())
    labels = staged(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    last = labels
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        moved = staged(step.join(jump, "to").select("id", F.least("to", "far").alias("label"), "old"))
        released(last)
        last, labels = moved, moved.select("id", "label")
        if moved.filter("label <> old").isEmpty():
            released(edges)
            return labels
