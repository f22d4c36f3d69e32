"""Connected components of a table of links, by label propagation with pointer jumping.

Links and labels stay in tables; each round is written to the shared folder, so a lost executor repeats one round at
most. The driver sees one number a round: whether a label changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable from each id in links (a, b); direction does not matter.

    Null ends and loops are ignored; repeated links count once. No links: no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = scratch.write(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = scratch.write(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels-0")
    turn = 0
    while True:
        turn += 1
        seen = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("low"))
        roots = labels.select(F.col("id").alias("low"), F.col("label").alias("root"))  # the label of the label
        jumped = lower.join(roots, "low", "left").select("id", F.least("low", F.coalesce("root", "low")).alias("label"), F.col("label").alias("old"))
        out = scratch.write(jumped, f"labels-{turn}")
        changed = out.where("label <> old").limit(1).count()
        labels = out.select("id", "label")
        scratch.drop(f"labels-{turn - 1}")
        if not changed:
            scratch.drop("edges")
            return labels.withColumnRenamed("label", "component")
