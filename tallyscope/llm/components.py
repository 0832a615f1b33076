"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``; label is the smallest node reachable.

    Every round hooks each label to its smallest neighbour, flattens the hooks
    by pointer jumping and contracts the links, so even a node with very many
    links is only ever the key of a minimum, which is combined before the shuffle.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    left = materialize(both, "links")
    labels = None
    while True:
        pairs = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "hooks")
        if not hooks.take(1):
            break
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("top"))
            jumped = materialize(hooks.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "jumps")
            hooks = jumped.select("node", "label")
            if not jumped.where("moved").take(1):
                break
        if labels is None:
            labels = hooks
        else:
            new = hooks.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = materialize(labels.join(new, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        a, b = hooks.select(F.col("node").alias("a"), F.col("label").alias("la")), hooks.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = materialize(left.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct(), "links")
    return hooks if labels is None else labels
