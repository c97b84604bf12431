"""Connected components of links between integer ids, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (columns u, v): root is the smallest id of
    its component. Links are contracted first: an id keeps the link to its smallest
    neighbour below it, and its other neighbours below are linked to that one, which
    changes no component. A document of a group of copies has many links to the same
    few hubs, so what is left links the hubs; an id that nothing links to from above is
    a leaf, which takes the root of its parent at the end and stays out of the rounds."""
    down = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # one group is the links of one id: at most its bands or blocks
    down = common.stage(down.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m")), "down")
    parents = down.filter("v = m").select("u", F.col("m").alias("v"))
    hubs = down.select(F.col("v").alias("u")).distinct()
    inner = parents.join(hubs, "u", "left_semi").union(down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    roots = spread(inner)
    leaves = parents.join(hubs, "u", "left_anti").select(F.col("u").alias("id"), F.col("v").alias("of"))
    leaves = leaves.join(roots.select(F.col("id").alias("of"), "root"), "of", "left").select("id", F.coalesce("root", "of").alias("root"))
    # a hub without inner links is the smallest id of its component
    alone = hubs.join(roots, hubs["u"] == roots["id"], "left_anti").select(F.col("u").alias("id"), F.col("u").alias("root"))
    return common.stage(roots.unionByName(leaves).unionByName(alone), "roots")


def spread(links: DataFrame) -> DataFrame:
    """(id, root) by rounds of joins. Labels spread to neighbours and then jump to the
    label of the label, so a chain shortens by half a round; every round is written to
    the shared folder. A hub's labels are combined map-side, and its join has one row a
    key on the other side, so a hub can be split."""
    both = links.filter("u <> v").select("u", "v")
    both = common.stage(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = common.stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    while True:
        told = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("told"))
        new = labels.join(told, "u").select("u", "c", F.least("c", "told").alias("t"))
        jump = labels.select(F.col("u").alias("t"), F.col("c").alias("of_t"))
        new = new.join(jump, "t", "left").select("u", F.least("t", "of_t").alias("n"), "c")
        new = common.stage(new.select("u", F.col("n").alias("c"), (F.col("n") != F.col("c")).alias("moved")), "labels")
        if new.filter("moved").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("c").alias("root"))
        labels = new.select("u", "c")
