"""Connected components of a link table, without collecting links anywhere.

Each round contracts the graph: every node takes the smallest label among its neighbours' and its own, then
labels follow their own labels (pointer jumping), and links move to labels until none joins two of them.
A round shuffles the links that are left, pre-aggregated by node, so that a node of very many links is
summed up before it is sent anywhere.

Cases: no links give an empty table; self-links, repeated and reversed links do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small, stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is one node of the component, the same for all its nodes."""
    live = stored(links.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    tables: list[DataFrame] = []
    while live.limit(1).count():
        both = live.union(live.select("b", "a")).toDF("node", "near")
        # hook: each node points to its smallest neighbour if that is smaller, so pointers form a forest
        up = stored(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("up")))
        while True:  # pointer jumping; depth halves each time
            to = small(up.select(F.col("node").alias("mid"), F.col("up").alias("top")))
            jumped = stored(up.join(to, F.col("up") == F.col("mid"), "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("top") < F.col("up")).alias("moved")))
            more = jumped.where("moved").limit(1).count()
            release(up)
            up = jumped
            if not more:
                break
        up = up.select("node", "up")
        tables.append(up)
        left, right = small(up.toDF("a", "ra")), small(up.toDF("b", "rb"))
        moved = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not tables:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = tables[0].toDF("node", "root")
    for up in tables[1:]:
        out = out.join(small(up.toDF("root", "higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return stored(out) if len(tables) > 1 else out
