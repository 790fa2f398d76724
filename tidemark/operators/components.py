"""Connected components by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.work import Work


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node that has an edge with the least node id of its component.

    edges: two columns of long ids; null ends, loops and repeated rows are ignored. Returns
    (node, component). Each round hooks every root to its least neighbouring root, flattens the
    hooks by pointer jumping and contracts the edges, so the rounds are logarithmic in practice;
    links and labels stay in written tables and never reach the driver.
    """
    spark = edges.sparkSession
    work = Work(spark, "components")
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    pairs = work.write(pairs.where("a < b").distinct(), "pairs0")
    both = pairs.select("a").union(pairs.select("b")).distinct()
    labels = work.write(both.select(F.col("a").alias("node"), F.col("a").alias("component")), "labels0")
    n = 0
    while not pairs.isEmpty():
        n += 1
        # the least neighbour of each root: partial aggregation keeps a hub from meeting in one task
        near = pairs.select(F.col("b").alias("root"), F.col("a").alias("to"))
        hooks = work.write(near.groupBy("root").agg(F.min("to").alias("to")), f"hooks{n}")
        step = 0
        while True:
            up = hooks.select(F.col("root").alias("mid"), F.col("to").alias("top"))
            jumped = hooks.join(up, hooks["to"] == up["mid"], "left")
            more = jumped.where("top IS NOT NULL").limit(1).count() > 0
            if not more:
                break
            step += 1
            hooks = work.write(jumped.select("root", F.coalesce("top", "to").alias("to")), f"hooks{n}_{step}")
        h1 = hooks.select(F.col("root").alias("r1"), F.col("to").alias("t1"))
        h2 = hooks.select(F.col("root").alias("r2"), F.col("to").alias("t2"))
        labels = work.write(
            labels.join(h1, labels["component"] == h1["r1"], "left").select("node", F.coalesce("t1", "component").alias("component")),
            f"labels{n}",
        )
        pairs = pairs.join(h1, pairs["a"] == h1["r1"], "left").join(h2, pairs["b"] == h2["r2"], "left")
        pairs = pairs.select(F.coalesce("t1", "a").alias("a"), F.coalesce("t2", "b").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = work.write(pairs.where("a < b").distinct(), f"pairs{n}")
    return labels
