"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.blocks import saved


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for links ``a``, ``b``.

    In every round each node takes the least root among its neighbours and then the root of
    that root, until nothing changes; the rounds grow with the logarithm of long chains.
    Each round is written, so a lost executor repeats one round at most.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct()
    both = saved(both, "both")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        taken = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        above = taken.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = saved(taken.join(above, "root").select("node", "was", F.col("above").alias("root")), "roots")
        if not after.where("was != root").head(1):
            return after.select("node", "root")
        roots = after.select("node", "root")
