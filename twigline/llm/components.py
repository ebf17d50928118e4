"""Connected components of a table of links, by alternating star contraction.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): large-star and small-star steps, each a
group-by and a join, until the links form stars around the smallest node of every component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigline.llm.common import staged


def _oriented(links: DataFrame) -> DataFrame:
    """Links as (big, small), each once, without loops."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter("v > u")
    return _oriented(larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node of its component.

    ``links`` has comparable, non-null columns u and v; repeated links and loops are allowed.  Every round is written
    to the shared folder.  Stops when a round changes nothing; raises if that takes over ``max_rounds``.
    """
    now = staged(_oriented(links), "links-0")
    mark = None
    for k in range(1, max_rounds + 1):
        now = staged(_small_star(_large_star(now)), f"links-{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        mark = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
