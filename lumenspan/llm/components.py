"""Connected components of a link table, distributed (alternating large and small stars).

Every round is two aggregations by node with map-side combination and two joins; hubs cost no more than their
links. Rounds grow with the logarithm of the longest chain. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import Scratch, remove, saved


def _star(links: DataFrame, keep: str) -> DataFrame:
    """Point each kept neighbour at the smallest of a node's neighbours (and the node)."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if keep == "larger":
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(u long, v long)`` links, any order, repeats and loops allowed → ``(node, root)``.

    ``root`` is the smallest node of the component. Nodes without a link to another node give no row; null ends
    are no link. An empty table gives an empty table. The result is a table that goes with ``scratch``, or with the
    application.
    """
    ends = links.where("u is not null and v is not null and u <> v")
    now, uri = saved(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark or not seen["n"]:
            if scratch is not None:
                scratch.uris.append(uri)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        large = _star(both, "larger").where("u <> v").distinct()
        small = _star(large, "smaller").where("u <> v").distinct()
        before = uri
        now, uri = saved(small, "links")
        remove(now.sparkSession, before)
