"""Connected components of links between long ids, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is joins and group-bys over the link table; nothing is collected but its row count and checksum. A hot vertex
is split by the skew join, for which both sides of each join come straight from an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.common import cut


def _least(links: DataFrame) -> DataFrame:
    """The smallest neighbour of each u; dealt round robin, so that the join above gets its own exchange and can split hot keys."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.groupBy("u").agg(F.min("v").alias("least")).repartition(parts)


def _round(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("v"))
    moved = large.join(_least(large), "u").where("v <> least").select(F.greatest("v", "least").alias("u"), F.least("v", "least").alias("v"))
    return moved.unionByName(least).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """links: pairs of long ids. Returns (id, root) for every linked id that is not the smallest of its component, its root.

    Self-links and null ends count for nothing; an empty table gives an empty table.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())
    before = sign(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        now = cut(_round(now), "links")
        after = sign(now)
        if after == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("the components did not settle")
