"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import made, remove, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; ``component`` is the smallest node reachable.

    A round links, for each node, its larger neighbours to its smallest one and
    then its smaller neighbours to the smallest; trees get flat in a number of
    rounds that grows with the logarithm of their depth.  Minima are combined
    before the shuffle, so a node that everything links to costs its task no
    more than others; rounds are written to the shared folder, where each replaces
    the one before, and only their counts come to the driver.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    current = stored(links.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "links")
    seen = None
    while True:
        before = made()[-1:]
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct(), "links")
        remove(links.sparkSession, [*before, made()[-2]])
        sign = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
