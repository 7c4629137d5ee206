"""Connected components of a link table as alternating star contractions.

Only DataFrame joins and aggregates: neither the links nor the components are
ever brought to the driver.  A hub with a third of all links is no problem: the
minimum of its neighbours is a map-side combined aggregate, and the join that
hands the minimum back is a sort-merge join whose large side adaptive execution
may split.  Lineage is cut after every round by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._store import drop_stored, stored


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and exclusive-or of two hashes of the distinct edges: of any number of them without overflow."""
    return tuple(edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.bit_xor(F.xxhash64("v", "u")).alias("g")).first())


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node reachable.

    Nulls and self links are ignored; repeated links count once; an empty table
    gives an empty table.  Raises if ``max_rounds`` do not reach the fixed point
    (rounds grow with the logarithm of the longest path).
    """
    pair = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a != b")
    edges = stored(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _fingerprint(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        pulled = large.join(low, F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(pulled.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        after = _fingerprint(small)
        drop_stored(large)
        drop_stored(edges)
        edges, done = small, after == before
        before = after
        if done:
            break
    else:
        raise RuntimeError("connected components did not converge")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
