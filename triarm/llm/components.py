"""Connected components of links between numbered nodes, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from triarm.sources.scratch import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """``node, component`` for every node of ``links(a, b)`` that is linked to another; the smallest node names it.

    Each round hangs neighbours onto the smallest node near them, first the larger ones, then the smaller;
    the number of rounds grows with the logarithm of the graph. The links of a round are written to the shared
    folder, so a lost executor costs one round. A node with very many links is summed up on the map side, and
    its links are split among tasks by adaptive execution. No links give no rows; NULL ends are left out.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, name)
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        # Larger neighbours of a node go to the smallest node near it.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        # Smaller neighbours of a node, and the node, go to the smallest of them.
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v"), F.col("v")).distinct())
