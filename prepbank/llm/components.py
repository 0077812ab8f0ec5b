"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepbank.session import materialize

ROUNDS = 50


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Alternating large and small stars: each round hangs the neighbours of a node on the smallest of them, with a
    minimum (pre-aggregated) and a join by node, and is written to the shared folder, which cuts the lineage. The
    number of rounds grows with the logarithm of a component's size. Nothing but two sums comes to the driver, and no
    node's neighbours are gathered in a row.
    """
    edges = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(ROUNDS):
        # Large star: larger neighbours of u, and u itself, go to the smallest of u's neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = _minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(best, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of these.
        best = _minima(large)
        small = large.join(best, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where(F.col("u") != F.col("v")).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
