"""Connected components of a link table by large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import Tables


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (large star) or smaller (small star) neighbours to its smallest one, itself included.

    The smallest neighbour is a minimum that tasks combine first, and the neighbours are joined to it, not collected,
    so no node needs its links in one place.
    """
    if large:
        directed = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        directed = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = directed.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = directed.join(smallest, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            smallest.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(tables: Tables, links: DataFrame, name: str = "stars") -> DataFrame:
    """Each linked node (``a``) with the smallest node of its component (``b``); nodes without links are absent.

    The smallest node of a component itself is absent too.  Rounds grow with the logarithm of the longest chain.
    """
    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current = tables.replace(name, links)
    state = signature(current)
    while state[0]:
        current = tables.replace(name, _star(_star(current, True), False))
        if (new := signature(current)) == state:
            break
        state = new
    return current
