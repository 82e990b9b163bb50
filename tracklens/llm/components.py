"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import remove, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the least of these."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id that has a link; the root is the least id of its component.

    Links stay distributed; each round is written to the shared folder, so that the
    plan doesn't grow and lost executors cost one round; a round's folder goes after
    the next. Stops when links no longer change: then they are stars around the roots.
    """
    spark, paths = links.sparkSession, []
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "edges", paths=paths)
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before, after = None, state(edges)
    while after[0] and after != before:
        edges = stored(_small_star(_large_star(edges)), "edges", paths=paths)
        remove(spark, paths.pop(0))
        before, after = after, state(edges)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
