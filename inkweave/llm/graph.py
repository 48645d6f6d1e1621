"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, drop_steps


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie the smaller neighbours of each node, and the node, to its smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    # One branch of the plan for both kinds of links.
    ties = F.array(F.struct("a", F.col("m").alias("b")), F.when(F.col("b") > F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return edges.join(least, "a").select(F.explode(ties).alias("t")).filter("t is not null").select("t.a", "t.b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link up, or has links down only."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("up")))
    return ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most")).filter("least < most").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for links in columns ``a, b``.

    Alternates large and small stars; the smallest neighbour comes from a partial aggregate
    and the joins can be split where a node has very many links.  Each star is written down, for a
    plan of both would hold the first several times.  Nodes without a link to
    another node are left out.  Nulls and loops are ignored; an empty table gives none.
    """
    edges = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a > b")
        .distinct(),
        "stars",
    )
    while not _are_stars(edges):
        large = cut_lineage(_large_star(edges).distinct(), "stars")
        small = cut_lineage(_small_star(large).distinct(), "stars")
        drop_steps(edges, large)
        edges = small
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
