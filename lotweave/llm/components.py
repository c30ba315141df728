"""Connected components of a table of links, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the least node reachable.

    Each round hooks every node to the least of itself and its neighbours, follows those parents
    to their ends, and contracts the links; links inside a tree go.  Rounds are few, since the number
    of linked nodes at least halves, and every round is written to the shared folder.  Least
    neighbours are partial aggregates, so a node with very many links gathers nowhere.
    """
    links = stored(links.filter("a is not null and b is not null and a != b").select("a", "b").distinct(), "links")
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "parent"
        )
        parent = _to_the_end(parent)
        roots = parent if roots is None else stored(_through(roots, parent), "roots")
        to = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        hooked = links.join(to, "a").select("ra", "b").join(to.toDF("b", "rb"), "b")
        links = stored(hooked.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    return links.toDF("node", "root") if roots is None else roots


def _to_the_end(parent: DataFrame) -> DataFrame:
    """Follow parents until they no longer change; parents are smaller, so this ends."""
    while True:
        up = parent.toDF("root", "above")
        moved = stored(
            parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")),
            "parent",
        )
        parent = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return parent


def _through(roots: DataFrame, parent: DataFrame) -> DataFrame:
    """Roots found so far, led on by the new round; nodes of the new round are roots already known."""
    up = parent.toDF("root", "above")
    return roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
