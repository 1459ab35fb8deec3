"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (columns a, b, of one type): one root a component.

    In each round every node joins its neighbour that comes first in a random order (a hash
    of the id), links are rewritten and loops dropped; a component shrinks by a constant
    factor a round in expectation, so a few rounds do. Minima are partially aggregated and
    joins are between written tables, so that a node with very many links is split. Roots
    are members of their components; an empty table gives an empty one.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("o"), F.col(c).alias("v"))
    links = materialise(links.where("a <> b").select("a", "b").distinct(), "cc-links")
    roots, turn = None, 0
    while roots is None or not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(first("b")).alias("m"))
        near = materialise(near.select("a", F.least(first("a"), F.col("m"))["v"].alias("p")), "cc-step")
        if roots is None:
            roots = near.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            step = near.select(F.col("a").alias("root"), F.col("p").alias("_p"))
            roots = materialise(roots.join(step, "root", "left").select("id", F.coalesce("_p", "root").alias("root")), "cc-roots")
        by_b = links.join(near.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").select("a", "pb")
        moved = by_b.join(near.select("a", F.col("p").alias("pa")), "a").where("pa <> pb")
        links = materialise(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-links")
        turn += 1
    return roots
