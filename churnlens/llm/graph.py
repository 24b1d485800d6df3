"""Connected components of a links table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(``id``, ``component``): the smallest id reachable, for every id in (``a``, ``b``).

    Links are contracted round by round: each id moves to the one with the smallest hash among itself and its
    neighbours, links are redrawn between the ids moved to, and those within one id go. Hashes, not ids, make the
    order, so a chain shrinks by half a round whatever its ids are; a star is gone after one. Minima are aggregated
    before they are shuffled and links are joined from stored tables, so an id with a third of all links is no
    task of its own. Null ids link nothing; an empty table gives no rows.
    """
    edges = stored(links.filter("a is not null and b is not null and a <> b")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    placed: DataFrame | None = None
    while True:
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        ends = edges.select(F.col("a").alias("id"), key("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), key("a").alias("other")))
        moves = stored(ends.groupBy("id").agg(F.min("other").alias("other"))
                       .select("id", F.least(key("id"), F.col("other"))["id"].alias("to")), "moves")
        if placed is None:
            placed = moves.select("id", F.col("to").alias("root"))
        else:
            again = moves.select(F.col("id").alias("root"), "to")
            placed = placed.join(again, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        at_a, at_b = moves.select(F.col("id").alias("a"), F.col("to").alias("new_a")), moves.select(F.col("id").alias("b"), F.col("to").alias("new_b"))
        edges = stored(edges.join(at_a, "a").join(at_b, "b").filter("new_a <> new_b")
                       .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    placed = stored(placed, "placed")
    smallest = stored(placed.groupBy("root").agg(F.min("id").alias("component")), "smallest")
    return placed.join(smallest, "root").select("id", "component")
