"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_scratch, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b), a > b.

    Large: each node's larger neighbours are linked to its least neighbour or itself. Small: each node and
    its smaller neighbours are linked to the least of them. The least neighbour is an aggregate with
    partial sums and comes back by a join, so a node with very many links is never gathered. The links
    given are deleted.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
        out = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = stored(links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), "least")
        out = links.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    out = stored(out.where("a > b").distinct(), "links")
    drop_scratch(tables=[low, links])
    return out


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of the links (a long, b long) with the least node of its component.

    Direction, repeats and self-links don't matter; a node with self-links only is not returned. The
    number of rounds grows with the logarithm of the longest path; each round is written to the shared
    folder. No links give an empty table.
    """
    cur = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = _mark(cur)
        if now == before or not now[0]:
            break
        before = now
        cur = _star(_star(cur, True), False)
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """A fingerprint of a link table: links, and hashes of all of them together."""
    r = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
    return tuple(r)
