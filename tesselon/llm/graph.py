"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tesselon.llm.store import Scratch, written


def components(links: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    The result is written to the shared folder, and goes with the caller's ``scratch`` where one is given.

    Alternates large-star and small-star steps until nothing changes.  Each step joins a table with
    its own minima, one row a node, so that a hub's links can be split among tasks.  Every round is
    written to the shared folder, which cuts the lineage; the round before it goes.
    """
    spark = links.sparkSession
    with Scratch(spark) as own:
        edges = own.written(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
        before = None
        for _ in range(most_rounds):
            row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            now = (row.n, row.h)
            if now == before or not row.n:
                break
            before = now
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = _down(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            star = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
            edges = own.written(_down(star), "links")
            own.drop(1)
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        roots = edges.select("v").distinct()
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
        return (scratch.written if scratch else written)(found, "components")


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger node to its smaller."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
