"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each component of edges (a, b), by alternating large and small stars.

    Each round is written to the shared folder. Least neighbours are pre-aggregated, so a vertex of many edges is no
    single task's work. The number of rounds grows with the logarithm of a component's diameter.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v != m").distinct())
    before = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("to")).select("v", F.least("v", "to").alias("to"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("to").alias("m")).where("v != m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("m"))
        small = large.join(low.withColumnRenamed("m", "to"), "v").select(F.col("m").alias("v"), F.col("to").alias("m")).where("v != m")
        spent, links = links, materialize(small.unionByName(low).distinct())
        release(spent)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    label = links.groupBy("v").agg(F.min("m").alias("label"))
    return label.unionByName(label.select(F.col("label").alias("v"), "label").distinct())


def roots(plan: DataFrame) -> DataFrame:
    """(src, root): the end of each chain of an acyclic plan (src, dst), one dst per src, by pointer doubling."""
    jump = held = materialize(plan.select("src", F.col("dst").alias("root")))
    while True:
        nxt = jump.select(F.col("src").alias("root"), F.col("root").alias("further"))
        moved = materialize(jump.join(nxt, "root", "left").select("src", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(held)
        jump, held = moved.select("src", "root"), moved
        if moved.where("moved").isEmpty():
            return jump
