"""Union-find over links as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casoteca.sources.workspace import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node hangs its larger (or its smaller and its own) neighbours on the smallest one.

    The smallest neighbour is found with map-side combination; joining it back
    is a plain equality join, whose hot nodes adaptive execution can split.
    """
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    ``links`` has two columns of node numbers; direction, copies, self-links and
    NULLs don't matter. Nodes without links have no row. Every round is written
    to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    a, b = links.columns[:2]
    links = cut_lineage(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                        .where("a != b").distinct())
    before = None
    for _ in range(most_rounds):
        # after a large and a small star all is settled once nothing changes
        links = cut_lineage(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def over_rows(rows: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on rows with an ``id``, row by row where several rows share an id.

    ``run`` takes rows with unique (or NULL) ids and returns id, component_id, kept and other columns.
    If ids repeat, it gets numbers in their place, and a component is named by its smallest id.
    Rows without an id stay without a number.
    """
    if rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return run(rows)
    numbered = cut_lineage(rows.withColumn("number", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())))
    found = cut_lineage(run(numbered.withColumn("id", F.col("number")).drop("number")))
    named = cut_lineage(found.withColumnRenamed("id", "number").join(numbered.select("number", "id"), "number", "left"))
    least = named.where("component_id is not null").groupBy("component_id").agg(F.min("id").alias("least"))
    return named.join(least, "component_id", "left").withColumn("kept", F.col("id") == F.col("least")) \
        .withColumn("component_id", F.col("least")).select(found.columns)
