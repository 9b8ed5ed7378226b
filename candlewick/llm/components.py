"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.storage import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours onto the smallest one known.

    ``edges`` has (a, b) with a > b.  The large step gives every neighbour above
    a node to the smallest of the node and its neighbours; the small step gives
    the node and its smaller neighbours to the smallest of those.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(turned) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node reachable.

    ``links`` has two columns of node ids, in any order and with repeats; loops
    and nulls are ignored.  An empty table gives an empty one.  The state of each
    round is stored in the shared folder; the rounds grow with the logarithm of
    a component's length, and end when a round changes nothing.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    edges = (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), a.alias("x"), b.alias("y"))
        .where("x is not null and y is not null and a > b")
        .select("a", "b")
        .distinct()
    )
    edges = settle(edges)
    mark = None
    while True:
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if (now["n"], now["s"]) == mark or not now["n"]:
            break
        mark = (now["n"], now["s"])
        edges = settle(_star(_star(edges, large=True), large=False))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
