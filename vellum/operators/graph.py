"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.skew import salted_join
from vellum.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; edges: (a, b); root: the smallest node of the component.

    Large-star and small-star alternate until the edges are stars; each round is cut to the shared folder,
    so lineage stays short and a lost executor costs one round at most. Nothing but a checksum reaches the driver.
    A hub's neighbours are dealt to several tasks.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:  # the rounds grow with the square of the logarithm of the longest chain
        # large-star: larger neighbours are hooked onto the smallest of a node's neighbours and itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node and its smaller neighbours are hooked onto the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        edges = cut(salted_join(large, least, ["a"], ["b"]).select(ends.alias("e")).select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
