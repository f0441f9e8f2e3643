"""Connected components of an edge table, as rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` that is not the smallest of its component;
    ``component`` is the smallest node. Loops (a = b) and rows with a null are ignored.

    Alternates the two star steps of Kiveris et al. (2014) until the edges are stars: a logarithmic
    number of rounds, each a few shuffles of the edge table. A node with very many edges is one
    pre-aggregated row on the grouped side. Rounds and grouped sides are cut with ``checkpoint()``:
    the join back to the edges then has a plain shuffle on either side, and adaptive execution can
    split a node that holds a large part of the edges."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and u is not null and v is not null").distinct()
    e, before = cut_lineage(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
