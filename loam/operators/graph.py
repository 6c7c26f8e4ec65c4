"""Graph steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.storage import cut


def one_hop(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Nodes next to ``frontier`` (node) by ``edges`` (src, dst, relation) in either direction and not in it."""
    out = edges.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"), "relation")
    back = edges.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"), "relation")
    return out.unionByName(back).distinct().join(frontier, "node", "left_anti")


def unique_targets(names: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value) of names that stand once: a call by such a name is resolved."""
    return names.groupBy(name).agg(F.count("*").alias("n"), F.first(value).alias(value)).where("n = 1").drop("n")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (u, v): the smallest node that is reachable; nodes without an edge to
    another don't appear. In turns every node's larger neighbours, then its smaller ones, are tied to the least of them:
    rounds are logarithmic in the graph's size, a node's neighbours are never gathered, and each round is cut off from
    the one before, which is then given up."""
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    was, at = None, state(now)
    while at[0] and at != was:
        ends = now.unionAll(now.select("lo", "hi")).toDF("u", "v")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low).distinct()
        before, now = now, cut(small)
        was, at = at, state(now)
        before.unpersist()  # where it is no checkpoint
    return now.toDF("node", "component")


def shared_key_components(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(node, component): nodes that share a value of any of ``keys``, directly or through others, have the smallest
    node. Each value ties its nodes to the least of them: a group costs one row a member, never its pairs."""
    pairs = None
    for k in keys:
        part = rows.where(F.col(k).isNotNull()).select(F.col(node).alias("u"), F.col(k).alias("value"))
        ties = part.join(part.groupBy("value").agg(F.min("u").alias("v")), "value").select("u", "v")
        pairs = ties if pairs is None else pairs.unionAll(ties)
    nodes = rows.select(F.col(node).alias("node")).distinct()
    if pairs is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(components(pairs), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def split_components(label: DataFrame, validation: float, test: float) -> DataFrame:
    """(component, split): whole components by the hash of their number, so that none is in two splits."""
    from loam.functions.text import unit_hash

    h = unit_hash(F.lit("split"), F.col("component"))
    return label.select("component").distinct().withColumn("split", F.when(h < test, "test").when(h < test + validation, "validation").otherwise("train"))
