"""Labels of blocks and lines: lattice merge, range joins, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_rank(role: Column) -> Column:
    return F.when(role == "CORE", 2).when(role == "SUPPORT", 1).otherwise(0)


def lattice_merge(labels: DataFrame, keys: list[str]) -> DataFrame:
    """One label a key from (role, confidence, seq, source): the highest role, then confidence, then the first; and the
    distinct sources in order of their first appearance. Each source's best and first are found before anything is
    collected, so a key gathers its sources and not its rows."""
    order = F.struct(role_rank(F.col("role")).alias("rank"), "confidence", (-F.col("seq")).alias("minus"))
    each = labels.groupBy(*keys, "source").agg(F.max(F.struct(order.alias("order"), "role")).alias("best"), F.min("seq").alias("first"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"])
    return each.groupBy(*keys).agg(F.max("best").alias("best"), seen.alias("provenance")).select(*keys, "best.role", "best.order.confidence", "provenance")


def smallest_enclosing(points: DataFrame, blocks: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each point (keys, at) with the smallest block (keys, start, stop, container) around it: blocks that are no
    containers first, then the shorter, then the later start. Points and blocks meet by the keys and a bucket of lines."""
    from loam.operators.relations import around

    order = F.struct("container", F.col("stop") - F.col("start"), -F.col("start"))
    return around(points, blocks, keys, at).groupBy(*keys, at).agg(F.min_by(F.struct("start", "stop"), order).alias("block")).select(*keys, at, "block.start", "block.stop")


def dilate(rows: DataFrame, keys: list[str], at: str, mark: str, reach: int) -> DataFrame:
    """``near``: whether a row within ``reach`` rows is marked."""
    return rows.withColumn("near", F.max(mark).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-reach, reach)))


def nearest_marked(rows: DataFrame, keys: list[str], at: str, mark: str, middle: bool = False) -> DataFrame:
    """``distance`` to the nearest marked row of the key: one pass back, one ahead. Where there is none: null, or with
    ``middle`` the distance to the middle row, rows being numbered from 0."""
    w = Window.partitionBy(*keys).orderBy(at)
    spot = F.when(F.col(mark), F.col(at))
    back = F.last(spot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(spot, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col(at) - back, ahead - F.col(at))
    if middle:
        near = F.coalesce(near, F.abs(F.col(at) - F.floor(F.count("*").over(Window.partitionBy(*keys)) / 2)))
    return rows.withColumn("distance", near)


def latest_definition(uses: DataFrame, definitions: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """A backward as-of join: each use (key, at) with the last definition's ``value`` strictly before it."""
    both = uses.select(key, at, F.lit(None).cast(definitions.schema[value].dataType).alias(value), F.lit(0).alias("kind")).unionByName(definitions.select(key, at, value, F.lit(1).alias("kind")))
    w = Window.partitionBy(key).orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("found", F.last(value, ignorenulls=True).over(w)).where("kind = 0").select(key, at, F.col("found").alias(value))


def core_windows(cores: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, first, last) of line windows of at most ``most`` lines around sorted core lines (``line``, of ``n_lines``):
    lines join the window while it stays within ``most``; it is then padded evenly and kept within the file."""
    grouped = cores.groupBy(*keys).agg(F.array_sort(F.collect_set("line")).alias("at"), F.max("n_lines").alias("n"))
    none = F.lit(None).cast("int")
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), none.alias("first"), none.alias("last"))
    def closed(acc: Column) -> Column:
        return F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))))
    # the windows are copied where one ends, not at every line
    def step(acc: Column, x: Column) -> Column:
        grown = F.struct(acc["done"].alias("done"), acc["first"].alias("first"), x.alias("last"))
        return F.when(x - acc["first"] < most, grown).otherwise(F.struct(closed(acc).alias("done"), x.alias("first"), x.alias("last")))
    found = grouped.select(*keys, "n", F.explode(F.aggregate("at", start, step, closed)).alias("w"))
    spare = F.lit(most) - (F.col("w.last") - F.col("w.first") + 1)
    first = F.greatest(F.lit(1), F.least(F.col("w.first") - F.floor(spare / 2), F.col("n") - most + 1)).cast("int")
    return found.select(*keys, first.alias("first"), F.least(first + most - 1, F.col("n")).cast("int").alias("last")).distinct()
