"""Total orders without one task: row numbers, shards by row, ordered files, and splits by quota."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.storage import cut


def row_numbers(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """``df`` with exact row numbers from 0 in ``order``: rows are dealt out by ranges of it and sorted there; the parts'
    counts are summed, one row a part. Rows that are equal in all of ``order`` are numbered as they come and, being one
    range, by one task: add a column that tells them apart."""
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts = laid.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    ahead = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__ahead"))
    place = F.col(name) - F.shiftleft(part, 33) + F.col("__ahead")
    return laid.withColumn("__part", part).join(F.broadcast(ahead), "__part").withColumn(name, place).drop("__part", "__ahead")


def row_shards(df: DataFrame, world: int, *order: Column | str) -> DataFrame:
    """``df`` with its ``shard`` of ``world`` and its ``turn`` there: the rows in order are dealt out one by one."""
    return row_numbers(df, *order, name="__row").withColumns({"shard": (F.col("__row") % world).cast("int"), "turn": F.floor(F.col("__row") / world)}).drop("__row")


def write_ordered(df: DataFrame, path: str, *order: Column | str) -> None:
    """JSON lines whose files, by name, and lines are in ``order``."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def _group_hashes(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    now, state, out = None, None, []
    for batch in batches:
        for component, name in zip(batch.column("component").to_pylist(), batch.column("name").to_pylist(), strict=True):
            text = json.dumps(name, ensure_ascii=False)
            if component != now:
                if state is not None:
                    state.update(b"]]")
                    out.append((now, state.hexdigest()))
                now, state = component, hashlib.sha256(f"[{json.dumps(seed)},[{text}".encode())
            else:
                state.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field("component").type), pa.array([r[1] for r in out], pa.string())], ["component", "h"])
        out, kind = [], batch.schema.field("component").type
    if state is not None:
        state.update(b"]]")
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], ["component", "h"])


def quotas(count: int, test: float, validation: float) -> tuple[int, int]:
    """How many of ``count`` groups are for test and for validation: shares rounded half-even, at least one each of three
    or more, one for validation of two, and something left for training."""
    n_test = max(1, round(count * test)) if count >= 3 else 0
    n_validation = max(1, round(count * validation)) if count >= 3 else int(count == 2)
    return max(0, min(n_test, count - n_validation - 1)), n_validation


def quota_splits(members: DataFrame, seed: int, test: float, validation: float) -> DataFrame:
    """(component, split) of groups (component, name): whole groups in the order of the hash of [seed, sorted names], as
    compact JSON; the last ones are test, those before them validation, as many as :func:`quotas` says. A group's names
    are streamed in order into its hash and never gathered; the groups get exact row numbers."""
    kind = dict(members.dtypes)["component"]
    named = members.select("component", "name").distinct().repartition("component").sortWithinPartitions("component", "name")
    hashed = named.mapInArrow(lambda it: _group_hashes(it, seed), f"component {kind}, h string")
    placed = row_numbers(hashed, "h", "component")
    count = placed.count()
    n_test, n_validation = quotas(count, test, validation)
    return placed.select("component", F.when(F.col("row") >= count - n_test, "test").when(F.col("row") >= count - n_test - n_validation, "validation").otherwise("train").alias("split"))


def split_ids(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, sample_id) of samples (sample_id, name) by the split of their name (name, split); those of no or another
    name are for training."""
    return samples.join(splits, "name", "left").select(F.coalesce("split", F.lit("train")).alias("split"), "sample_id")
