"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import components, stash

#: Leading principal dimensions that make the grid and the boxes, and those of the first look at a pair of vectors.
DIMS, LOOK = 16, 24
#: Vectors of a block, and children of a node of the recursion: its lowest nodes are intervals of so many blocks.
BLOCK, FAN = 512, 16
#: Intervals of a group, whose blocks a task holds: some 150 MB for 64 dimensions.
GROUP = 16
#: Share of a pair of blocks' vectors up to which those that the first look leaves are computed one by one.
FEW = 0.03


def _clean(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors in double precision; None for null, empty or zero ones and those with null or non-finite parts."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.array(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vs = _clean(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([None if v is None else len(v) for v in vs], pa.int32()), pa.array([None if v is None else (v + 0.0).tobytes() for v in vs], pa.binary())], ["vec_id", "dim", "raw"])


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
    for batch in batches:
        x = unit(batch.column("raw").to_pylist(), dim) if batch.num_rows else np.zeros((0, dim))
        n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
    flat = np.concatenate([[n], first, second.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["k", "x"])


def principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """The principal directions of the unit vectors (dim x dim), leading ones first, from sums over all of them."""
    sums = vectors.mapInArrow(lambda it: _moments(it, dim), "k int, x double").groupBy("k").agg(F.sum("x")).orderBy("k").toPandas().to_numpy()[:, 1]
    n, first, second = sums[0], sums[1 : dim + 1], sums[dim + 1 :].reshape(dim, dim)
    _, vec = np.linalg.eigh(second / n - np.outer(first / n, first / n))
    return np.ascontiguousarray(vec[:, ::-1])


def _cells(batches: Iterable[pa.RecordBatch], dim: int, axes: np.ndarray, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        at = unit(batch.column("raw").to_pylist(), dim) @ axes[:, :DIMS]
        # cells in lexicographic order of their numbers: each number as one sortable character
        cell = ["".join(chr(0x1000 + int(c)) for c in r) for r in np.floor(at / eps)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "weight", "raw")), pa.array(cell)], ["rep", "weight", "raw", "cell"])


def _blocks(batches: Iterable[pa.RecordBatch], dim: int, axes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted vectors in blocks, with their boxes on the axes."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0

    def block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal number
        raw = rows.column("raw").to_pylist()
        at = unit(raw, dim) @ axes[:, :DIMS]
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number - 1], pa.int64()), pa.array([rows.column("rep").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([rows.column("weight").to_numpy().astype(np.int64).tobytes()], pa.binary()),
             pa.array([b"".join(raw)], pa.binary()), pa.array([at.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([at.max(axis=0).tolist()], pa.list_(pa.float64()))],
            ["place", "ids", "weights", "data", "lo", "hi"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        while rest.num_rows >= size:
            yield block(rest.slice(0, size))
            rest = rest.slice(size)
    if rest is not None and rest.num_rows:
        yield block(rest)


def interval_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: the intervals of ``FAN`` blocks (block, lo, hi) that may hold a pair within ``eps``.

    The intervals in order are the leaves of a tree with ``FAN`` children a node; starting at the root, pairs of sequence
    intervals split into pairs of their children, and those whose boxes lie more than ``eps`` apart are dropped."""
    top = boxes.agg(F.max("block")).first()[0]
    if top is None:
        return boxes.select(F.col("block").alias("a"), F.col("block").alias("b"))
    size = len(boxes.first()["lo"])
    low = lambda c, f: F.array(*[f(F.col(c)[k]) for k in range(size)])
    levels, below = [], boxes.select(F.col("block").alias("node"), "lo", "hi")
    while not levels or top > 0:
        top //= FAN
        up = below.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        below = up.groupBy("node").agg(low("lo", F.min).alias("lo"), low("hi", F.max).alias("hi"))
        levels.append(below)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels[-2::-1]:
        kids = level.withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        left = kids.select(F.col("up").alias("a"), F.col("node").alias("na"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        right = kids.select(F.col("up").alias("b"), F.col("node").alias("nb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        gap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.greatest(F.get("la", k) - F.get("hb", k), F.get("lb", k) - F.get("ha", k), F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("na") <= F.col("nb")) & (gap <= eps * eps * (1 + 1e-9) + 1e-12)).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        pairs = stash(pairs, "boxes")
    return pairs


class Block:
    """A block's vectors as given and as unit vectors, their leading principal parts, and their ids and weights."""

    def __init__(self, row: dict, dim: int, axes: np.ndarray):
        self.number, self.x = row["block"], np.frombuffer(row["data"], np.float64).reshape(-1, dim)
        self.ids, self.weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.unit, self.lo, self.hi = unit([row["data"]], dim), np.array(row["lo"]), np.array(row["hi"])
        self.look = (self.unit @ axes[:, :LOOK]).astype(np.float32)
        self.square = (self.look * self.look).sum(axis=1)


def linked_pairs(a: Block, b: Block, least: float) -> np.ndarray | None:
    """Whether each two vectors of two blocks have a cosine of ``least`` in double precision; None if their boxes or
    the first look at their leading principal parts leave no pair. What these leave out is provably further apart."""
    eps2 = 2 - 2 * least
    gap = np.maximum(0, np.maximum(a.lo - b.hi, b.lo - a.hi))
    if gap @ gap > eps2 * (1 + 1e-9) + 1e-12:
        return None
    near = a.square[:, None] + b.square[None, :] - 2 * (a.look @ b.look.T) <= np.float32(eps2 + 1e-4)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    linked = np.zeros(near.shape, bool)
    if len(i) > FEW * near.size:
        cos = a.unit @ b.unit.T
        np.greater_equal(cos, least, out=linked)
        i, j = np.nonzero(np.abs(cos - least) < 1e-9)
    else:
        cos = np.einsum("ij,ij->i", a.unit[i], b.unit[j])
        linked[i, j] = cos >= least
        close = np.abs(cos - least) < 1e-9
        i, j = i[close], j[close]
    for p, q in zip(i.tolist(), j.tolist(), strict=True):  # so near the threshold the plain formula on the vectors as given decides
        x, y = a.x[p], b.x[q]
        linked[p, q] = float(x @ y) / (float(x @ x) ** 0.5 * float(y @ y) ** 0.5) >= least
    return linked


def _links(batches: Iterable[pa.RecordBatch], dim: int, axes: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Rows are the blocks of a pair of groups (a, b), in order of (a, b, side, block): the first group's are held, the
    second one's stream past them. For each pair of blocks of the two: (id, links, root), the number of linked vectors in the other block and one linked vector that stands for the part
    of the pair's graph that the vector lies in."""
    def stars(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        linked, same = linked_pairs(a, b, least), a.number == b.number
        if linked is None:
            return
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        count = linked @ b.weights
        rows = [(a.ids, count)] if same else [(a.ids, count), (b.ids, a.weights @ linked)]
        # spanning stars: labels spread over the dense block until they rest
        la, lb = a.ids.copy(), b.ids.copy()
        big = np.iinfo(np.int64).max
        while True:
            nla = np.minimum(la, np.where(linked, lb[None, :], big).min(axis=1, initial=big))
            nlb = nla if same else np.minimum(lb, np.where(linked, nla[:, None], big).min(axis=0, initial=big))
            if (nla == la).all() and (nlb == lb).all():
                break
            la, lb = nla, nlb
        for (ids, n), root in zip(rows, [la] if same else [la, lb], strict=True):
            on = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(n[on].astype(np.int64)), pa.array(root[on])], ["id", "links", "root"])

    now, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if now != (row["a"], row["b"]):
                now, held = (row["a"], row["b"]), []
            block = Block(row, dim, axes)
            if row["side"]:
                for other in held:
                    yield from stars(other, block)
                continue
            if row["a"] == row["b"]:  # a group with itself: each block meets those before it, and its own vectors
                for other in (*held, block):
                    yield from stars(other, block)
            held.append(block)


def link(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors with a cosine of at least ``least`` are linked; n_links counts
    the others linked directly, component_id is the smallest id reachable.

    Equal vectors become one with a weight. The rest are unit vectors, for which a cosine of ``least`` is a distance
    ``eps``; a grid of that width on the leading principal dimensions orders them. Intervals of the order are joined
    recursively, those further apart than ``eps`` skipped (:func:`interval_pairs`); a task gets the blocks of two groups of
    up to ``GROUP`` intervals, one while there are few, skips pairs of blocks and of vectors that are further apart in their leading principal parts
    (:func:`linked_pairs`), computes the others in double precision, and gives sums and one row per vector, never pairs.

    Null, empty or zero vectors and those with null or non-finite components: no links, a component of their own.
    Vectors of different lengths are not compared. Repeated rows of an id: several vectors to the counts, and each row
    has the id's result. Null id: not returned. Empty table: no rows. Other columns: ignored."""
    rows = stash(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).where("vec_id is not null").mapInArrow(_raw, "vec_id long, dim int, raw binary"), "vectors")
    real = rows.where("raw is not null")
    real = real.withColumn("same", F.sha2("raw", 256))
    # a vector is named by its smallest vec_id; if that names several vectors, all but one get numbers beyond all ids
    reps = stash(real.groupBy("dim", "same").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("n", F.monotonically_increasing_id()), "reps")
    named = reps.groupBy("first").agg(F.min("n").alias("named"))
    top = real.agg(F.max("vec_id")).first()[0]
    beyond = F.lit((top or 0) + 1)
    reps = stash(reps.join(named, "first").select("dim", "same", "first", "weight", F.when(F.col("n") == F.col("named"), F.col("first")).otherwise(beyond + F.col("n")).alias("rep")), "equal")
    member = stash(real.select("vec_id", "dim", "same").join(reps.drop("first"), ["dim", "same"]).select("vec_id", "dim", "rep", "weight"), "members")
    eps = (2 - 2 * least) ** 0.5
    linked, edges = None, member.where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    for dim in sorted(r[0] for r in member.select("dim").distinct().collect()):  # the lengths of vectors: few
        heads = reps.where(F.col("dim") == dim).select("same", F.col("first").alias("vec_id"), "rep", "weight")
        distinct = stash(real.where(F.col("dim") == dim).join(heads, ["vec_id", "same"]).select("rep", "weight", "raw").dropDuplicates(["rep"]), "distinct")
        axes = principal(distinct, dim)
        cells = distinct.mapInArrow(lambda it, dim=dim, axes=axes: _cells(it, dim, axes, eps), "rep long, weight long, raw binary, cell string")
        ordered = cells.repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep")
        blocks = stash(ordered.mapInArrow(lambda it, dim=dim, axes=axes: _blocks(it, dim, axes, BLOCK), "place long, ids binary, weights binary, data binary, lo array<double>, hi array<double>"), "blocks")
        boxes = stash(_numbered(blocks.select("place", "lo", "hi")), "numbered")
        pairs = interval_pairs(boxes.select("block", "lo", "hi"), eps)
        # groups of neighbouring intervals: a block is sent to as many tasks as there are groups, not intervals
        many = -(-boxes.count() // FAN)
        span = max(1, min(GROUP, many // math.ceil(math.sqrt(6 * vectors.sparkSession.sparkContext.defaultParallelism))))
        group = lambda c: F.floor(F.col(c) / span).cast("long")
        both = pairs.select(group("a").alias("ga"), group("b").alias("gb"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("interval")), F.struct((group("a") != group("b")).cast("int").alias("side"), F.col("b").alias("interval")))).alias("s"))
        sides = both.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "s.side", "s.interval").distinct()
        cells = sides.select("a", "b").distinct().count()
        placed = blocks.join(boxes.select("place", "block"), "place").withColumn("interval", F.floor(F.col("block") / FAN).cast("long"))
        tiles = sides.join(placed, "interval").select("a", "b", "side", "block", "ids", "weights", "data", "lo", "hi").repartition(max(1, cells), "a", "b").sortWithinPartitions("a", "b", "side", "block")
        found = stash(tiles.mapInArrow(lambda it, dim=dim, axes=axes: _links(it, dim, axes, least), "id long, links long, root long"), "links")
        linked = found if linked is None else linked.unionAll(found)
        edges = edges.unionAll(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    out = rows.select("vec_id")
    if linked is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count = member.select("vec_id", "rep", "weight").distinct().join(linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    count = count.groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    comp = components(edges).withColumnRenamed("node", "vec_id")
    out = out.join(count, "vec_id", "left").join(comp, "vec_id", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("vec_id")).alias("kept"))


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered from 0 in order of their place: counts per part, summed over the parts before, are added."""
    part = F.shiftright("place", 32)
    counts = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = counts.toDF("p2", "n2").join(counts, F.col("p2") < F.col("part")).groupBy("part").agg(F.sum("n2").alias("ahead"))  # one row per partition of the sort
    with_part = blocks.withColumn("part", part)
    return with_part.join(ahead, "part", "left").select((F.coalesce("ahead", F.lit(0)) + (F.col("place") - (F.col("part") * F.lit(1 << 32)))).cast("long").alias("block"), "place", "lo", "hi")
