"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import Scratch, numbered

#: Rows of an index block, blocks that a task holds, and queries that it is handed at most and at least.
BLOCK, HELD, MOST_QUERIES, LEAST_QUERIES = 32_768, 8, 8_192, 64
#: Leading bits of an attribute that have slices; what lies below them is bounded, and exact for the boundary rows.
BITS = 5
_ROW = "row long, id long, dim int, raw binary"
_INDEX = "block long, dim int, width int, low binary, slices binary, rows binary, ids binary, raw binary"
_FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def quantised(column: pa.Array, scale: int) -> list[bytes | None]:
    """floor(scale * x) of each vector as little-endian int64; None for null vectors and those with null or non-finite
    components. A component that is no long then is an error."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        x = None if v is None or None in v else np.floor(scale * np.array(v, np.float64))
        if x is None or not np.isfinite(np.array(v, np.float64)).all():
            out.append(None)
            continue
        if len(x) and np.abs(x).max() >= 2.0**62:
            raise ValueError("a quantised component is beyond 62 bits")
        out.append(x.astype("<i8").tobytes())
    return out


def _quantise(batches: Iterable[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = quantised(batch.column("vec"), scale)
        keep = pa.array([x is not None for x in raw], pa.bool_())
        out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("is_query"), pa.array([None if x is None else len(x) // 8 for x in raw], pa.int32()), pa.array(raw, pa.binary())], ["id", "is_query", "dim", "raw"])
        yield out.filter(keep)


class Slices:
    """A block of integer vectors by bits: ``slices[d, s]`` is the bitmap over the rows of bit ``low_bit + s`` of
    attribute d above its least value; the ``low_bit`` bits below have none."""

    def __init__(self, x: np.ndarray, low: np.ndarray, width: int, slices: np.ndarray):
        self.x, self.low, self.width, self.slices = x, low, width, slices
        self.low_bit = max(0, width - BITS)
        self.words = slices.shape[2]
        self.valid = np.zeros(self.words * 64, np.uint8)
        self.valid[: len(x)] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view(np.uint64)
        self.both = np.stack([slices, ~slices])

    @staticmethod
    def build(x: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        n, dim = x.shape
        low = x.min(axis=0) if n else np.zeros(dim, np.int64)
        above = (x - low).astype(np.uint64)
        width = max(1, int(above.max(initial=0)).bit_length())
        low_bit, words = max(0, width - BITS), max(1, -(-n // 64))
        slices = np.zeros((dim, width - low_bit, words), np.uint64)
        for s in range(width - low_bit):
            bit = np.zeros((dim, words * 64), np.uint8)
            bit[:, :n] = ((above >> np.uint64(low_bit + s)) & np.uint64(1)).T
            slices[:, s] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)
        return low, width, slices

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum of q[d] times the sliced part of attribute d, but for a constant: each
        signed binary digit of q[d] adds its slices, shifted, and a negative one their complements."""
        columns: list[list[np.ndarray]] = []

        def put(weight: int, maps: np.ndarray) -> None:
            while len(columns) <= weight:
                columns.append([])
            columns[weight].append(maps)

        picks: dict[int, list[tuple[int, int]]] = {}
        for d, value in enumerate(q.tolist()):
            place = 0
            while value:
                if value & 1:
                    digit = 2 - (value & 3)
                    value -= digit
                    picks.setdefault(place, []).append((int(digit < 0), d))
                value >>= 1
                place += 1
        for place, which in picks.items():
            sign, dims = (np.array(c) for c in zip(*which, strict=True))
            for s in range(self.slices.shape[1]):
                put(place + s, self.both[sign, dims, s])
        out, weight = [], 0
        while weight < len(columns):
            maps = np.concatenate(columns[weight]) if columns[weight] else np.zeros((1, self.words), np.uint64)
            carry = []
            while len(maps) >= 3:  # three bitmaps of a weight are one of it and one of the next
                third = len(maps) // 3
                a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                one = a ^ b
                carry.append((a & b) | (c & one))
                maps = np.concatenate([one ^ c, maps[3 * third :]])
            if len(maps) == 2:
                carry.append((maps[0] & maps[1])[None])
                maps = (maps[0] ^ maps[1])[None]
            out.append(maps[0])
            for m in carry:
                put(weight + 1, m)
            weight += 1
        return out

    def top(self, q: np.ndarray, k: int, without: int | None) -> np.ndarray:
        """Rows that may be among the ``k`` of the highest scores, the ``without``-th aside: from the most significant
        slice downward the rows with the highest sums are kept, then all that the slices don't tell from them."""
        live = self.valid
        if without is not None:
            live = live.copy()
            live[without // 64] &= ~np.uint64(1 << (without % 64))
        if int(np.bitwise_count(live).sum()) > k:
            sums = self.sums(q)
            even, need, value = live, k, 0
            for s in range(len(sums) - 1, -1, -1):
                hit = even & sums[s]
                n = int(np.bitwise_count(hit).sum())
                if n >= need:
                    even, value = hit, value | (1 << s)
                else:
                    need, even = need - n, even & ~sums[s]
            below = sum(map(abs, q.tolist())) * ((1 << self.low_bit) - 1) >> self.low_bit
            live = _at_least(sums, live, value - below)
        return np.nonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))[0]


def _at_least(sums: list[np.ndarray], live: np.ndarray, value: int) -> np.ndarray:
    if value <= 0:
        return live
    more, even = np.zeros_like(live), live
    for s in range(len(sums) - 1, -1, -1):
        if value >> s & 1:
            even = even & sums[s]
        else:
            more, even = more | (even & sums[s]), even & ~sums[s]
    return more | even


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; one beyond a long is an error."""
    if len(x) and int(np.abs(x).max(initial=0)) * sum(map(abs, q.tolist())) >= 2**63:
        exact = [sum(a * b for a, b in zip(r, q.tolist(), strict=True)) for r in x.tolist()]
        return np.array(exact, np.int64)  # OverflowError where one doesn't fit
    return x.astype(np.int64) @ q


def _packed(x: np.ndarray) -> bytes:
    """int64 rows with one byte ahead that names the narrowest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    kind = next(c for c, top in (("h", 2**15), ("i", 2**31), ("q", 2**63)) if most < top)
    return kind.encode() + x.astype(f"<{'i2' if kind == 'h' else 'i4' if kind == 'i' else 'i8'}").tobytes()


def _unpacked(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, {"h": "<i2", "i": "<i4", "q": "<i8"}[data[:1].decode()], offset=1).reshape(n, dim)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their block: an index row of each block and dimension."""
    def made(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = rows.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = rows.filter(pa.array(dims == dim))
            x = np.frombuffer(b"".join(part.column("raw").to_pylist()), "<i8").reshape(part.num_rows, dim)
            low, width, slices = Slices.build(x)
            yield pa.RecordBatch.from_pylist([{"block": block, "dim": dim, "width": width, "low": low.astype("<i8").tobytes(), "slices": slices.tobytes(), "rows": part.column("row").to_numpy().astype("<i8").tobytes(), "ids": part.column("id").to_numpy().astype("<i8").tobytes(), "raw": _packed(x)}], _schema(_INDEX))

    now, held = None, []
    for batch in batches:
        block = batch.column("row").to_numpy() // BLOCK
        for lo, hi in _runs(block):
            if now is not None and block[lo] != now:
                yield from made(now, pa.Table.from_batches(held))
                held = []
            now = int(block[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from made(now, pa.Table.from_batches(held))


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]]) if len(key) else np.zeros(1, int)
    yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a cell: some index blocks first, which are held, then its queries, each answered from all of them."""
    cell, held = None, []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["cell"] != cell:
                cell, held = r["cell"], []
            if r["query_row"] is None:
                n, dim = len(r["rows"]) // 8, r["dim"]
                slices = np.frombuffer(r["slices"], np.uint64).reshape(dim, min(r["width"], BITS), max(1, -(-n // 64)))
                held.append((dim, np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8"), Slices(_unpacked(r["raw"], dim, n), np.frombuffer(r["low"], "<i8"), r["width"], slices)))
                continue
            q, best = np.frombuffer(r["raw"], "<i8"), []
            for dim, rows, ids, index in held:
                if dim != r["dim"]:
                    continue
                own = int(np.searchsorted(rows, r["query_row"]))
                at = index.top(q, k, own if own < len(rows) and rows[own] == r["query_row"] else None)
                s = scores(index.x[at], q)
                first = np.lexsort((rows[at], ids[at], -s))[:k]
                best += zip((-s[first]).tolist(), ids[at][first].tolist(), rows[at][first].tolist(), strict=True)
            out += [(r["query_row"], r["query_id"], row, i, -s) for s, i, row in sorted(best)[:k]]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_schema(_FOUND))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the highest inner product with each row for which ``is_query``
    holds, all rows but itself being candidates, components taken as floor(scale * x); ties to the smaller vec_id.

    Rows are numbered and lie in blocks of ``BLOCK``; a block's index has, of each attribute, bitmaps of its ``BITS``
    leading bits. A query's score is added up in bitmaps, rows are chosen from its most significant slice downward, and
    all rows that the missing low bits could lift over the boundary get exact integer scores, so nothing is left to
    chance. Index blocks and queries meet in a grid of cells: a task holds ``HELD`` blocks and streams some queries
    past them; a cell gives k rows a query.

    Null vectors and those with null or non-finite components: neither queries nor candidates. Vectors of different
    lengths: not compared; empty ones score 0 with each other. Null id: left out. Repeated rows of an id: candidates
    each, and each a query of its own. Fewer than ``k`` candidates: all of them. Components beyond 62 bits or scores
    beyond a long: an error. Empty table: no rows. Other columns: ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    rows = numbered(scratch, "rows", given.mapInArrow(lambda it: _quantise(it, scale), "id long, is_query boolean, dim int, raw binary"))
    n, queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks = max(1, -(-n // BLOCK))
    laid = rows.select("row", "id", "dim", "raw", F.floor(F.col("row") / BLOCK).cast("int").alias("block")).repartitionById(blocks, F.col("block")).sortWithinPartitions("row")
    index = scratch.put("index", laid.select("row", "id", "dim", "raw").mapInArrow(_build, _INDEX))
    down = -(-blocks // HELD)
    across = max(1, -(-queries // MOST_QUERIES), min(-(-queries // LEAST_QUERIES), 4 * spark.sparkContext.defaultParallelism))
    left = index.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("cell", (F.floor(F.col("block") / HELD) * across + F.col("b")).cast("int"))
    asked = rows.where("is_query").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("cell", (F.col("a") * across + F.pmod(F.xxhash64("row"), F.lit(across))).cast("int"))
    asked = asked.select("cell", F.col("row").alias("query_row"), F.col("id").alias("query_id"), "dim", "raw")
    both = left.drop("b").unionByName(asked, allowMissingColumns=True).repartitionById(down * across, F.col("cell"))
    found = both.sortWithinPartitions("cell", F.col("query_row").asc_nulls_first(), "block").mapInArrow(lambda it: _search(it, k), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The scores are sums of integers far below 2^53, so doubles hold them exactly.
ORACLE = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x
           from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score, c.r as cr
      from v q join v c on q.r <> c.r and len(q.x) = len(c.x) where q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by r order by score desc, vec_id, cr)::int as rank from s)
select query_id, rank, vec_id, score from k where rank <= 5"""
