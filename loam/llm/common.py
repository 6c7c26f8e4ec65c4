"""What the corpus operators share: the shared work folder, lineage cuts, table access and Arrow text slices."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at; a longer single text is taken whole.
SLICE_BYTES = 1 << 20
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and the master
    is local (tests), a temporary folder; on a cluster an unset folder is an error, as no local one would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="loam-shared-")
    return _LOCAL["dir"]


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a step's rows to the shared folder as Parquet and read them back: the lineage ends there, a lost
    executor costs a reread, and expensive steps run once."""
    path = f"{shared_dir(df.sparkSession)}/loam-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of an operator's written steps in the shared folder. A step is dropped once those that read it are
    written, so the disk holds a few of them and not all; what the result still reads stays."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/loam-{tag}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _table(self, name: str) -> str:
        return f"loam_{name}_{self.folder.rsplit('-', 1)[1]}"

    def add(self, name: str, df: DataFrame, n: int, by: str) -> DataFrame:
        """Add to step ``name``, which lies in ``n`` buckets of the column ``by``: grouping by it moves nothing."""
        df.write.mode("append").option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(n, by).saveAsTable(self._table(name))
        return self.spark.table(self._table(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self._table(name)}`")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends: for steps that are written and never run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def numbered(scratch: Scratch, name: str, df: DataFrame) -> DataFrame:
    """``df``, written as step ``name``, with ``row``: exact row numbers from 0 without gaps. The rows of each part that
    was written are counted, and the counts of the parts before are added: one row a part is all that is gathered."""
    rows = scratch.put(name, df.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("least"))
    ahead = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("least")).alias("shift"))
    return rows.withColumn("part", part).join(F.broadcast(ahead), "part").withColumn("row", F.col("row") + F.col("shift")).drop("part", "shift")


#: Rows of a few numbers each that may be broadcast: some 50 MB in memory. What is larger is joined by a shuffle.
BROADCAST_ROWS = 500_000


def if_small(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if its counted rows are within ``BROADCAST_ROWS``."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


#: Rows that a Python worker is handed at a time; long texts come in smaller batches by bytes.
BATCH_ROWS = 2_500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a null text as the empty one; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array as its bytes and its int64 offsets, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(buf: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last+1, bytes, offsets) of runs of whole texts with about ``most`` bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    trim()


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task else holds what its last one needed."""
    pa.default_memory_pool().release_unused()
    if "libc" not in _LOCAL:
        _LOCAL["libc"] = ctypes.util.find_library("c")
    if _LOCAL["libc"] and hasattr(libc := ctypes.CDLL(_LOCAL["libc"]), "malloc_trim"):
        libc.malloc_trim(0)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of an undirected graph given as (u, v) long pairs, the component being its smallest node;
    nodes without an edge to another node don't appear.

    Alternating large-star and small-star steps: each is a partially aggregated minimum and one join on the node, so a
    node with very many neighbours is split by adaptive skew joins. Rounds grow with the logarithm of the graph's
    size; each is written to the shared folder, and ends when a round changes nothing."""
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), f"{tag}-e")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionAll(least).distinct()
        now = stash(small, tag)
        was, state = state, _state(now)
        if was == state:
            break
    return now.toDF("node", "component")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
