"""JSON lines by offset, line numbers of split files, and tables that are upserted by bucket."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from loam.storage import cut

#: Blocks of files whose counts may be broadcast: a path and two numbers each.
BROADCAST_BLOCKS = 100_000
#: Buckets of an index or of an upserted table, and bytes that one read of neighbouring records may take.
BUCKETS, READ_BYTES = 64, 8 << 20
_INDEX = "bucket int, id string, file string, offset long, length long"


# -- line numbers


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, n, value): n rises within a block, whose lines one task reads in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, with each line's number from 1, however the files are split: lines are counted
    by block and the counts of a file's blocks before are added. Counts are broadcast while there are few."""
    rows = _lines(spark, path)
    per = rows.groupBy("path", "block").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    per = cut(per)
    ahead = per.select("path", "block", (F.sum("m").over(Window.partitionBy("path").orderBy("block")) - F.col("m") - F.col("least") + 1).alias("shift"))
    ahead = F.broadcast(ahead) if per.count() <= BROADCAST_BLOCKS else ahead
    return rows.join(ahead, ["path", "block"]).select("path", (F.col("n") + F.col("shift")).alias("line"), "value")


def read_checked_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects by line, all of them checked first; blank lines are skipped. The first line that is no object of the
    schema fails with ``path:line``: only that file's blocks before it are counted then."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    parsed = rows.withColumn("r", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = parsed.where(F.col("r.__bad").isNotNull() | ~F.trim("value").startswith("{")).agg(F.min(F.struct("path", "block", "n", F.substring("value", 1, 80).alias("value"))).alias("b")).first()["b"]
    if bad is not None:
        before = _lines(spark, path).where((F.col("path") == bad["path"]) & ((F.col("block") < bad["block"]) | ((F.col("block") == bad["block"]) & (F.col("n") < bad["n"])))).count()
        raise ValueError(f"{bad['path']}:{before + 1}: no JSON object of the schema: {bad['value']}")
    return parsed.select("r.*").drop("__bad")


# -- records by offset


def _bucket(key: Column, buckets: int) -> Column:
    """The same in Spark and in a reader's Python: a checksum of the text of the key."""
    return (F.crc32(key.cast("string").cast("binary")) % buckets).cast("int")


def _index(batches: Iterable[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _INDEX.split(", ")]
    for batch in batches:
        for path, bucket in zip(batch.column("path").to_pylist(), batch.column("bucket").to_pylist(), strict=True):
            where, name = fs.FileSystem.from_uri(path)
            rows, at, rest = [], 0, b""
            with where.open_input_stream(name) as source:
                while True:
                    data = source.read(READ_BYTES)
                    *whole, rest = (rest + data).split(b"\n")
                    for line in [*whole, *([rest] if not data and rest else [])]:
                        if line.strip():
                            key = json.loads(line).get(id_col)
                            rows.append((bucket, None if key is None else str(key), path, at, len(line)))
                        at += len(line) + 1
                    if rows and (not data or len(rows) > 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)
                        rows = []
                    if not data:
                        break


def write_indexed(df: DataFrame, path: str, id_col: str, buckets: int = BUCKETS) -> None:
    """JSON lines under ``path/data`` by bucket of their id, and under ``path/index`` where each record stands (id, file,
    offset, length), as Parquet by bucket. Spark commits both, so a lost task leaves nothing; ``path`` is a URI that
    pyarrow opens as well. A bucket that may be large is several files: a file is one task's, a bucket is not."""
    df.withColumn("bucket", _bucket(F.col(id_col), buckets)).repartition("bucket").write.partitionBy("bucket").option("ignoreNullFields", "false").option("maxRecordsPerFile", 1_000_000).json(f"{path}/data")
    files = df.sparkSession.read.format("binaryFile").load(f"{path}/data").select("path", "bucket", "length").where("length > 0")
    files.select("path", "bucket").repartition("path").mapInArrow(lambda it: _index(it, id_col), _INDEX).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/index")


def _records(entries: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The records at (file, offset, length), in that order; neighbours are read at once."""
    opened, now, lo, data = None, None, 0, b""
    entries = sorted(entries)
    for k, (path, offset, length) in enumerate(entries):
        if path != now:
            if opened:
                opened.close()
            where, name = fs.FileSystem.from_uri(path)
            opened, now, lo, data = where.open_input_file(name), path, 0, b""
        if not (lo <= offset and offset + length <= lo + len(data)):
            end = offset + length
            for p, o, n in entries[k + 1 :]:
                if p != path or o > end + 4096 or o + n - offset > READ_BYTES:
                    break
                end = o + n
            lo, data = offset, opened.read_at(end - offset, offset)
        yield data[offset - lo : offset - lo + length]
    if opened:
        opened.close()


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x.decode() for x in _records(list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])


def read_by_ids(spark: SparkSession, path: str, ids: DataFrame, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The records of ``ids`` (id), whatever their number: they meet the index by bucket and id, and only what it points
    to is read, in order of file and offset. Ids without a record are left out; :func:`missing_ids` names them."""
    wanted = ids.select(F.col("id").cast("string").alias("id")).distinct().withColumn("bucket", _bucket(F.col("id"), buckets))
    spots = spark.read.parquet(f"{path}/index").join(wanted, ["bucket", "id"], "left_semi").repartition("file").sortWithinPartitions("file", "offset")
    return spots.select("file", "offset", "length").mapInArrow(_fetch, "value string").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def missing_ids(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The ``ids`` (id) that no record has."""
    return ids.select(F.col("id").cast("string").alias("id")).distinct().join(spark.read.parquet(f"{path}/index").select("id"), "id", "left_anti")


class _Bucket(InputPartition):
    def __init__(self, number: int):
        self.number = number


class IndexedReader(DataSourceReader):
    """A partition for each bucket of the index that a pushed id can lie in; a task reads its bucket's index and then the
    ranges of the records that it wants."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.id_col, self.buckets = schema.names, options["path"], options.get("id", "sample_id"), int(options.get("buckets", BUCKETS))
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.id_col,):
                values = {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value}
                self.ids = values if self.ids is None else self.ids & values
            else:
                yield f

    def partitions(self) -> list[_Bucket]:
        some = range(self.buckets) if self.ids is None else sorted({zlib.crc32(i.encode()) % self.buckets for i in self.ids})
        return [_Bucket(k) for k in some]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        where, root = fs.FileSystem.from_uri(f"{self.path}/index/bucket={partition.number}")
        if where.get_file_info(root).type == fs.FileType.NotFound:
            return
        table = ds.dataset(root, filesystem=where, format="parquet")
        only = None if self.ids is None else ds.field("id").isin(sorted(self.ids))
        for batch in table.to_batches(columns=["file", "offset", "length"], filter=only):
            for data in _records(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                row = json.loads(data)
                yield tuple(row.get(n) for n in self.names)


class IndexedJsonl(DataSource):
    """``spark.read.format("indexed_jsonl").schema(..).option("id", ..).load(path)`` of what :func:`write_indexed` wrote;
    with ``spark.sql.python.filterPushdown.enabled`` equality and membership of ids are pushed down."""

    @classmethod
    def name(cls) -> str:
        return "indexed_jsonl"

    def reader(self, schema: StructType) -> IndexedReader:
        return IndexedReader(schema, dict(self.options))


# -- upsert by bucket


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a table: those whose folder has Spark's mark of success."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its last finished upsert, with ``bucket``: of each bucket only the latest version is read. None
    where there is no table."""
    versions = _versions(spark, path)
    if not versions:
        return None
    whole = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in versions])
    latest = whole.select("bucket", "version").groupBy("bucket").agg(F.max("version").alias("version"))
    return whole.join(F.broadcast(latest), ["bucket", "version"]).drop("version")  # a row for each bucket


def upsert_buckets(table: str, new: DataFrame, key: str, order: str, buckets: int = BUCKETS, error_col: str | None = None, most: int = 1_000) -> None:
    """Put ``new`` rows into the table at ``table``, in place of those of the same ``key``; of several new ones the last
    by ``order`` counts. ``error_col`` is cut at ``most`` characters.

    Keys lie in buckets by hash. Only buckets that ``new`` touches are read and written again, as a further version beside
    the former ones, which readers see once it is finished: a failed run changes nothing and can be run again. A bucket
    is dealt to tasks by its keys, so that none is one task's."""
    spark = new.sparkSession
    rows = new.withColumn(error_col, F.substring(error_col, 1, most)) if error_col else new
    names = rows.columns
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("r.*").withColumn("bucket", _bucket(F.col(key), buckets))
    last = cut(last)
    touched = [r[0] for r in last.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    old = read_buckets(spark, table)
    if old is not None:
        kept = old.where(F.col("bucket").isin(touched)).join(last.select(key), key, "left_anti")
        last = last.unionByName(kept.select(*last.columns))
    if touched:
        last.repartition("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={max(_versions(spark, table), default=0) + 1}")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete the versions in which no bucket is the latest; how many."""
    versions = _versions(spark, path)
    if not versions:
        return 0
    whole = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in versions])
    live = {r[0] for r in whole.groupBy("bucket").agg(F.max("version").alias("version")).select("version").distinct().collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [v for v in versions if v not in live]
    for v in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"version={v}"), True)
    return len(gone)
