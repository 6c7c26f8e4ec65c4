"""JSON lines, lists, tasks, diffs and Python sources."""

from __future__ import annotations

import ast
import hashlib
import json
import tomllib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "task_id string, instance_id string, id string, repo_path string, checkout_path string, repo_name string, repo string, base_commit string, base_sha string, issue_text string, problem_statement string, query string, patch string, gold_patch string, mutation_patch string, mutation string, traceback string, trace string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects by line; blank lines are skipped and a line that is no object fails the job."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return raw.select(F.when(F.trim("value").startswith("{"), row).otherwise(F.raise_error(F.concat(F.lit("not an object: "), "value"))).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_json(spark: SparkSession, path: str, default):
    """One small JSON document; ``default`` where there is none."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else default


def write_json(spark: SparkSession, value, path: str, replace: bool = True) -> bool:
    """One small JSON document with sorted keys, written beside its place and then moved; whether it was written."""
    if not replace and exists(spark, path):
        return False
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    files = to.getFileSystem(conf)
    out = files.create(tmp, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    files.delete(to, False)
    return files.rename(tmp, to)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each split."""
    df.repartition(split).write.partitionBy(split).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither blank nor comments; none where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string")
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and name not like '#%'").distinct()


def load_config(spark: SparkSession, path: str) -> dict:
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    found = tomllib.loads(text)
    return found | {"fingerprint": hashlib.sha256(json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()[:24]}


def load_tasks(rows: DataFrame) -> DataFrame:
    """Tasks with their aliases resolved, the first that isn't null; ``error`` says why a row can't be used."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names])
    patch, change = pick("patch", "gold_patch"), pick("mutation_patch", "mutation")
    repo = pick("repo_path", "checkout_path")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    error = F.when(blank(repo), "no repository").when(blank(patch) & blank(change), "no patch")
    return rows.select(pick("task_id", "instance_id", "id").alias("task_id"), repo.alias("repo_path"), pick("repo_name", "repo").alias("repo_name"), pick("base_commit", "base_sha").alias("base_commit"), pick("issue_text", "problem_statement", "query").alias("issue_text"), patch.alias("patch"), change.alias("mutation_patch"), pick("traceback", "trace").alias("traceback"), error.alias("error"))


def python_blocks(rows: DataFrame, id_col: str = "path", text_col: str = "code") -> DataFrame:
    """Statement blocks of Python files: (id, type, name, start, stop, container); a file that doesn't parse has one row
    of type Error."""
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, code in zip(f["id"], f["text"], strict=True):
                try:
                    nodes = [n for n in ast.walk(ast.parse(code or "")) if isinstance(n, ast.stmt)]
                except (SyntaxError, ValueError) as error:
                    out.append((i, "Error", str(error)[:200], 0, 0, False))
                    continue
                out += [(i, type(n).__name__, getattr(n, "name", None), n.lineno, n.end_lineno, bool(getattr(n, "body", None))) for n in nodes]
            yield pd.DataFrame(out, columns=["id", "type", "name", "start", "stop", "container"])

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, type string, name string, start int, stop int, container boolean")
