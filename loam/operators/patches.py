"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T

#: Fixed value: a hunk's header, with its first old line.
HUNK = r"^@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@"


def _states(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, raw, kind, path, part, hunk, start) of each line: what it is by itself, the path that is current, and the
    stretch of lines since the last old-file or hunk header, with that header if it is a hunk's."""
    lines = rows.select(F.col(id_col).alias("id"), F.posexplode(T.splitlines(F.col(text_col))).alias("n", "raw"))
    kind = F.when(F.col("raw").startswith("--- "), "old").when(F.col("raw").startswith("+++ "), "new").when(F.col("raw").rlike(HUNK), "hunk").otherwise("body")
    told = lines.withColumn("kind", kind).withColumn("told", F.when(F.col("kind").isin("old", "new"), T.patch_path(F.substring("raw", F.lit(5), F.length("raw")))))
    so_far = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(F.col("kind") == k, F.col("told")), ignorenulls=True).over(so_far)
    head = F.when(F.col("kind") == "hunk", F.struct("raw", F.regexp_extract("raw", HUNK, 1).cast("int").alias("start"))).when(F.col("kind") == "old", F.struct(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("int").alias("start")))
    return told.select("id", "n", "raw", "kind", F.coalesce(F.nullif(last("old"), F.lit("")), last("new"), F.lit("")).alias("path"), F.count_if(F.col("kind").isin("old", "hunk")).over(so_far).alias("part"), F.last(head, ignorenulls=True).over(so_far).alias("head")).select("id", "n", "raw", "kind", "path", "part", F.col("head.raw").alias("hunk"), "head.start")


def diff_lines(rows: DataFrame, id_col: str = "task_id", text_col: str = "patch") -> DataFrame:
    """(id, seq, path, old_line, kind, text, hunk) of unified diffs: ``deleted`` lines at their old line, all ``added``
    lines, and an ``addition_context`` at the old line before which a run of changes without a deletion begins to add.

    A state machine as gaps and islands: running counts number the stretches between headers, conditional running sums
    give old lines, and runs of changes are what lies between two lines that end one. A hunk ends with its first line that
    is none; a line that looks like a file header is never a change; empty lines and notes count as nothing. A new file has
    its new path. All windows are over one text's lines, which are sorted once more but shuffled once.

    Null or empty text: no rows. Repeated ids: texts of one id are read as one, so ids should be unique."""
    s = _states(rows, id_col, text_col)
    mark, body = F.substring("raw", 1, 1), (F.col("kind") == "body") & F.col("hunk").isNotNull() & (F.col("path") != "") & (F.col("raw") != "")
    is_del, is_add = (mark == "-") & ~F.col("raw").startswith("---"), (mark == "+") & ~F.col("raw").startswith("+++")
    what = F.when(body, F.when(is_del, "deleted").when(is_add, "added").when(mark == " ", "context").when(mark == "\\", "note").otherwise("stop"))
    part = Window.partitionBy("id", "part").orderBy("n")
    before, so_far = part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("what", what)
    s = s.withColumn("what", F.when(F.coalesce(F.count_if(F.col("what") == "stop").over(before), F.lit(0)) == 0, F.col("what")))
    s = s.withColumns({"old_line": (F.col("start") + F.coalesce(F.count_if(F.col("what").isin("deleted", "context")).over(before), F.lit(0))).cast("int"), "run": F.count_if(F.col("what").isin("context", "stop")).over(so_far)})
    run = Window.partitionBy("id", "part", "run")
    s = s.withColumns({"pure": F.count_if(F.col("what") == "deleted").over(run) == 0, "first": F.min(F.when(F.col("what") == "added", F.col("n"))).over(run)})
    text = F.substring("raw", F.lit(2), F.length("raw"))
    row = lambda k, line, t: F.struct(F.lit(k).alias("kind"), line.cast("int").alias("old_line"), t.alias("text"))
    line = F.col("old_line")
    out = F.when(F.col("what") == "deleted", F.array(row("deleted", line, text))).when(F.col("what") == "added", F.when(F.col("pure") & (F.col("n") == F.col("first")), F.array(row("added", line, text), row("addition_context", F.greatest(F.lit(1), line), F.lit("")))).otherwise(F.array(row("added", line, text))))
    return s.where(F.col("what").isin("deleted", "added")).select("id", F.col("n").alias("seq"), "path", F.explode(out).alias("o"), "hunk").select("id", "seq", "path", "o.old_line", "o.kind", "o.text", "hunk")


def diff_files(rows: DataFrame, id_col: str = "task_id", text_col: str = "patch") -> DataFrame:
    """(id, path): the files that diffs name, by their old path if there is one."""
    return _states(rows, id_col, text_col).where("kind = 'new' and path <> ''").select("id", "path").distinct()
