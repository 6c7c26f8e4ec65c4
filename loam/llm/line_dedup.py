"""Line dedup over windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import stash

WINDOW = 3


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_keys(text: Column, size: int) -> Column:
    """A 128-bit key for each window of ``size`` consecutive lines, in order; none for fewer lines."""
    key = lambda ls, i: F.unhex(F.md5(F.concat_ws("\n", F.slice(ls, i, size)).cast("binary")))
    at = lambda ls: F.when(F.size(ls) >= size, F.sequence(F.lit(1), F.size(ls) - size + 1)).otherwise(F.array().cast("array<int>"))
    # the lines are bound as a lambda's variable: named as an expression they would be split anew for every window
    return F.get(F.transform(F.array(lines(text)), lambda ls: F.transform(at(ls), lambda i: key(ls, i))), F.lit(0))


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, starts): the 0-based first lines of the windows to remove, in order, for documents that lose any.

    A window goes where the same lines stood before: at a smaller doc_id, or earlier in the same document."""
    keyed = docs.select("doc_id", window_keys(F.col("text"), size).alias("keys"))
    # the outer form keeps the optimizer from adding a size test that would compute the keys again
    hits = stash(keyed.select("doc_id", F.posexplode_outer("keys").alias("pos", "key")).where("pos is not null"), "windows")
    firsts = hits.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = hits.join(firsts, "key").where(F.struct("doc_id", "pos") > F.col("first"))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def without(text: Column, starts: Column, size: int) -> Column:
    """``text`` without the lines of the windows at ``starts`` (in order): what lies between the end of one window and
    the start of the next is kept, so overlapping windows merge, in time linear in the lines."""
    zero = F.array(F.lit(0))
    def cut(ls: Column) -> Column:
        ends, begins = F.concat(zero, F.transform(starts, lambda s: s + size)), F.concat(starts, F.array(F.size(ls)))
        return F.array_join(F.flatten(F.zip_with(ends, begins, lambda a, b: F.slice(ls, a + 1, F.greatest(b - a, F.lit(0))))), "\n")
    return F.get(F.transform(F.array(lines(text)), cut), F.lit(0))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with later copies of passages of ``size`` or more lines removed from ``text``.

    Every window of ``size`` consecutive lines is keyed; the first occurrence by (doc_id, line) stays, each later one
    goes, and what overlapping windows cover is merged. All columns and all rows are kept, a document that loses every
    line with an empty text; ``n_chars``, where there is one, is set to the new length of a changed text.
    The keys are written once, counted by partial aggregation and joined back, which Spark splits where it is skewed.

    Null text: stays null. Null doc_id: the row passes unchanged. Empty text: unchanged. Repeated rows of one doc_id
    are one document: lines removed from one are removed from all (a window that stands in both is not a copy, for
    it has one position). Very long texts: in time linear in their lines. Empty table: empty. Columns named like the
    working ones: kept, the work uses its own names."""
    had = docs.columns
    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    cut = stash(repeated_windows(base, size), "lines").withColumnRenamed("doc_id", "__cut_id").withColumnRenamed("starts", "__cut")
    out = docs.join(cut, docs["doc_id"] == cut["__cut_id"], "left").withColumn("__gone", F.col("__cut").isNotNull() & F.col("text").isNotNull())
    out = out.withColumn("text", F.when(F.col("__gone"), without(F.col("text"), F.col("__cut"), size)).otherwise(F.col("text")))
    if "n_chars" in had:
        out = out.withColumn("n_chars", F.when(F.col("__gone"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in had])


#: DuckDB's form of the operator on documents.
SQL = """
WITH base AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, p, array_to_string(ls[p:p+2], chr(10)) k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) p FROM base)),
gone AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) line FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) r FROM (SELECT DISTINCT * FROM win)) WHERE r > 1),
cut AS (SELECT doc_id, list(line) cut FROM gone GROUP BY doc_id),
done AS (SELECT d.doc_id, CASE WHEN c.cut IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(c.cut, i)), chr(10)) END AS text,
  d.lang, d.source, d.n_chars, c.cut FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id)
"""
ORACLE = SQL + "SELECT doc_id, text, lang, source, CASE WHEN cut IS NULL THEN n_chars ELSE CAST(strlen(text) AS BIGINT) END AS n_chars FROM done"
ORACLE = ORACLE.replace("strlen(text)", "length(text)")
