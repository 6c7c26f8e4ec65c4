"""Tokens of a text, the lines they begin in, and labels by token under a budget."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: A line with its end, and pieces that cover a text as subword tokenizers cut it before they merge.
_END = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
LINE = rf"[^{_END}]*(?:\r\n|[{_END}])|[^{_END}]+"
PIECE = r" ?\p{L}+| ?\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+"
#: Role numbers, and the label of what isn't trained on.
ROLES = {"DROP": 0, "SUPPORT": 1, "CORE": 2}
IGNORED = -100


def format_instruction(instruction: Column | str, query: Column) -> Column:
    """The text that stands before a document: its instruction and its query."""
    told = F.lit(instruction) if isinstance(instruction, str) else instruction
    return F.concat(F.lit("<Instruct>: "), told, F.lit("\n<Query>: "), query, F.lit("\n<Document>: "))


def budgets(query_tokens: Column, limit: int, prefix: int, suffix: int) -> Column:
    """struct(query, code): how many of a query's tokens stay, and how many the code may have: a token at least."""
    room = limit - prefix - suffix
    if room < 2:
        raise ValueError("the limit leaves no room between prefix and suffix")
    query = F.least(query_tokens, F.lit(room - 1))
    return F.struct(query.cast("int").alias("query"), (F.lit(room) - query).cast("int").alias("code"))


def _offsets(rows: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(id, k, start, stop) of the matches of a pattern that covers the text, from 0, in code points."""
    each = rows.select("id", F.posexplode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("k", "piece")).select("id", "k", F.length("piece").alias("n"))
    stop = F.sum("n").over(Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return each.withColumn("stop", stop).select("id", "k", (F.col("stop") - F.col("n")).alias("start"), "stop")


def token_lines(rows: DataFrame, id_col: str, text_col: str, pattern: str = PIECE) -> DataFrame:
    """(id, token, start, line): each token of a text with its first character and the 0-based line that it begins in, the
    last line at most. Token starts and line ends are merged by one sort of a text's places; a running count of the ends
    is the line, no token looks for it."""
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    starts = _offsets(texts, "__text", pattern).select("id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("k").alias("token"))
    ends = _offsets(texts, "__text", LINE).select("id", F.col("stop").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("token"))
    both = Window.partitionBy("id").orderBy("at", "kind", "token")
    passed = F.count_if(F.col("kind") == 0).over(both.rowsBetween(Window.unboundedPreceding, 0))
    merged = starts.unionByName(ends).withColumns({"line": passed, "n": F.count_if(F.col("kind") == 0).over(Window.partitionBy("id"))})
    return merged.where("kind = 1").select("id", "token", F.col("at").alias("start"), F.least("line", F.col("n") - 1).cast("int").alias("line"))


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of numbers, as what comes before each number in its list, in sum, at most the column before."""
    for batch in batches:
        counts, most = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_numpy()
        offs = counts.offsets.to_numpy().astype(np.int64)
        n = np.concatenate([[0], np.cumsum(counts.values.to_numpy(zero_copy_only=False)[: offs[-1]], dtype=np.int64)])
        sizes = np.diff(offs)
        before = n[np.arange(offs[0], offs[-1])] - np.repeat(n[offs[:-1]], sizes)
        found = pa.ListArray.from_arrays(pa.array((offs - offs[0]).astype(np.int32)), pa.array(np.minimum(before, np.repeat(most, sizes)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], found], [*batch.schema.names[:-2], "line_index"])


def with_token_lines(rows: DataFrame, text_col: str, lines: Column, budget: Column, pattern: str = PIECE) -> DataFrame:
    """``rows`` with ``line_index``, the lines of :func:`token_lines` of a text's first ``budget`` tokens, in order, and
    without the text, which has ``lines`` lines. A token's line is the number of line ends in the tokens before it, as no token parts one; so a text
    is looked at in its own row, and nothing is shuffled. No tokens or a null text: an empty list."""
    kept = [c for c in rows.columns if c != text_col]
    pieces = F.slice(F.coalesce(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")), F.lit(1), F.greatest(F.coalesce(budget, F.lit(0)), F.lit(0)))
    ends = F.transform(pieces, lambda p: F.size(F.regexp_extract_all(p, F.lit(rf"\r\n|[{_END}]"), F.lit(0))))
    asked = rows.select(*kept, F.greatest(F.coalesce(lines, F.lit(1)) - 1, F.lit(0)).alias("__most"), ends.alias("__ends"))
    return asked.mapInArrow(_running, StructType([*(rows.schema[c] for c in kept), StructField("line_index", ArrayType(IntegerType()))]))


def encoded(rows: DataFrame, tokens: DataFrame, budget: Column, structural: Column) -> DataFrame:
    """:func:`labelled` of rows (id, ..) and of ``tokens`` (id, token, line), within the row's ``budget`` of tokens.

    Only tokens within the budget are gathered, one array a text; labels are then read by place."""
    sized = rows.withColumn("budget", budget)
    cut = tokens.join(sized.select("id", "budget"), "id").where(F.col("token") < F.col("budget"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("token", "line"))), lambda x: x["line"])
    return labelled(sized.join(cut.groupBy("id").agg(lines.alias("line_index")), "id", "left"), structural)


def labelled(rows: DataFrame, structural: Column) -> DataFrame:
    """(id, error, line_index, keep, roles, confidences, hard_negative) of rows (id, code_lines, line_keep_labels,
    line_roles, line_confidences, line_numbers, hard_spans, line_index): per token its line's label, role number,
    confidence and whether its line lies in a hard negative's span; roles of rows that are not ``structural`` are
    ``IGNORED``. ``error``: the line arrays don't fit the lines, or no token is left."""
    both = rows.withColumn("structural", structural)
    n = F.col("code_lines")
    names = ("line_keep_labels", "line_roles", "line_confidences", "line_numbers")
    fits = n > 0
    for c in names:
        fits = fits & F.coalesce(F.size(c) == n, F.lit(False))
    error = F.when(~fits, "line arrays do not align").when(F.coalesce(F.size("line_index"), F.lit(0)) < 1, "no tokens")
    at = lambda f: F.when(error.isNull(), F.transform("line_index", f))
    # by token, not as arrays by line: Spark would make those anew for each token
    role = lambda r: F.when(r == "DROP", ROLES["DROP"]).when(r == "SUPPORT", ROLES["SUPPORT"]).when(r == "CORE", ROLES["CORE"]).otherwise(IGNORED)
    role_at = lambda i: F.when(i < F.size("line_roles"), role(F.get("line_roles", i)))
    hard_at = lambda i: F.exists("hard_spans", lambda s: (s["start"] <= F.get("line_numbers", i)) & (F.get("line_numbers", i) <= s["stop"]))
    return both.select(
        "id", error.alias("error"), at(lambda i: i).alias("line_index"), at(lambda i: F.get("line_keep_labels", i)).alias("keep"),
        at(lambda i: F.when(F.col("structural"), role_at(i)).otherwise(IGNORED)).alias("roles"), at(lambda i: F.get("line_confidences", i)).alias("confidences"), at(lambda i: F.coalesce(hard_at(i), F.lit(False))).alias("hard_negative"))


def line_means(tokens: DataFrame, value: str) -> DataFrame:
    """(id, line, mean, n): the mean of a token value over the tokens that begin in a line."""
    return tokens.groupBy("id", "line").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
