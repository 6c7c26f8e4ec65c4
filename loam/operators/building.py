"""Samples from anchors: windows around core blocks, candidates, and their acceptance in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import arrays as A
from loam.functions import text as T
from loam.operators.checks import forbidden_in, role_mix

#: The budget of a sample.
BUDGET = {"lines": 240, "chars": 30_000, "tokens": 7_500, "core": 1}


def span_windows(units: DataFrame, spans: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, window, first, last): the windows of a unit (keys, u_start, u_stop), numbered from 0.

    A unit of at most ``most`` lines is one window. Else the core spans (keys, start, stop) that overlap it are cut to it
    and, in order, join the window before while both together have at most ``most`` lines; each window is then padded
    evenly, and kept within the unit. Of equal windows the first stays. One fold over a unit's distinct spans, which are
    lines of one file; a unit without spans that doesn't fit has none."""
    inside = spans.join(units, keys).where("stop >= u_start and start <= u_stop")
    cut = inside.select(*keys, F.struct(F.greatest("start", "u_start").cast("int").alias("first"), F.least("stop", "u_stop").cast("int").alias("last")).alias("s")).where("s.first <= s.last")
    both = units.join(cut.groupBy(*keys).agg(F.array_sort(F.collect_set("s")).alias("spans")), keys, "left")
    none = F.lit(None).cast("int")
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), none.alias("first"), none.alias("last"))

    def closed(acc: Column) -> Column:
        return F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))))

    def step(acc: Column, x: Column) -> Column:
        stop = F.greatest(acc["last"], x["last"])
        grown = F.struct(acc["done"].alias("done"), acc["first"].alias("first"), stop.alias("last"))
        return F.when(stop - acc["first"] < most, grown).otherwise(F.struct(closed(acc).alias("done"), x["first"].alias("first"), x["last"].alias("last")))

    a, b = F.col("u_start").cast("int"), F.col("u_stop").cast("int")

    def padded(w: Column) -> Column:
        spare = F.greatest(F.lit(0), most - (w["last"] - w["first"] + 1))
        last = F.least(b, F.greatest(a, w["first"] - F.floor(spare / 2).cast("int")) + (most - 1))
        return F.struct(F.greatest(a, last - (most - 1)).alias("first"), last.alias("last"))

    made = F.array_distinct(F.transform(F.aggregate(F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")), start, step, closed), padded))
    whole = F.array(F.struct(a.alias("first"), b.alias("last")))
    return both.select(*keys, F.posexplode(F.when(b - a < most, whole).otherwise(made)).alias("window", "w")).select(*keys, "window", "w.first", "w.last")


def candidates(windows: DataFrame, variants: DataFrame, nearest: DataFrame) -> DataFrame:
    """(task, anchor, file, window, variant, kind, block, first, last): each window (task, anchor, file, window, first,
    last, whole) with each variant (task, anchor, variant, kind, block, v_file, v_start, v_stop) of its anchor, widened to
    hold its lines, and last as it is (kind ``easy``). A variant in another file is none; the easy one of a window that is
    the whole unit is widened to the unit nearest (task, anchor, n_start, n_stop) that has only dropped lines."""
    wide = lambda a, b: (F.least("first", F.coalesce(a, F.col("first"))).alias("first"), F.greatest("last", F.coalesce(b, F.col("last"))).alias("last"))
    hard = windows.join(variants, ["task", "anchor"]).where("v_file = file").select("task", "anchor", "file", "window", "variant", "kind", "block", *wide(F.col("v_start"), F.col("v_stop")))
    easy = windows.join(nearest, ["task", "anchor"], "left").select("task", "anchor", "file", "window", F.lit(2**31 - 1).alias("variant"), F.lit("easy").alias("kind"), F.lit(None).cast("string").alias("block"), *wide(F.when(F.col("whole"), F.col("n_start")), F.when(F.col("whole"), F.col("n_stop"))))
    return hard.unionByName(easy)


def _cut(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted rows (file, first, last, ..) with their lines and roles. A file meets all its rows at once, so that its
    text is read once and only what they ask for is copied; lines that are empty at the end are cut off."""
    names = [c for c in wanted.columns if c != "file"]
    per = wanted.groupBy("file").agg(F.collect_list(F.struct(*names)).alias("asked"))
    part = lambda c, x: F.slice(F.col(c), x["first"], x["last"] - x["first"] + 1)
    each = files.join(per, "file").select("file", F.inline(F.transform("asked", lambda x: F.struct(*[x[c].alias(c) for c in names], part("lines", x).alias("lines"), part("roles", x).alias("roles")))))
    each = each.withColumn("lines", A.without_blank_end(F.col("lines")))
    return each.withColumn("roles", F.slice("roles", F.lit(1), F.size("lines"))).withColumn("last", F.col("first") + F.size("lines") - 1)


def accepted(candidates: DataFrame, files: DataFrame, tasks: DataFrame, most: int, budget: dict = BUDGET) -> DataFrame:
    """(task, anchor, file, window, variant, kind, block, first, last, place): of each task's candidates in order of
    (anchor, window, variant) the first ``most`` that are accepted.

    Within an anchor, the first candidate of a (first, last, kind) stands for all others of it, also where it is refused:
    that is a minimum by key. Refused are those whose lines, or whose task's query, hold a forbidden line, those beyond the
    budget, and those without dropped lines or with too few core ones; they take no place, as only accepted ones are
    ranked. Files: (file, lines, roles); tasks: (task, query, forbidden). Only numbers and the verdict are shuffled."""
    cut = _cut(candidates, files).where(F.size("lines") > 0)
    code = F.array_join("lines", "\n")
    fits = (F.size("lines") <= budget["lines"]) & (F.length(code) <= budget["chars"]) & (T.token_estimate(code) <= budget["tokens"])
    facts = tasks.select("task", "forbidden", forbidden_in(T.splitlines(F.col("query")), F.col("forbidden")).alias("told"))
    judged = cut.join(facts, "task", "left").select("task", "anchor", "file", "window", "variant", "kind", "block", "first", "last", (fits & role_mix(F.col("roles"), budget["core"]) & ~F.coalesce(forbidden_in(F.col("lines"), F.col("forbidden")) | F.col("told"), F.lit(False))).alias("good"))
    rest = F.struct("file", "block", "good", "window", "variant")
    first = judged.groupBy("task", "anchor", "first", "last", "kind").agg(F.min_by(rest, F.struct("window", "variant")).alias("c"))
    ranked = first.where("c.good").select("task", "anchor", "c.file", "c.window", "c.variant", "kind", "c.block", "first", "last").withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("anchor", "window", "variant")))
    return ranked.where(F.col("place") <= most)


def sample_rows(chosen: DataFrame, files: DataFrame, tasks: DataFrame, seed: int) -> DataFrame:
    """Whole sample rows of accepted candidates: sample_id, task, file, query, code, the line arrays, the lines that are
    core, the kind of its hard negative (none for ``easy``), estimated tokens."""
    cut, code = _cut(chosen, files).join(tasks.select("task", "query"), "task"), F.array_join("lines", "\n")
    numbers = F.sequence("first", "last")
    marks = F.transform("roles", lambda r: r.isin("CORE", "SUPPORT").cast("int"))
    core = F.transform(F.filter(F.arrays_zip(numbers.alias("n"), F.col("roles").alias("r")), lambda x: x["r"] == "CORE"), lambda x: x["n"])
    return cut.select(
        T.stable_id("sample", F.col("task"), F.col("anchor"), F.col("first"), F.col("last"), F.coalesce("block", F.lit("none")), F.lit(seed)).alias("sample_id"), "task", "anchor", "file", "place", "query", code.alias("code"),
        numbers.alias("line_numbers"), F.col("roles").alias("line_roles"), marks.alias("line_keep_labels"), core.alias("core_line_numbers"), F.when(F.col("kind") != "easy", F.col("kind")).alias("hard_negative_type"), T.token_estimate(code).alias("estimated_tokens"))
