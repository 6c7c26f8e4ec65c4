"""Checks of finished samples and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T

ARRAYS = ("line_numbers", "line_roles", "line_keep_labels", "line_confidences")


def forbidden_in(lines: Column, hashes: Column) -> Column:
    """Whether a line's normalised text of 12 or more characters has one of the hashes."""
    found = F.transform(F.filter(F.transform(lines, T.normalize_fragment), lambda x: F.length(x) >= 12), lambda x: F.sha2(x, 256))
    return F.arrays_overlap(found, hashes)


def violations(samples: DataFrame, original: str = "original") -> DataFrame:
    """(sample_id, code) of what is wrong with sample rows (sample_id, dataset_source, query, lines, the ``ARRAYS``,
    document_label, revision, mapped, core_line_numbers, block_spans, forbidden): one row and all its rules in a pass."""
    n, roles, keep = F.size("lines"), F.col("line_roles"), F.col("line_keep_labels")
    kept = F.zip_with(roles, keep, lambda r, k: F.coalesce(r.isin("CORE", "SUPPORT", "DROP") & (k == r.isin("CORE", "SUPPORT").cast("int")), F.lit(False)))
    own = F.col("dataset_source") != original
    positive = F.col("document_label") == 1
    core = F.array_sort(F.array_distinct(F.transform(F.filter(F.arrays_zip("line_numbers", "line_roles"), lambda x: (x["line_roles"] == "CORE") & x["line_numbers"].isNotNull()), lambda x: x["line_numbers"])))
    told = F.array_sort(F.array_distinct("core_line_numbers"))
    code = F.array_join("lines", "\n")
    lengths = F.lit(True)
    for name in ARRAYS:
        lengths = lengths & F.coalesce(F.size(name) == n, F.lit(False))
    rules = {
        "length": ~lengths, "role_keep": F.exists(kept, lambda x: ~x), "query": F.coalesce(F.trim("query"), F.lit("")) == "",
        "positive_roles": positive & own & ~(F.array_contains(roles, "CORE") & F.array_contains(roles, "DROP")), "revision": positive & own & ~F.col("revision").eqNullSafe("buggy_base"), "patch_mapping": positive & own & ~F.coalesce("mapped", F.lit(False)),
        "core_truncated": positive & (F.size("core_line_numbers") > 0) & (told != core), "block_span": positive & F.exists("block_spans", lambda s: (s["start"] <= 0) | (s["stop"] < s["start"])),
        "leakage": positive & (forbidden_in(F.col("lines"), F.col("forbidden")) | forbidden_in(T.splitlines(F.col("query")), F.col("forbidden"))), "api_key": T.has_secret(F.concat_ws("\n", "query", code)),
        "gold_patch": code.contains("diff --git") | (code.contains("--- a/") & code.contains("+++ b/"))}
    found = samples.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))).alias("code"))
    again = samples.groupBy("sample_id").agg(F.count("*").alias("m")).where("m > 1 or coalesce(sample_id, '') = ''").select("sample_id", F.explode(F.array_repeat(F.lit("sample_id"), (F.col("m") - F.when(F.coalesce("sample_id", F.lit("")) == "", 0).otherwise(1)).cast("int"))).alias("code"))
    return found.unionByName(again)


def leak_risk(rows: DataFrame) -> DataFrame:
    """``risk`` of an issue against a patch's added lines (in_issue and in_code: whether one of 12 or more characters
    stands there): high if one does, medium if the issue gives edit instructions, else low."""
    return rows.withColumn("risk", F.when(F.col("in_issue") | F.col("in_code"), "high").when(T.has_instruction(F.col("issue")), "medium").otherwise("low"))


def forbidden_lines(lines: DataFrame, fragments: DataFrame, least: int = 12) -> DataFrame:
    """Lines (.., text) whose normalised text is one of the fragments (text), compared by hash: those too short are
    out before anything is shuffled, and the hash is all that is."""
    h = lambda df: df.withColumn("n", T.normalize_fragment(F.col("text"))).where(F.length("n") >= least).withColumn("h", F.sha2("n", 256))
    return h(lines).drop("n", "text").join(h(fragments).select("h").distinct(), "h", "left_semi").drop("h")


def set_overlap(rows: DataFrame, value: str, split: str) -> DataFrame:
    """(value, splits) of values that stand in more than one split."""
    return rows.select(value, split).distinct().groupBy(value).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("m")).where("m > 1").drop("m")


def role_mix(roles: Column, least_core: int = 1) -> Column:
    """Whether a sample has DROP lines and at least so many CORE lines."""
    return F.array_contains(roles, "DROP") & (F.size(F.filter(roles, lambda r: r == "CORE")) >= least_core)


def class_weighted_loss(rows: DataFrame, prob: str, truth: str, weight: str, most: float) -> DataFrame:
    """Counts of the two classes, their weights n / (2 count) up to ``most``, and the cross entropy by class and row
    weights, from one pass of sums by class."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -F.log(F.when(F.col(truth), p).otherwise(1 - p))
    w = F.greatest(F.col(weight), F.lit(0.0))
    s = rows.groupBy(F.col(truth).alias("t")).agg(F.count("*").alias("n"), F.sum(loss * w).alias("l"), F.sum(w).alias("w"))
    one = lambda t, c: F.coalesce(F.sum(F.when(F.col("t") == t, F.col(c))), F.lit(0))
    s = s.agg(one(True, "n").alias("n1"), one(False, "n").alias("n0"), one(True, "l").alias("l1"), one(False, "l").alias("l0"), F.sum("w").alias("w"))
    cw = lambda c: F.least(F.lit(most), (F.col("n0") + F.col("n1")) / (2.0 * F.greatest(F.col(c), F.lit(1))))
    s = s.select("n0", "n1", cw("n0").alias("weight0"), cw("n1").alias("weight1"), "l0", "l1", "w")
    return s.select("n0", "n1", F.round("weight0", 9).alias("weight0"), F.round("weight1", 9).alias("weight1"), F.round((F.col("l0") * F.col("weight0") + F.col("l1") * F.col("weight1")) / F.greatest(F.col("w"), F.lit(1e-6)), 6).alias("loss"))


def hinge(positive: Column, negative: Column, margin: float) -> Column:
    return F.greatest(F.lit(0.0), margin - positive + negative)


def smooth_l1(x: Column) -> Column:
    return F.when(F.abs(x) < 1, 0.5 * x * x).otherwise(F.abs(x) - 0.5)
