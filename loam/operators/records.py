"""Task and review records: profiles, routing, caches, adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.arrays import bound
from loam.operators.labels import role_rank
from loam.operators.ordering import row_numbers

#: Fixed value: the source of a label that nothing has said anything about.
DEFAULT = "static_default_drop"


def as_list(many: Column, one: Column) -> Column:
    """An array as it is; else a text that isn't blank as its only element; else none."""
    return F.coalesce(many, F.when(F.trim(one) != "", F.array(one)), F.array().cast("array<string>"))


def profile(tasks: DataFrame) -> DataFrame:
    """Counts of usable and unusable tasks (``error`` is null or not), repositories and texts that aren't blank."""
    said = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) != "")
    good = F.col("error").isNull()
    return tasks.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"), F.count_distinct(F.when(good, F.col("repo_name"))).alias("repositories"), said("issue_text").alias("with_issue"), said("traceback").alias("with_traceback"))


def excluded(rows: DataFrame, names: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key isn't among ``names`` (name), the others with an ``error``)."""
    named = names.select(F.col("name").alias(key)).distinct()
    return rows.join(named, key, "left_anti"), rows.join(named, key, "left_semi").withColumn("error", F.lit(reason))


def restricted(rows: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows that belong to a sample that is left."""
    return rows.join(samples.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """The last row of each key: a partial maximum, so a hot key costs a row a task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, "v.*")


def upsert(table: DataFrame, new: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """``table`` with ``new`` rows put in or over those of the same key; of several the one with the highest ``order``."""
    both = table.select(key, order, *values).withColumn("turn", F.lit(0)).unionByName(new.select(key, order, *values).withColumn("turn", F.lit(1)))
    return latest(both, key, [F.col("turn"), F.col(order)], [order, *values])


def answered(log: DataFrame, key: str, ok: Column, order: str, values: list[str]) -> DataFrame:
    """The first success of each request; one that only failed isn't there and is asked again."""
    return log.where(ok).groupBy(key).agg(F.min_by(F.struct(*values), F.col(order)).alias("v")).select(key, "v.*")


def cache_stats(log: DataFrame, ok: Column, tokens: str) -> DataFrame:
    return log.agg(F.count("*").alias("requests"), F.count_if(~ok).alias("errors"), F.coalesce(F.sum(F.when(ok, F.col(tokens))), F.lit(0)).alias("tokens"))


def pending(tasks: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Tasks without a finished state under their present fingerprint."""
    return tasks.join(done.select(key, fingerprint), [key, fingerprint], "left_anti")


def review_candidates(blocks: DataFrame, task: str, confidence: str, skip: float, most: int, order: Column) -> DataFrame:
    """The ``most`` least certain blocks of a task that aren't CORE and below ``skip``, SUPPORT or hard negatives."""
    open_ = blocks.where((F.col("role") != "CORE") & (F.col(confidence) < skip) & ((F.col("role") == "SUPPORT") | F.col("hard_negative")))
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy(task).orderBy(confidence, order))).where(F.col("rank") <= most)


def adjudicated(rows: DataFrame, accept: float = 0.85, lower: float = 0.45, agreed: float = 0.82) -> DataFrame:
    """role, confidence and agreement from (role, confidence) of the static label and of two reviewers. A sure first one
    is taken; with an unsure one the static label stays, less .10; between, a second that agrees makes ``agreed``, one that
    doesn't leaves the static label less .15."""
    sure, unsure, same = F.col("first_confidence") >= accept, F.col("first_confidence") < lower, F.col("first_role") == F.col("second_role")
    less = lambda x: F.greatest(F.lit(0.0), F.col("confidence") - x)
    taken = sure | (~unsure & same)
    return rows.withColumns({
        "new_role": F.when(taken, F.col("first_role")).otherwise(F.col("role")),
        "new_confidence": F.when(sure, F.col("first_confidence")).when(unsure, less(0.10)).when(same, F.lit(agreed)).otherwise(less(0.15)),
        "agreement": F.when(~sure, ~unsure & same)})


def labelled_rows(rows: DataFrame) -> DataFrame:
    """Rows (query, lines, kept, is_negative) of kept line numbers with per-line arrays, and why one can't be used:
    without a query or lines, a negative with kept lines, a positive without, or numbers outside the text."""
    n = F.size("lines")
    inside = (F.array_min("kept") >= 1) & (F.array_max("kept") <= n)
    error = (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "query").when(F.coalesce(n, F.lit(0)) < 1, "code")
        .when(F.col("is_negative") & (F.size("kept") > 0), "negative_with_lines").when(~F.col("is_negative") & (F.size("kept") == 0), "positive_without_lines").when(~inside, "line_numbers"))
    labels = bound(F.col("kept"), lambda kept: F.transform("lines", lambda x, i: F.array_contains(kept, i + 1).cast("int")))
    return rows.withColumns({"error": error, "keep": labels, "roles": F.transform(labels, lambda k: F.when(k == 1, "SUPPORT").otherwise("DROP")), "document_label": (~F.col("is_negative")).cast("int"), "tokens": F.greatest(F.lit(1), F.floor(F.length(F.array_join("lines", "\n")) / 4)).cast("int")})


def accepted(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows without an error."""
    return rows.where("error is null").orderBy(order).limit(most)


def diverse(rows: DataFrame, group: str, key: str, groups: int, total: int) -> DataFrame:
    """``total`` rows by turns from the ``groups`` groups of least hash: the first row of a key only, each group's rows in
    hash order, one of every group before the next."""
    from loam.functions.text import stable_hash

    once = rows.groupBy(key).agg(F.min(group).alias(group))
    chosen = once.select(group).distinct().orderBy(stable_hash(F.col(group)), group).limit(groups)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(stable_hash(F.col(key)), key))
    # a turn beyond ``total`` is never taken, so ranks are cut before the shuffle and a hot group isn't sorted whole
    return once.join(F.broadcast(chosen), group, "left_semi").withColumn("turn", turn).where(F.col("turn") <= total).orderBy("turn", stable_hash(F.col(group)), group).limit(total)


def spread(rows: DataFrame, points: int, *order: str) -> DataFrame:
    """``rows`` with ``row``, those at ``points`` places of ``order`` evenly apart, halves rounded to even; all if there
    are no more. Exact row numbers of a distributed sort meet the few places."""
    placed = row_numbers(rows, *order)
    n = placed.count()
    places = rows.sparkSession.range(points).select(F.bround(F.col("id") * F.lit((n - 1) / max(1, points - 1)), 0).cast("long").alias("row")).distinct()
    return placed.join(F.broadcast(places), "row", "left_semi")  # ``points`` rows at most


def parity(pairs: DataFrame, key: str, fields: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """(key, field, left, right) of the fields in which the two sides of a row, structs of settings, differ: an unpivot;
    a side that is missing is null in all of them."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(left)[f].cast("string").alias("left"), F.col(right)[f].cast("string").alias("right")) for f in sorted(fields)]))
    return pairs.select(key, each).where("not (left <=> right)")


def reviewed(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels (task, block, role, confidence, relation, provenance) after a review (task, block, new_role, new_confidence,
    new_relation, models, error).

    A decision goes through the label lattice like any other source: it counts if its role is higher, or the same and
    surer. Its first model joins the provenance (``api_primary:``) if new, in place of a mere default unless it says DROP;
    a second one always does (``api_reviewer:``). An error takes .10 off the confidence, down to 0, and leaves the rest. Blocks without a decision
    stay as they are; of several decisions on a block the surest counts,
    of equal ones that of the highest role's name, relation and models."""
    one = decisions.groupBy("task", "block").agg(F.max_by(F.struct("new_role", "new_confidence", "new_relation", "models", "error"), F.struct(F.col("error").isNull(), "new_confidence", "new_role", "new_relation", "models")).alias("d"))
    both = labels.join(one, ["task", "block"], "left")
    asked, failed = F.col("d").isNotNull(), F.col("d.error").isNotNull()
    old, new = role_rank(F.col("role")), role_rank(F.col("d.new_role"))
    wins = asked & ~failed & ((new > old) | ((F.col("d.new_role") == F.col("role")) & (F.col("d.new_confidence") > F.col("confidence"))))
    first, second = F.concat(F.lit("api_primary:"), F.get("d.models", F.lit(0))), F.concat(F.lit("api_reviewer:"), F.get("d.models", F.lit(1)))
    mere = (F.array_join("provenance", ",") == DEFAULT) & (F.col("d.new_role") != "DROP")
    told = F.when(F.array_contains("provenance", first), F.col("provenance")).when(mere, F.array(first)).otherwise(F.concat("provenance", F.array(first)))
    told = F.when(F.size("d.models") > 1, F.concat(told, F.array(second))).otherwise(told)
    return both.select(
        "task", "block", F.when(wins, F.col("d.new_role")).otherwise(F.col("role")).alias("role"),
        F.when(wins, F.col("d.new_confidence")).when(asked & failed, F.greatest(F.lit(0.0), F.col("confidence") - 0.10)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(wins, F.col("d.new_relation")).otherwise(F.col("relation")).alias("relation"), F.when(asked & ~failed, told).otherwise(F.col("provenance")).alias("provenance"))
