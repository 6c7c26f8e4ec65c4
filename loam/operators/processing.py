"""What becomes of each task: its samples after the leak check, its document negative, its failure; exports and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import arrays as A
from loam.functions import text as T
from loam.operators.audit import ratio
from loam.operators.metrics import bucket


def first_unrelated(tasks: DataFrame, touched: DataFrame, files: DataFrame) -> DataFrame:
    """(task, repo, path): of each task (task, repo) the first file (repo, path) of its repository that its patch doesn't
    touch (task, path); a task without such a file has no row. Repeated rows count once, null paths not at all.

    A task that touches k files is met by the k + 1 first of its repository only, so rows grow with what patches touch and
    never with tasks times files; ranks beyond the most that any task touches are cut before the shuffle. The ranked side
    of a repository is small, so AQE can split one that has very many tasks."""
    marks = touched.where("path is not null").select("task", "path").distinct()
    wanted = tasks.select("task", "repo").distinct().join(marks.groupBy("task").agg(F.count("*").alias("k")), "task", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    most = wanted.agg(F.max("k")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    ranked = files.where("path is not null").select("repo", "path").distinct().withColumn("rank", rank).where(F.col("rank") <= most + 1)
    free = wanted.join(ranked, "repo").where("rank <= k + 1").join(marks, ["task", "path"], "left_anti")
    return free.groupBy("task", "repo").agg(F.min("path").alias("path"))


def negative_rows(chosen: DataFrame, files: DataFrame, most: int, seed: int) -> DataFrame:
    """Sample rows that keep nothing: the first ``most`` lines of each chosen file (task, repo, path), blank ones at the end
    off; a file without any other has no row. Files: (repo, path, lines). A file's head alone goes to the tasks."""
    heads = files.join(chosen.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", "path", A.without_blank_end(F.slice("lines", 1, most), strip=True).alias("lines")).where(F.size("lines") > 0)
    n, code = F.size("lines"), F.array_join("lines", "\n")
    same = lambda x: F.array_repeat(x, n)
    return chosen.join(heads, ["repo", "path"]).select(
        T.stable_id("docneg", F.col("task"), F.col("path"), F.lit(seed)).alias("sample_id"), "task", F.col("repo").alias("repo_name"), F.col("path").alias("file_path"), code.alias("code"), F.sequence(F.lit(1), n).alias("line_numbers"),
        same(F.lit("DROP")).alias("line_roles"), same(F.lit(0)).alias("line_keep_labels"), same(F.lit(0.9)).alias("line_confidences"), same(F.array(F.lit("document_negative:unrelated_file"))).alias("line_provenance"), same(F.lit("NONE")).alias("line_relation_types"),
        F.lit(0).alias("document_label"), F.lit("same_repo_unrelated_file").alias("negative_document_type"), T.token_estimate(code).alias("estimated_tokens"))


def leaks(issue: Column, lines: Column, added: Column) -> Column:
    """Whether an added line of 12 or more normalised characters stands in the issue or is a line of the code. Nulls: no."""
    told = F.filter(F.transform(added, T.normalize_fragment), lambda x: F.length(x) >= 12)
    said = F.struct(told.alias("told"), F.coalesce(T.normalize_fragment(issue), F.lit("")).alias("issue"), F.transform(lines, T.normalize_fragment).alias("lines"))
    return F.coalesce(A.bound(said, lambda v: F.exists(v["told"], lambda x: F.contains(v["issue"], x)) | F.arrays_overlap(v["lines"], v["told"])), F.lit(False))


def outcomes(tasks: DataFrame, samples: DataFrame, negatives: DataFrame, share: float, seed: int) -> DataFrame:
    """(task, error, n_samples, n_safe, negative) of each task (task, query, n_core, mapped): why it fails, the first of
    ``query`` (blank or null), ``core`` (none), ``mapping`` (not verified), ``samples`` (none), ``leakage`` (all of them leak),
    or null; and whether its document negative is taken, by the hash of task and seed against ``share``.

    Samples: (task, sample_id, leaks); negatives: (task, sample_id). Counts alone meet the tasks. Null counts and marks: 0
    and not verified. Task ids are unique."""
    counts = samples.groupBy("task").agg(F.count("*").alias("n_samples"), F.count_if(~F.coalesce("leaks", F.lit(False))).alias("n_safe"))
    has = negatives.select("task").distinct().withColumn("has", F.lit(True))
    facts = tasks.join(counts, "task", "left").join(has, "task", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_samples", "n_safe", "n_core")})
    error = F.when(~F.coalesce(F.col("query").rlike(r"\S"), F.lit(False)), "query").when(F.col("n_core") < 1, "core").when(~F.coalesce("mapped", F.lit(False)), "mapping").when(F.col("n_samples") < 1, "samples").when(F.col("n_safe") < 1, "leakage")
    chance = F.conv(T.json_hash(F.col("task"), F.lit(seed), length=8), 16, 10).cast("double") / F.lit(4294967295.0)
    judged = facts.withColumn("error", error)
    return judged.select("task", "error", "n_samples", "n_safe", (F.col("error").isNull() & F.coalesce("has", F.lit(False)) & (chance < share)).alias("negative"))


def kept_ids(told: DataFrame, samples: DataFrame, negatives: DataFrame) -> DataFrame:
    """(task, sample_id, kind) of the samples that tasks without an error keep: those that don't leak, and the negatives
    that are taken."""
    good = samples.where(~F.coalesce("leaks", F.lit(False))).join(told.where("error is null").select("task"), "task", "left_semi")
    more = negatives.join(told.where("negative").select("task"), "task", "left_semi")
    return good.select("task", "sample_id", F.lit("sample").alias("kind")).unionByName(more.select("task", "sample_id", F.lit("document_negative").alias("kind")))


def eligible(files: DataFrame, suffix: str = ".py") -> DataFrame:
    """(id) of the patches (id, path) that name files of one suffix only. A patch without files has no row."""
    return files.groupBy("id").agg(F.bool_and(F.col("path").endswith(suffix)).alias("ok")).where("ok").select("id")


def official(rows: DataFrame) -> DataFrame:
    """(sample_id, query, code, kept_frags, score) from samples (sample_id, query, code, keep, document_label,
    original_score): 1-based kept lines and the original score, or without one the label as a number. Marks that aren't as
    many as the lines fail the job. Null query or code: empty; null label: 0."""
    code = F.coalesce("code", F.lit(""))
    fits = F.size(T.splitlines(code)) == F.size(F.coalesce("keep", F.array().cast("array<int>")))
    checked = rows.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("marks don't fit the lines of "), F.coalesce(F.col("sample_id").cast("string"), F.lit("<unknown>"))))))
    kept = F.filter(F.transform("keep", lambda k, i: F.when(k == 1, i + 1)), lambda i: i.isNotNull())
    return checked.select("sample_id", F.coalesce("query", F.lit("")).alias("query"), code.alias("code"), F.coalesce(kept, F.array().cast("array<int>")).alias("kept_frags"), F.coalesce(F.col("original_score"), F.col("document_label").cast("double"), F.lit(0.0)).alias("score"))


def derived_rows(views: DataFrame, command: Column, kind: str) -> DataFrame:
    """Whole rows of views (parent_sample_id, task, repo_name, query, lines, keep, roles, confidences, least, parent_path):
    made by a command from a parent sample. Arrays that don't fit the lines, and no lines, fail the job. Null names: empty."""
    n = F.size("lines")
    fits = (n > 0) & (F.size("keep") == n) & (F.size("roles") == n) & (F.size("confidences") == n)
    checked = views.where(F.when(F.coalesce(fits, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("arrays don't fit the lines of "), F.coalesce(F.col("parent_sample_id").cast("string"), F.lit("<unknown>"))))))
    parent, same = F.coalesce(F.col("parent_sample_id").cast("string"), F.lit("")), lambda x: F.array_repeat(x, n)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return checked.select(
        T.stable_id(f"cmd_{kind}", parent, F.lit(kind)).alias("sample_id"), parent.alias("parent_sample_id"), name("task"), name("repo_name"), F.lit("grounded_command_output").alias("dataset_source"), F.lit(kind).alias("sample_type"), name("query"),
        F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("code"), F.lit(1).alias("document_label"), F.col("least").alias("minimum_keep_ratio"), F.sequence(F.lit(1), n).alias("line_numbers"), F.col("keep").alias("line_keep_labels"),
        F.col("roles").alias("line_roles"), same(F.lit("NONE")).alias("line_relation_types"), F.col("confidences").alias("line_confidences"), same(F.array(F.lit("grounded_command_output"))).alias("line_provenance"), command.alias("command"), "parent_path")


def report(samples: DataFrame, relations: DataFrame, rankings: DataFrame, failures: DataFrame, decisions: DataFrame) -> DataFrame:
    """(metric, key, value): every figure of a finished dataset, one row each; ``key`` names a part of a distribution.

    Samples: (task_id, repo_name, code, roles, keep, confidences, provenance, relation_types, hard_types, tokens, truncated,
    split); failures: (task_id, error_type); decisions: (agreement, error). All distributions come from one scan in which
    a sample gives its (metric, key) pairs, counted before the shuffle. Ratios and means of nothing are 0; null arrays
    give nothing; tasks that gave samples and failed count twice, as in the sum of both."""
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    role = lambda r: F.coalesce(F.sum(F.size(F.filter("roles", lambda x: x == r))), F.lit(0))
    s = samples.agg(
        F.count_distinct("task_id").alias("successful_tasks"), F.count_distinct(F.nullif("repo_name", F.lit(""))).alias("repositories"), F.count("*").alias("samples"), role("CORE").alias("core_lines"), role("SUPPORT").alias("support_lines"), role("DROP").alias("drop_lines"),
        F.coalesce(F.sum(size("roles")), F.lit(0)).alias("all_lines"), F.coalesce(F.sum(F.length("code")), F.lit(0)).alias("chars"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_samples"))
    f = failures.agg(F.count_distinct("task_id").alias("failed_tasks"), F.count_if(F.col("error_type") == "LeakageError").alias("leakage_failures"))
    bad = F.coalesce(F.col("error"), F.lit("")) != ""
    d = decisions.agg(F.count("*").alias("api_requests"), F.count_if(~bad).alias("api_successes"), F.count_if(bad).alias("api_failures"), F.count("agreement").alias("told"), F.count_if("agreement").alias("agreed"))
    one = s.crossJoin(f).crossJoin(d).crossJoin(relations.agg(F.count("*").alias("relations"))).crossJoin(rankings.agg(F.count("*").alias("rankings")))  # one row each
    c = F.col
    figures = {n: c(n) for n in ("successful_tasks", "failed_tasks", "repositories", "samples", "relations", "rankings", "core_lines", "support_lines", "drop_lines", "truncated_samples", "api_requests", "api_successes", "api_failures", "leakage_failures")}
    figures |= {"tasks": c("successful_tasks") + c("failed_tasks"), "agreement_rate": ratio(c("agreed"), c("told"))} | {f"{r}_ratio": ratio(c(f"{r}_lines"), c("all_lines")) for r in ("core", "support", "drop")}
    figures |= {f"mean_{n}": ratio(c(of), c("samples")) for n, of in (("lines", "all_lines"), ("chars", "chars"), ("tokens", "tokens"))}
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.round(v.cast("double"), 9).alias("value")) for n, v in figures.items()])))
    pairs = lambda name, keys: F.transform(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()), lambda k: F.struct(F.lit(name).alias("metric"), k.alias("key")))
    share = F.aggregate(F.coalesce("keep", F.array().cast("array<int>")), F.lit(0), lambda t, k: t + k) / F.greatest(F.lit(1), size("keep"))
    each = F.concat(pairs("provenance", F.flatten("provenance")), pairs("relation_type", c("relation_types")), pairs("hard_negative_type", c("hard_types")), pairs("confidence", F.transform("confidences", lambda x: bucket(x))), pairs("keep_ratio", F.array(bucket(share))))
    parts = samples.select(F.explode(each).alias("p")).groupBy("p.metric", "p.key").agg(F.count("*").cast("double").alias("value"))
    splits = samples.where("split is not null").groupBy("split").agg(F.count_distinct(F.nullif("repo_name", F.lit(""))).cast("double").alias("value")).select(F.lit("split_repositories").alias("metric"), F.col("split").alias("key"), "value")
    return rows.unionByName(parts).unionByName(splits)


def auxiliary_findings(parts: dict[str, tuple[DataFrame, str]], samples: DataFrame, known: dict[str, tuple[str, ...]]) -> DataFrame:
    """(finding, kind, key, n) of a dataset's further rows, ``parts`` being kind: (rows with sample_id, its label's column):
    rows without a sample (``orphan``) and labels that aren't ``known`` (``label``, with the label as key; null: empty key).
    Findings of none aren't listed."""
    found = None
    ids = samples.select("sample_id").distinct()
    for kind, (rows, label) in parts.items():
        lost = rows.join(ids, "sample_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("finding"), F.lit(kind).alias("kind"), F.lit("").alias("key"), "n")
        odd = rows.where(~F.coalesce(F.col(label).isin(*known[kind]), F.lit(False))).groupBy(F.coalesce(F.col(label), F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("label").alias("finding"), F.lit(kind).alias("kind"), "key", "n")
        found = lost.unionAll(odd) if found is None else found.unionAll(lost).unionAll(odd)
    return found.where("n > 0")
